"""Text functions as columns: markdown and table counts, sentences, packing, clean-up, language hints."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and formats that define results.
ABBREVIATIONS = ("al", "approx", "cf", "dr", "e.g", "eq", "etc", "fig", "i.e", "jr", "mr", "mrs", "ms", "no", "nr", "p", "pp", "prof", "ref", "st", "tab", "vs")
ENGLISH_HINTS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")
ENGLISH_TITLES = (
    "abstract", "appendix", "conclusion", "conclusions", "discussion", "introduction", "material",
    "method", "methods", "reference", "references", "result", "results", "summary",
)
CELL_BREAK = "\n|||CELL_BREAK|||\n"
LANGUAGE_ALIASES = {
    "zh-cn": "zh-CN", "zh-tw": "zh-TW", "pt-br": "pt-BR", "pt-pt": "pt-PT",
    "en-us": "en-US", "en-gb": "en-GB", "es-mx": "es-MX", "fr-ca": "fr-CA",
}
SENTENCE_ENDS = ".?!:;)\"'”’"
CLOSERS = "['\"”’)\\]}]"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
CHUNK_SIZE, CHUNK_FLOOR, CHUNK_CAP, TABLE_TOKENS, ROW_GROUP = 1800, 128, 800, 4096, 8


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def compact(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def occurrences(c: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def token_count(c: Column) -> Column:
    """Estimated tokens: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def paragraph_count(c: Column) -> Column:
    return F.size(F.filter(F.split(strip(c), r"(?U)\n\s*\n"), lambda p: strip(p) != ""))


def list_item_count(c: Column) -> Column:
    return count(c, r"(?m)^\s*[-*+]\s+\S")


def heading_count(c: Column) -> Column:
    return count(c, r"(?m)^\s{0,3}#{1,6}\s+\S")


def word_count(c: Column) -> Column:
    return count(c, r"(?U)\b\w+\b")


def table_mark_count(c: Column) -> Column:
    """Tables written in HTML plus rows written with pipes (each row counts)."""
    return count(c, r"(?is)<table\b") + count(c, r"(?m)^\s*\|.+\|\s*$")


def figure_mark_count(c: Column) -> Column:
    return count(c, r"!\[[^\]]*\]\([^)]+\)|\[\[FIGURE_[^\]]+\]\]")


def letter_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"\P{L}", "")) / F.length(c)).otherwise(0.0)


def non_ascii_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[\x00-\x7F]", "")) / F.length(c)).otherwise(0.0)


# Markup

def table_heavy(c: Column) -> Column:
    low = F.lower(c)
    return F.contains(low, F.lit("<table")) & (F.contains(low, F.lit("<tr")) | low.rlike(r"&lt;\s*tr\b")) & F.contains(low, F.lit("</table>"))


def inline_markup(c: Column) -> Column:
    return F.lower(c).rlike(r"<table|<tr|<td|<th|&lt;\s*tr\b")


def may_hold_table(c: Column) -> Column:
    low = F.lower(c)
    return F.contains(low, F.lit("<table")) | (F.contains(low, F.lit("&lt;")) & F.contains(low, F.lit("table")))


def primary_table(c: Column) -> Column:
    """The first whole table, null if there is none."""
    found = F.regexp_extract(c, r"(?is)(<table\b.*?</table>)", 1)
    return F.when(found != "", found)


def tags_opened(c: Column, tag: str) -> Column:
    return count(c, rf"(?is)<{tag}\b")


def tags_closed(c: Column, tag: str) -> Column:
    return count(c, rf"(?is)</{tag}>")


def normalize_table(c: Column) -> Column:
    """Escaped table tags made real, and each row of a whole table ended before the next row or the table's end."""
    real = c
    for tag in ("table", "thead", "tbody", "tfoot", "tr", "td", "th"):
        real = F.regexp_replace(real, rf"(?is)&lt;\s*(/?)\s*{tag}\b([^<>]*?)&gt;", f"<$1{tag}$2>")

    def fixed(piece: Column) -> Column:
        open_row = piece.rlike(r"(?is)^<tr\b[^>]*>") & ~piece.rlike(r"(?is)</tr\s*>")
        at_end = F.regexp_replace(piece, r"(?is)(</table\s*>.*)$", "</tr>$1")
        return F.when(open_row & piece.rlike(r"(?is)</table\s*>"), at_end).when(open_row, F.concat(piece, F.lit("</tr>"))).otherwise(piece)

    def rows(whole: Column) -> Column:
        return F.array_join(F.transform(F.split(whole, r"(?is)(?=<tr\b[^>]*>)"), fixed), "")

    pieces = F.split(real, r"(?is)(?=<table\b)|(?<=</table>)")
    repaired = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"(?is)^<table\b.*</table>$"), rows(p)).otherwise(p)), "")
    return F.when(may_hold_table(c), repaired).otherwise(c)


def table_rows(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?is)(<tr\b[^>]*>.*?</tr>)"), 1)


def valid_table(source: Column, translated: Column) -> Column:
    """A translated table holds if tables, rows and cells are as many; cells may change between td and th."""
    a, b = primary_table(source), primary_table(translated)
    same = lambda t: (tags_opened(a, t) == tags_opened(b, t)) & (tags_closed(a, t) == tags_closed(b, t))
    cells = lambda x: tags_opened(x, "td") + tags_opened(x, "th")
    ends = lambda x: F.lower(strip(x)).endswith("</table>")
    kept = same("table") & same("tr") & ((same("td") & same("th")) | (cells(a) == cells(b)))
    return ~table_heavy(source) | F.coalesce(a.isNotNull() & b.isNotNull() & (~ends(source) | ends(translated)) & kept, F.lit(False))


def valid_structure(source: Column, translated: Column, heading: Column) -> Column:
    """Whether a translation keeps enough of its source: length, paragraphs, items, headings."""
    s, t = strip(source), strip(translated)
    short = (F.length(s) >= 200) & (F.length(t) < F.greatest(F.lit(40), F.floor(F.length(s) * 0.2)))
    ps, pt = paragraph_count(s), paragraph_count(t)
    collapsed = (ps >= 3) & (pt < F.greatest(F.lit(2), F.floor(ps / 2)))
    items, heads = list_item_count(s), heading_count(s)
    lost = ((items > 0) & (list_item_count(t) < items)) | ((heads > 0) & (heading_count(t) < heads))
    broken = heading & F.contains(t, F.lit("\n\n"))
    return F.when(s == "", t == "").when(t == "", F.lit(False)).otherwise(~(short | collapsed | lost | broken))


def pipe_cells(c: Column) -> Column:
    """Cells of a row written with pipes; empty cells at its ends vanish with the pipes."""
    return F.transform(F.split(F.regexp_replace(strip(c), r"^\|+|\|+$", ""), r"\|"), strip)


def is_separator(cells: Column) -> Column:
    return F.forall(cells, lambda x: F.regexp_replace(x, r"^[-: ]+", "") == "")


def split_cells(translated: Column, source: Column, expected: Column) -> Column:
    """A translated row's cells if as many as expected, else the source's, padded or cut; a single cell is taken whole."""
    cut = lambda c: F.transform(F.split(c, r"\n\|\|\|CELL_BREAK\|\|\|\n"), strip)
    parts, own = cut(translated), cut(source)
    padded = F.slice(F.concat(own, F.array_repeat(F.lit(""), expected)), F.lit(1), expected)
    return F.when(F.size(parts) == expected, parts).when(expected == 1, F.array(strip(translated))).when(F.size(own) == expected, own).otherwise(padded)


def escape_cell(c: Column) -> Column:
    return strip(F.replace(F.replace(c, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|")))


def table_html(headers: Column, rows: Column) -> Column:
    """A table as HTML; `rows` holds structs (text, rowspan, colspan)."""
    head = F.concat(F.array(F.lit("<thead><tr>")), F.transform(headers, lambda h: F.concat(F.lit("<th>"), escape_cell(h), F.lit("</th>"))), F.array(F.lit("</tr></thead>")))

    def cell(x: Column) -> Column:
        span = lambda n: F.when(x[n] > 1, F.concat(F.lit(f' {n}="'), x[n].cast("string"), F.lit('"'))).otherwise("")
        return F.concat(F.lit("<td"), span("rowspan"), span("colspan"), F.lit(">"), escape_cell(x["text"]), F.lit("</td>"))

    body = F.flatten(F.transform(rows, lambda r: F.concat(F.array(F.lit("<tr>")), F.transform(r, cell), F.array(F.lit("</tr>")))))
    return F.array_join(
        F.concat(
            F.array(F.lit('<table class="structured-table">')),
            F.when(F.size(headers) > 0, head).otherwise(F.array().cast("array<string>")),
            F.array(F.lit("<tbody>")),
            body,
            F.array(F.lit("</tbody></table>")),
        ),
        "\n",
    )


# Language

def for_detection(c: Column) -> Column:
    """Text without tags, entities, cell breaks and markdown signs."""
    out = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"&[a-zA-Z0-9#]+;", " ")
    out = F.regexp_replace(F.replace(out, F.lit(CELL_BREAK), F.lit(" ")), r"[_*`#>\-]+", " ")
    return compact(out)


def looks_english(c: Column) -> Column:
    """Whether a text may be English already: plain ASCII, no markup and enough common words."""

    def by_words(found: Column) -> Column:
        n, hits = F.size(found), F.size(F.filter(found, lambda w: w.isin(*ENGLISH_HINTS)))
        return (
            F.when(n == 0, False)
            .when(n == 1, F.get(found, F.lit(0)).isin(*ENGLISH_TITLES))
            .when(n <= 4, hits >= 1)
            .otherwise(hits >= F.greatest(F.lit(2), F.floor(n / 8)))
        )

    def by_text(clean: Column) -> Column:
        found = F.regexp_extract_all(F.lower(clean), F.lit("([a-z]+)"), 1)
        return F.when((clean == "") | clean.rlike(r"[^\x00-\x7F]"), False).otherwise(bound(found, by_words))

    return F.when(strip(c) == "", True).when(inline_markup(c), False).otherwise(bound(for_detection(c), by_text))


def skip_translation(c: Column, language: Column) -> Column:
    unknown = language.isNull() & (strip(c) != "")
    return F.when((language == "en") | unknown, looks_english(c)).otherwise(False)


def chunk_language(c: Column, detected: Column, heading: Column, document_language: Column) -> Column:
    """The detector's answer for 24 characters or more; short headings and markup take any answer, other short texts the document's."""
    long_enough = F.length(for_detection(c)) >= 24
    relaxed = F.when(for_detection(c) != "", detected)
    return F.when(long_enough & detected.isNotNull(), detected).when(heading | inline_markup(c), relaxed).otherwise(document_language)


def normalize_language(c: Column) -> Column:
    low = F.lower(F.replace(strip(c), F.lit("_"), F.lit("-")))
    out = F.when(low.rlike(r"^\p{L}{2}$"), low).when(low.rlike(r"^\p{L}{2}-\p{L}{2}$"), F.concat(F.left(low, F.lit(3)), F.upper(F.right(low, F.lit(2)))))
    for alias, code in LANGUAGE_ALIASES.items():
        out = F.when(low == alias, code).otherwise(out)
    return out


# Sentences and chunks

_ABBREVIATION = "|".join(map(re.escape, ABBREVIATIONS))
_BOUNDARY = rf"(?<=[.!?]{CLOSERS}{{0,8}})(?<!(?<!\p{{L}})(?i:{_ABBREVIATION}|\p{{L}})\.{CLOSERS}{{0,8}})\s+(?!\p{{Ll}})"


def sentences(c: Column) -> Column:
    """Sentences of a text: ends are . ! ? and closers before white space, but not after abbreviations and single letters
    or before a lower-case letter. Blank texts have none."""
    clean = compact(c)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, _BOUNDARY))


def token_budget(chunk_size: Column) -> Column:
    return F.least(F.greatest(F.lit(CHUNK_FLOOR), F.when(F.coalesce(chunk_size, F.lit(0)) == 0, CHUNK_SIZE).otherwise(chunk_size)), F.lit(CHUNK_CAP))


def table_budget(tokens: Column, max_tokens: Column) -> Column:
    return F.greatest(max_tokens, F.least(F.lit(TABLE_TOKENS), F.floor(tokens * 2.2).cast("int") + 256))


def output_budget(prompt_tokens: Column, max_tokens: Column) -> Column:
    return F.greatest(F.lit(128), F.least(max_tokens, F.floor(prompt_tokens * 0.75).cast("int")))


def _with(now: Column, piece: Column) -> Column:
    return F.when(now == "", piece).otherwise(F.concat(now, F.lit(" "), piece))


def _tokens_with(now: Column, piece: Column) -> Column:
    return F.floor((F.length(now) + 1 + F.length(piece)) / 4)


def greedy(pieces: Column, budget: Column | int) -> Column:
    """Pieces joined by spaces into parts of at most `budget` estimated tokens, in order; a larger piece is a part of its own."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("now"))

    def step(acc: Column, piece: Column) -> Column:
        full = (acc["now"] != "") & (_tokens_with(acc["now"], piece) > limit)
        return F.when(full, F.struct(F.concat(acc["parts"], F.array(acc["now"])).alias("parts"), piece.alias("now"))).otherwise(F.struct(acc["parts"].alias("parts"), _with(acc["now"], piece).alias("now")))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["now"] != "", F.concat(acc["parts"], F.array(acc["now"]))).otherwise(acc["parts"]))


def split_long(sentence: Column, budget: Column | int) -> Column:
    """A sentence beyond the budget in parts: by clauses if all parts then fit, else by words."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    clauses = F.split(sentence, r"(?<=[;:])\s+|(?<=,)\s+(?=[A-Z0-9(])")
    words = greedy(F.filter(F.split(sentence, r"(?U)\s+"), lambda w: w != ""), limit)
    by_word = bound(words, lambda w: F.when(F.size(w) == 0, F.array(sentence)).otherwise(w))

    def by_clause(parts: Column) -> Column:
        fits = (F.size(clauses) > 1) & (F.size(parts) > 0) & F.forall(parts, lambda p: token_count(p) <= limit)
        return F.when(fits, parts).otherwise(by_word)

    return F.when(token_count(sentence) <= limit, F.array(sentence)).otherwise(bound(greedy(clauses, limit), by_clause))


def chunks(c: Column, budget: Column | int) -> Column:
    """A text in parts of at most `budget` estimated tokens: whole, else by sentences, else by clauses or words."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("now"))
    flushed = lambda acc: F.when(acc["now"] != "", F.concat(acc["parts"], F.array(acc["now"]))).otherwise(acc["parts"])

    def step(acc: Column, s: Column) -> Column:
        return (
            F.when(token_count(s) > limit, F.struct(F.concat(flushed(acc), split_long(s, limit)).alias("parts"), F.lit("").alias("now")))
            .when((acc["now"] != "") & (_tokens_with(acc["now"], s) > limit), F.struct(F.concat(acc["parts"], F.array(acc["now"])).alias("parts"), s.alias("now")))
            .otherwise(F.struct(acc["parts"].alias("parts"), _with(acc["now"], s).alias("now")))
        )

    packed = F.aggregate(sentences(c), start, step, flushed)
    return F.when(token_count(c) <= limit, F.array(c)).otherwise(bound(packed, lambda p: F.when(F.size(p) == 0, F.array(c)).otherwise(p)))


def join_lines(lines: Column) -> Column:
    """Lines as one paragraph: a hyphen at a line's end goes with the break, other breaks become a space."""
    full = F.filter(F.transform(lines, strip), lambda x: x != "")
    last = F.size(full) - 1
    joined = F.transform(full, lambda x, i: F.when(i == last, x).when(x.endswith("-"), F.left(x, F.length(x) - 1)).otherwise(F.concat(x, F.lit(" "))))
    return compact(F.array_join(joined, ""))


# Joining recognised regions

def dehyphenated(previous: Column, following: Column) -> tuple[Column, Column]:
    """A word cut at a region's end made whole: its second part moves to the first region."""
    before, after = rstrip(previous), lstrip(following)
    cut = before.rlike(rf"[{LATIN}]{{2,}}-$") & after.rlike(rf"^[{LATIN}]{{2,}}")
    suffix = F.regexp_extract(after, rf"^([{LATIN}]{{2,}})", 1)
    left = F.when(cut, F.concat(F.left(before, F.length(before) - 1), suffix)).otherwise(before)
    right = F.when(cut, lstrip(F.substring(after, F.length(suffix) + 1, F.length(after)))).otherwise(after)
    return left, right


def starts_heading(c: Column) -> Column:
    """A first line that begins with # or is short with no word in lower case."""
    line = strip(F.get(F.split(strip(c), r"\R"), F.lit(0)))
    found = F.regexp_extract_all(line, F.lit(f"([{LATIN}]+)"), 1)
    titled = F.size(found).between(1, 7) & (F.length(line) <= 80) & ~F.exists(found, lambda w: w.rlike(r"^\p{Ll}"))
    return (line != "") & (line.startswith("#") | titled)


def joined_by_space(previous: Column, following: Column) -> Column:
    """Whether two texts run on: not before a heading; before a lower-case letter, or if no sentence ends."""
    open_end = ~F.right(previous, F.lit(1)).isin(*SENTENCE_ENDS)
    return (previous != "") & (following != "") & ~starts_heading(following) & (following.rlike(r"^\p{Ll}") | open_end)


# Model output

def clean_ocr(c: Column, prompt: str) -> Column:
    """Recognised text without the echoed prompt and control spans."""
    text = F.regexp_replace(strip(c), r"^(?U)[^\S\n]*<image>[^\S\n]*(\n|$)", "")
    echoed = F.lower(F.get(F.split(text, "\n"), F.lit(0)))
    is_echo = F.contains(echoed, F.lit("convert")) & (F.contains(echoed, F.lit("markdown")) | F.contains(echoed, F.lit("document")))
    text = strip(F.when(is_echo, F.regexp_replace(text, r"^[^\n]*(\n|$)", "")).otherwise(text))
    for span in (r"(?s)<\|ref\|>.*?<\|/ref\|>", r"(?s)<\|det\|>.*?<\|/det\|>", r"<\|[^>]+?\|>"):
        text = F.regexp_replace(text, span, "")
    return strip(F.replace(text, F.lit(prompt), F.lit("")))


def clean_translation(c: Column, reasoning_model: bool = False) -> Column:
    """Model output without end marks (and reasoning); if nothing is left, as it was."""
    text = F.regexp_replace(F.regexp_replace(strip(c), r"(?is)(?:<end_of_turn>\s*)+", ""), r"(?is)(?:<\|im_end\|>\s*)+", "")
    text = strip(F.replace(text, F.lit("<|eot_id|>"), F.lit("")))
    if reasoning_model:
        text = strip(F.regexp_replace(text, r"(?is)<think>.*?</think>\s*", ""))
    return F.when(text != "", text).otherwise(c)


def banned_tokens(ids: Column, n: int, window: int, allowed: list[int] | None = None) -> Column:
    """Tokens that would repeat an n-gram of the trailing window."""

    def within(tail: Column) -> Column:
        size = F.size(tail)
        prefix = F.slice(tail, F.greatest(size - (n - 2), F.lit(1)), F.lit(n - 1))
        starts = F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))
        same = F.filter(starts, lambda i: F.slice(tail, i + 1, F.lit(n - 1)) == prefix) if n > 1 else starts
        found = F.transform(same, lambda i: F.get(tail, i + (n - 1)))
        return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, allowed or [])).cast("array<int>")))

    return bound(ids, lambda x: bound(F.slice(x, F.greatest(F.size(x) - (window - 1), F.lit(1)), F.lit(window)), within))
