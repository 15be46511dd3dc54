"""Queries of the text functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans.registry import query
from quire.sources import tables as S
from quire.sources.tables import with_views

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_COMPACT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_CLEAN = (
    r"trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&[a-zA-Z0-9#]+;', ' ', 'g'), "
    r"chr(10) || '|||CELL_BREAK|||' || chr(10), ' '), '[_*`#>\-]+', ' ', 'g'), '\s+', ' ', 'g'))"
)
_INLINE = r"regexp_matches(lower({0}), '<table|<tr|<td|<th|&lt;\s*tr\b')"
_HEAVY = r"(contains(lower({0}), '<table') AND (contains(lower({0}), '<tr') OR regexp_matches(lower({0}), '&lt;\s*tr\b')) AND contains(lower({0}), '</table>'))"
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_TOKENS = "CAST(greatest(1, length({0}) // 4) AS INTEGER)"
_PARAGRAPHS = r"len(list_filter(regexp_split_to_array({0}, '\n\s*\n'), lambda p: regexp_replace(p, '\s+', '', 'g') <> ''))"
#: English test over columns text, clean and found (its words).
_ENGLISH = f"""CASE WHEN {_STRIP.format("text")} = '' THEN true
    WHEN clean = '' OR {_INLINE.format("text")} OR regexp_matches(clean, '[^\\x00-\\x7F]') OR len(found) = 0 THEN false
    WHEN len(found) = 1 THEN list_contains({_LIST(T.ENGLISH_TITLES)}, found[1])
    WHEN len(found) <= 4 THEN len(list_filter(found, lambda w: list_contains({_LIST(T.ENGLISH_HINTS)}, w))) >= 1
    ELSE len(list_filter(found, lambda w: list_contains({_LIST(T.ENGLISH_HINTS)}, w))) >= greatest(2, len(found) // 8) END"""
_FOUND = "regexp_extract_all(lower(clean), '[a-z]+')"
_ABBR = "|".join(map(re.escape, T.ABBREVIATIONS))
_CL = "[''\"”’)\\]}]"
#: Sentences without look-around: the dots of abbreviations are hidden, boundaries marked, and the marks split.
_SENTENCES = (
    "list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({0}, "
    f"'(?i)(^|[^\\p{{L}}])({_ABBR}|\\p{{L}})\\.', '\\1\\2' || chr(1), 'g'), '(?i)(^|[^\\p{{L}}])({_ABBR}|\\p{{L}})\\.', '\\1\\2' || chr(1), 'g'), "
    f"'([.!?]{_CL}*) (\\P{{Ll}})', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda s: replace(s, chr(1), '.'))"
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents")


def _greedy(pieces: str, budget: int) -> str:
    """SQL: strings of a list joined by spaces into parts of at most `budget` tokens."""
    states = f"list_prepend({{'p': CAST([] AS VARCHAR[]), 'n': ''}}, list_transform({pieces}, lambda w: {{'p': CAST([] AS VARCHAR[]), 'n': w}}))"
    step = f"""CASE WHEN a.n <> '' AND (length(a.n) + 1 + length(b.n)) // 4 > {budget} THEN {{'p': list_append(a.p, a.n), 'n': b.n}}
      ELSE {{'p': a.p, 'n': CASE WHEN a.n = '' THEN b.n ELSE a.n || ' ' || b.n END}} END"""
    return f"list_transform([list_reduce({states}, lambda a, b: {step})], lambda z: CASE WHEN z.n <> '' THEN list_append(z.p, z.n) ELSE z.p END)[1]"


_CLAUSES = "string_split(regexp_replace(regexp_replace({0}, '([;:])\\s+', '\\1' || chr(1), 'g'), ',\\s+([A-Z0-9(])', ',' || chr(1) || '\\1', 'g'), chr(1))"


def _parts_of_long(source: str, into: str, budget: int) -> str:
    """CTEs that give `into` (k, i, s, x): the sentence s of `source` (k, i, s) in the list x of parts within the budget."""
    return f"""{into}_c AS (SELECT k, i, s, {_CLAUSES.format("s")} AS c FROM {source}),
{into}_p AS (SELECT *, CASE WHEN {_TOKENS.format("s")} > {budget} THEN {_greedy("c", budget)} ELSE [] END AS pc,
  CASE WHEN {_TOKENS.format("s")} > {budget} THEN {_greedy("list_filter(string_split(s, ' '), lambda w: w <> '')", budget)} ELSE [] END AS pw FROM {into}_c),
{into} AS (SELECT k, i, s, CASE WHEN {_TOKENS.format("s")} <= {budget} THEN [s] WHEN len(c) > 1 AND len(pc) > 0 AND len(list_filter(pc, lambda x: {_TOKENS.format("x")} > {budget})) = 0 THEN pc
  WHEN len(pw) = 0 THEN [s] ELSE pw END AS x FROM {into}_p)"""


def chunks_sql(source: str, budget: int) -> str:
    """CTEs that give `packed` (k, x): the text t of `source` (k, t) in the list x of chunks."""
    return f"""snt AS (SELECT k, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT k, CASE WHEN c = '' THEN [] ELSE {_SENTENCES.replace("{0}", "c")} END AS x FROM (SELECT k, {_COMPACT.format("t")} AS c FROM {source}))),
{_parts_of_long("snt", "lng", budget)},
sts AS (SELECT k, list({{'p': CASE WHEN {_TOKENS.format("s")} > {budget} THEN x ELSE [] END, 'n': CASE WHEN {_TOKENS.format("s")} > {budget} THEN '' ELSE s END, 'cut': {_TOKENS.format("s")} > {budget}}} ORDER BY i) AS xs FROM lng GROUP BY k),
fld AS (SELECT k, list_reduce(list_prepend({{'p': CAST([] AS VARCHAR[]), 'n': '', 'cut': false}}, xs), lambda a, b: CASE
  WHEN b.cut THEN {{'p': list_concat(CASE WHEN a.n <> '' THEN list_append(a.p, a.n) ELSE a.p END, b.p), 'n': '', 'cut': false}}
  WHEN a.n <> '' AND (length(a.n) + 1 + length(b.n)) // 4 > {budget} THEN {{'p': list_append(a.p, a.n), 'n': b.n, 'cut': false}}
  ELSE {{'p': a.p, 'n': CASE WHEN a.n = '' THEN b.n ELSE a.n || ' ' || b.n END, 'cut': false}} END) AS f FROM sts),
packed AS (SELECT k, CASE WHEN {_TOKENS.format("t")} <= {budget} OR f IS NULL OR len(f.p) = 0 AND f.n = '' THEN [t] WHEN f.n <> '' THEN list_append(f.p, f.n) ELSE f.p END AS x FROM {source} LEFT JOIN fld USING (k))"""


@query(f"""
WITH d AS (SELECT *, {_CLEAN.format("text")} AS clean FROM documents),
e AS (SELECT *, {_FOUND} AS found FROM d)
SELECT lang, count(*) AS n_documents, sum({_TOKENS.format("text")})::BIGINT AS n_tokens, sum({_COUNT.format("text", r"[\p{L}\p{N}_]+")})::BIGINT AS n_words,
       sum({_PARAGRAPHS.format("text")})::BIGINT AS n_paragraphs, count(*) FILTER (WHERE {_ENGLISH}) AS n_english,
       sum(length(regexp_replace(text, '\\P{{L}}', '', 'g')))::BIGINT AS n_letters, sum(length(text))::BIGINT AS n_chars
FROM e GROUP BY lang""")
def language_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: text quality by language."""
    c = F.col("text")
    measured = _documents(spark, sf_dir).select(
        "lang",
        T.token_count(c).alias("tokens"),
        T.word_count(c).alias("words"),
        T.paragraph_count(c).alias("paragraphs"),
        T.looks_english(c).alias("english"),
        F.length(F.regexp_replace(c, r"\P{L}", "")).alias("letters"),
        F.length(c).alias("chars"),
    )
    return measured.groupBy("lang").agg(
        F.count("*").alias("n_documents"),
        F.sum("tokens").alias("n_tokens"),
        F.sum("words").alias("n_words"),
        F.sum("paragraphs").alias("n_paragraphs"),
        F.count_if("english").alias("n_english"),
        F.sum("letters").alias("n_letters"),
        F.sum("chars").alias("n_chars"),
    )


@query(f"SELECT doc_id, {_TOKENS.format('text')} AS n_tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query(f"""SELECT doc_id, length(text) AS n_chars, {_COUNT.format("text", r"[\p{L}\p{N}_]+")} AS n_words, {_PARAGRAPHS.format("text")} AS n_paragraphs,
{_COUNT.format("text", r"(?m)^\s{0,3}#{1,6}\s+\S")} AS n_headings, {_COUNT.format("text", r"(?is)<table\b")} + {_COUNT.format("text", r"(?m)^\s*\|.+\|\s*$")} AS n_tables,
{_COUNT.format("text", r"!\[[^\]]*\]\([^)]+\)|\[\[FIGURE_[^\]]+\]\]")} AS n_figures FROM documents""")
def markdown_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id",
        F.length(c).cast("long").alias("n_chars"),
        T.word_count(c).cast("long").alias("n_words"),
        T.paragraph_count(c).cast("long").alias("n_paragraphs"),
        T.heading_count(c).cast("long").alias("n_headings"),
        T.table_mark_count(c).cast("long").alias("n_tables"),
        T.figure_mark_count(c).cast("long").alias("n_figures"),
    )


@query(
    with_views("lines")
    + f""", m AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS md FROM lines GROUP BY doc_id)
SELECT doc_id, {_PARAGRAPHS.format(_STRIP.format("md"))} AS n_paragraphs, {_COUNT.format("md", r"(?m)^\s*[-*+]\s+\S")} AS n_items,
       {_COUNT.format("md", r"(?m)^\s{0,3}#{1,6}\s+\S")} AS n_headings FROM m"""
)
def markdown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = S.lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("md"))
    c = F.col("md")
    return md.select("doc_id", T.paragraph_count(c).cast("long").alias("n_paragraphs"), T.list_item_count(c).cast("long").alias("n_items"), T.heading_count(c).cast("long").alias("n_headings"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '\P{L}', '', 'g')) / length(text) ELSE 0.0 END AS letter_ratio,
CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / length(text) ELSE 0.0 END AS non_ascii_ratio FROM documents""")
def char_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", T.letter_ratio(c).alias("letter_ratio"), T.non_ascii_ratio(c).alias("non_ascii_ratio"))


@query(r"""SELECT doc_id, least(1.0, length(text) / 1200.0::DOUBLE * 0.7 + least(len(regexp_extract_all(text, '[^\s]+')) / (612.0::DOUBLE * 792.0 / 100000.0) / 20.0, 1.0) * 0.3) AS quality FROM documents""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded-text quality on a letter page: length and word density."""
    c = F.col("text")
    density = T.count(c, r"[^\s]+") / F.lit(612.0 * 792.0 / 100000.0)
    return _documents(spark, sf_dir).select("doc_id", F.least(F.lit(1.0), F.length(c) / 1200.0 * 0.7 + F.least(density / 20.0, F.lit(1.0)) * 0.3).alias("quality"))


@query(f"WITH d AS (SELECT *, {_CLEAN.format('text')} AS clean FROM documents), e AS (SELECT *, {_FOUND} AS found FROM d) SELECT doc_id, {_ENGLISH} AS english FROM e")
def looks_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.looks_english(F.col("text")).alias("english"))


@query(f"""WITH d AS (SELECT *, {_CLEAN.format('text')} AS clean, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS language FROM documents),
e AS (SELECT *, {_FOUND} AS found FROM d)
SELECT doc_id, CASE WHEN language = 'en' OR (language IS NULL AND {_STRIP.format("text")} <> '') THEN {_ENGLISH} ELSE false END AS skipped FROM e""")
def skip_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return _documents(spark, sf_dir).select("doc_id", T.skip_translation(F.col("text"), language).alias("skipped"))


@query(f"SELECT page_id, {_CLEAN.format('html')} AS clean FROM pages")
def clean_for_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", T.for_detection(F.col("html")).alias("clean"))


@query(f"SELECT page_id, CASE WHEN length({_CLEAN.format('html')}) >= 24 THEN 'xx' END AS language FROM pages")
def lang_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the strict detector is asked at all."""
    return S.table(spark, sf_dir, "pages").select("page_id", F.when(F.length(T.for_detection(F.col("html"))) >= 24, "xx").alias("language"))


@query(f"""WITH l AS (SELECT doc_id, lang, unnest(x) AS part, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS x FROM documents)),
d AS (SELECT doc_id, pos, part, CASE WHEN doc_id % 4 > 0 THEN lang END AS detected, pos % 5 = 0 AS heading FROM l)
SELECT doc_id, pos, CASE WHEN length({_CLEAN.format("part")}) >= 24 AND detected IS NOT NULL THEN detected
  WHEN heading OR {_INLINE.format("part")} THEN CASE WHEN {_CLEAN.format("part")} <> '' THEN detected END ELSE 'de' END AS language FROM d""")
def chunk_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each line of the documents."""
    rows = _documents(spark, sf_dir).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))
    detected = F.when(F.col("doc_id") % 4 > 0, F.col("lang"))
    return rows.select("doc_id", "pos", T.chunk_language(F.col("part"), detected, F.col("pos") % 5 == 0, F.lit("de")).alias("language"))


@query(r"""WITH c AS (SELECT doc_id, ([' EN', 'pt_BR', 'zh-cn', 'de-at', 'x', 'eng', 'en-GB', 'f1', ''])[(doc_id % 9 + 1)::INT] AS raw FROM documents),
d AS (SELECT doc_id, lower(replace(trim(raw), '_', '-')) AS low FROM c)
SELECT doc_id, CASE low WHEN 'zh-cn' THEN 'zh-CN' WHEN 'zh-tw' THEN 'zh-TW' WHEN 'pt-br' THEN 'pt-BR' WHEN 'pt-pt' THEN 'pt-PT' WHEN 'en-us' THEN 'en-US' WHEN 'en-gb' THEN 'en-GB'
  WHEN 'es-mx' THEN 'es-MX' WHEN 'fr-ca' THEN 'fr-CA' ELSE CASE WHEN regexp_full_match(low, '\p{L}{2}') THEN low
  WHEN regexp_full_match(low, '\p{L}{2}-\p{L}{2}') THEN left(low, 3) || upper(right(low, 2)) END END AS code FROM d""")
def lang_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, (" EN", "pt_BR", "zh-cn", "de-at", "x", "eng", "en-GB", "f1", "")))
    raw = F.element_at(codes, (F.col("doc_id") % 9 + 1).cast("int"))
    return _documents(spark, sf_dir).select("doc_id", T.normalize_language(raw).alias("code"))


# Sentences and chunks


@query(f"""WITH d AS (SELECT doc_id, {_COMPACT.format("text")} AS c FROM documents), s AS (SELECT doc_id, CASE WHEN c = '' THEN [] ELSE {_SENTENCES.replace("{0}", "c")} END AS x FROM d)
SELECT doc_id, unnest(x) AS sentence, generate_subscripts(x, 1) - 1 AS pos FROM s""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH src AS (SELECT doc_id AS k, text AS t FROM documents), {chunks_sql("src", 128)}
SELECT k AS doc_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS chunk FROM packed""")
def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in chunks of 128 tokens, with the sentences split that are longer."""
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(T.chunks(F.col("text"), 128)).alias("pos", "chunk"))


@query(f"""WITH src AS (SELECT doc_id AS k, 1 AS i, {_COMPACT.format("text")} AS s FROM documents), {_parts_of_long("src", "parts", 64)}
SELECT k AS doc_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS part FROM parts""")
def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts taken as one sentence each, in parts of 64 tokens."""
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(T.split_long(T.compact(F.col("text")), 64)).alias("pos", "part"))


@query(f"""WITH src AS (SELECT doc_id AS k, text AS t FROM documents), {chunks_sql("src", 800)},
c AS (SELECT k AS doc_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS chunk_ord, unnest(x) AS text FROM packed),
l AS (SELECT c.*, d.lang AS language, {_CLEAN.format("c.text")} AS clean FROM c JOIN documents d ON d.doc_id = c.doc_id), e AS (SELECT *, {_FOUND} AS found FROM l)
SELECT doc_id, chunk_ord, 'chunk-' || chunk_ord AS id, text AS source_text, {_TOKENS.format("text")} AS n_tokens,
 CASE WHEN language = 'en' OR (language IS NULL AND {_STRIP.format("text")} <> '') THEN {_ENGLISH} ELSE false END AS skipped FROM e""")
def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks with their token counts and whether translation is skipped."""
    parts = _documents(spark, sf_dir).select("doc_id", "lang", F.posexplode(T.chunks(F.col("text"), T.token_budget(F.lit(0)))).alias("chunk_ord", "source_text"))
    c = F.col("source_text")
    return parts.select(
        "doc_id", "chunk_ord", F.concat(F.lit("chunk-"), "chunk_ord").alias("id"), c, T.token_count(c).alias("n_tokens"), T.skip_translation(c, F.col("lang")).alias("skipped")
    )


@query("""SELECT doc_id, CAST(least(greatest(128, CASE WHEN doc_id % 2000 = 0 THEN 1800 ELSE doc_id % 2000 END), 800) AS INTEGER) AS budget FROM documents""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.token_budget((F.col("doc_id") % 2000).cast("int")).alias("budget"))


@query(f"SELECT doc_id, CAST(greatest(2048, least(4096, floor({_TOKENS.format('text')} * 2.2::DOUBLE) + 256)) AS INTEGER) AS budget FROM documents")
def table_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.table_budget(T.token_count(F.col("text")), F.lit(2048)).alias("budget"))


@query(f"SELECT doc_id, CAST(greatest(128, least(2048, floor({_TOKENS.format('text')} * 0.75))) AS INTEGER) AS budget FROM documents")
def output_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.output_budget(T.token_count(F.col("text")), F.lit(2048)).alias("budget"))


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {_STRIP.format("(l || CASE WHEN length(l) % 3 = 0 THEN '-' ELSE '' END)")}), lambda l: l <> '') AS x FROM documents)
SELECT doc_id, {_COMPACT.format("array_to_string(list_transform(x, lambda l, i: CASE WHEN i = len(x) THEN l WHEN suffix(l, '-') THEN left(l, length(l) - 1) ELSE l || ' ' END), '')")} AS joined FROM s""")
def join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a hyphen added to every third length, joined to one paragraph."""
    marked = F.transform(F.split("text", "\n"), lambda x: F.concat(x, F.when(F.length(x) % 3 == 0, "-").otherwise("")))
    return _documents(spark, sf_dir).select("doc_id", T.join_lines(marked).alias("joined"))


# Markup


@query(
    with_views("markup")
    + f"SELECT page_id, {_HEAVY.format('text')} AS heavy, contains(lower(text), '<table') OR (contains(lower(text), '&lt;') AND contains(lower(text), 'table')) AS may_hold_table FROM markup"
)
def table_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return S.markup(spark, sf_dir).select("page_id", T.table_heavy(c).alias("heavy"), T.may_hold_table(c).alias("may_hold_table"))


@query(with_views("markup") + f"SELECT page_id, {_INLINE.format('text')} AS marked FROM markup")
def inline_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.markup(spark, sf_dir).select("page_id", T.inline_markup(F.col("text")).alias("marked"))


_TAGS = ("table", "tr", "td", "th")


@query(with_views("markup") + "SELECT page_id, " + ", ".join(f"{_COUNT.format('text', rf'(?is)<{t}' + chr(92) + 'b')} AS {t}_open, {_COUNT.format('text', f'(?is)</{t}>')} AS {t}_close" for t in _TAGS) + " FROM markup")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return S.markup(spark, sf_dir).select("page_id", *(f(c, t).cast("long").alias(f"{t}_{n}") for t in _TAGS for n, f in (("open", T.tags_opened), ("close", T.tags_closed))))


@query(with_views("markup") + r"SELECT page_id, nullif(regexp_extract(text, '(?is)<table\b.*?</table>'), '') AS first_table FROM markup")
def primary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.markup(spark, sf_dir).select("page_id", T.primary_table(F.col("text")).alias("first_table"))


@query(
    with_views("markup")
    + r""", r AS (SELECT page_id, regexp_extract_all(text, '(?is)<tr\b[^>]*>.*?</tr>') AS x FROM markup)
SELECT page_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS row FROM r"""
)
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.markup(spark, sf_dir).select("page_id", F.posexplode(T.table_rows(F.col("text"))).alias("pos", "row")).withColumn("pos", F.col("pos").cast("long"))


@query()
def normalize_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.markup(spark, sf_dir).select("page_id", T.normalize_table(F.col("text")).alias("normalized"))


_LOST = "CASE WHEN page_id % 2 = 0 THEN replace(text, '<td>B</td>', '') ELSE text END"
_PRIME = r"nullif(regexp_extract({0}, '(?is)<table\b.*?</table>'), '')"


def _pair(tag: str) -> str:
    opened, closed = rf"(?is)<{tag}\b", f"(?is)</{tag}>"
    return f"{_COUNT.format('a', opened)} = {_COUNT.format('b', opened)} AND {_COUNT.format('a', closed)} = {_COUNT.format('b', closed)}"


_CELLS = rf"({_COUNT.format('{0}', chr(40) + '?is)<td' + chr(92) + 'b')} + {_COUNT.format('{0}', chr(40) + '?is)<th' + chr(92) + 'b')})"


@query(
    with_views("markup")
    + f""", t AS (SELECT page_id, text, {_LOST} AS translated FROM markup), p AS (SELECT *, {_PRIME.format("text")} AS a, {_PRIME.format("translated")} AS b FROM t)
SELECT page_id, NOT {_HEAVY.format("text")} OR coalesce(a IS NOT NULL AND b IS NOT NULL AND (NOT suffix(lower({_STRIP.format("text")}), '</table>') OR suffix(lower({_STRIP.format("translated")}), '</table>'))
  AND {_pair("table")} AND {_pair("tr")} AND (({_pair("td")} AND {_pair("th")}) OR {_CELLS.format("a")} = {_CELLS.format("b")}), false) AS valid FROM p"""
)
def valid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables against a translation that loses a cell on even pages."""
    c = F.col("text")
    translated = F.when(F.col("page_id") % 2 == 0, F.replace(c, F.lit("<td>B</td>"), F.lit(""))).otherwise(c)
    return S.markup(spark, sf_dir).select("page_id", T.valid_table(c, translated).alias("valid"))


_CUT = "left(text, (length(text) * (doc_id % 5) // 4)::INT)"


@query(
    f"""WITH t AS (SELECT doc_id, {_STRIP.format("text")} AS s, {_STRIP.format(_CUT)} AS t, doc_id % 7 = 0 AS heading FROM documents)
SELECT doc_id, CASE WHEN s = '' THEN t = '' WHEN t = '' THEN false ELSE NOT (
  (length(s) >= 200 AND length(t) < greatest(40, floor(length(s) * 0.2::DOUBLE)))
  OR ({_PARAGRAPHS.format("s")} >= 3 AND {_PARAGRAPHS.format("t")} < greatest(2, {_PARAGRAPHS.format("s")} // 2))
  OR ({_COUNT.format("s", r"(?m)^\s*[-*+]\s+\S")} > 0 AND {_COUNT.format("t", r"(?m)^\s*[-*+]\s+\S")} < {_COUNT.format("s", r"(?m)^\s*[-*+]\s+\S")})
  OR ({_COUNT.format("s", r"(?m)^\s{0,3}#{1,6}\s+\S")} > 0 AND {_COUNT.format("t", r"(?m)^\s{0,3}#{1,6}\s+\S")} < {_COUNT.format("s", r"(?m)^\s{0,3}#{1,6}\s+\S")})
  OR (heading AND contains(t, chr(10) || chr(10)))) END AS valid FROM t"""
)
def valid_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against a translation that is cut by the document's number."""
    cut = F.left("text", F.floor(F.length("text") * (F.col("doc_id") % 5) / 4).cast("int"))
    return _documents(spark, sf_dir).select("doc_id", T.valid_structure(F.col("text"), cut, F.col("doc_id") % 7 == 0).alias("valid"))


@query(
    with_views("lines")
    + r""", p AS (SELECT doc_id, pos, list_transform(string_split(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^\|+|\|+$', '', 'g'), '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS c
  FROM lines WHERE starts_with(trim(line), '|') AND suffix(trim(line), '|'))
SELECT doc_id, pos, len(c) AS n_cells, array_to_string(c, chr(31)) AS cells, len(list_filter(c, lambda x: regexp_replace(x, '^[-: ]+', '') <> '')) = 0 AS separator FROM p"""
)
def pipe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.lines(spark, sf_dir).where(F.trim("line").startswith("|") & F.trim("line").endswith("|")).select("doc_id", F.col("pos").cast("long"), T.pipe_cells(F.col("line")).alias("c"))
    return rows.select("doc_id", "pos", F.size("c").cast("long").alias("n_cells"), F.array_join("c", "\x1f").alias("cells"), T.is_separator(F.col("c")).alias("separator"))


@query(r"""WITH t AS (SELECT doc_id, lang || chr(10) || '|||CELL_BREAK|||' || chr(10) || source AS s,
  CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE upper(lang) || chr(10) || '|||CELL_BREAK|||' || chr(10) || ' ' || source END AS t, (doc_id % 3 + 1)::INT AS n FROM documents),
p AS (SELECT *, list_transform(string_split(t, chr(10) || '|||CELL_BREAK|||' || chr(10)), lambda x: trim(x)) AS a, list_transform(string_split(s, chr(10) || '|||CELL_BREAK|||' || chr(10)), lambda x: trim(x)) AS b FROM t)
SELECT doc_id, array_to_string(CASE WHEN len(a) = n THEN a WHEN n = 1 THEN [trim(t)] WHEN len(b) = n THEN b ELSE list_concat(b, ['', '', ''])[1:n] END, chr(31)) AS cells FROM p""")
def cell_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.lit(T.CELL_BREAK)
    source = F.concat("lang", gap, "source")
    translated = F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.concat(F.upper("lang"), gap, F.lit(" "), "source"))
    return _documents(spark, sf_dir).select("doc_id", F.array_join(T.split_cells(translated, source, (F.col("doc_id") % 3 + 1).cast("int")), "\x1f").alias("cells"))


@query(r"""SELECT doc_id, '<table class="structured-table">' || chr(10) || '<thead><tr>' || chr(10) || '<th>' || lang || '</th>' || chr(10) || '<th>a\|b</th>' || chr(10) || '</tr></thead>' || chr(10) || '<tbody>' || chr(10) || '<tr>' || chr(10)
 || '<td' || CASE WHEN doc_id % 3 > 1 THEN ' rowspan="' || (doc_id % 3) || '"' ELSE '' END || CASE WHEN doc_id % 4 > 1 THEN ' colspan="' || (doc_id % 4) || '"' ELSE '' END || '>' || trim(replace(replace(text, chr(10), '<br>'), '|', '\|')) || '</td>'
 || chr(10) || '</tr>' || chr(10) || '</tbody></table>' AS html FROM documents""")
def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.struct(F.col("text"), (F.col("doc_id") % 3).cast("int").alias("rowspan"), (F.col("doc_id") % 4).cast("int").alias("colspan"))
    return _documents(spark, sf_dir).select("doc_id", T.table_html(F.array("lang", F.lit("a|b")), F.array(F.array(cell))).alias("html"))


# Model output


@query(r"""WITH t AS (SELECT doc_id, '<image>' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Convert the document' || chr(10) || chr(10) ELSE '' END || '<|ref|>t<|/ref|><|det|>[[1]]<|/det|>' || text || '<|end|> PROMPT' AS raw FROM documents)
SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN substr(raw, 31) ELSE substr(raw, 9) END,
 '(?s)<\|ref\|>.*?<\|/ref\|>', '', 'g'), '(?s)<\|det\|>.*?<\|/det\|>', '', 'g'), '<\|[^>]+?\|>', '', 'g'), '^\s+', ''), 'PROMPT', '') , '^\s+|\s+$', '', 'g') AS clean FROM t""")
def clean_ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    echoed = F.when(F.col("doc_id") % 2 == 0, "Convert the document\n\n").otherwise("")
    raw = F.concat(F.lit("<image>\n"), echoed, F.lit("<|ref|>t<|/ref|><|det|>[[1]]<|/det|>"), F.col("text"), F.lit("<|end|> PROMPT"))
    return _documents(spark, sf_dir).select("doc_id", T.clean_ocr(raw, "PROMPT").alias("clean"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '<end_of_turn> <end_of_turn>' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS clean FROM documents""")
def postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.lit("<end_of_turn> <end_of_turn>")
    raw = F.when(F.col("doc_id") % 4 == 0, marks).otherwise(F.concat(F.lit("<think>why</think> "), F.col("text"), F.lit("<|im_end|><|eot_id|> "), marks))
    return _documents(spark, sf_dir).select("doc_id", T.clean_translation(raw, reasoning_model=True).alias("clean"))


@query(r"""WITH t AS (SELECT doc_id, text || ' [[FIG_1]] [[NOTE_' || (doc_id % 3) || ']] [[FIG_1]]' AS s, text || ' [[FIG_1]] [[X_9]]' AS t FROM documents),
p AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(s, '\[\[[A-Z]+_[A-Z0-9_]+\]\]'))) AS a, list_sort(list_distinct(regexp_extract_all(t, '\[\[[A-Z]+_[A-Z0-9_]+\]\]'))) AS b FROM t)
SELECT doc_id, len(a) AS n_source, len(b) AS n_translated, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS missing, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS extra FROM p""")
def placeholder_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\[\[[A-Z]+_[A-Z0-9_]+\]\])"), 1)))
    source = F.concat("text", F.lit(" [[FIG_1]] [[NOTE_"), F.col("doc_id") % 3, F.lit("]] [[FIG_1]]"))
    found = _documents(spark, sf_dir).select("doc_id", marks(source).alias("a"), marks(F.concat("text", F.lit(" [[FIG_1]] [[X_9]]"))).alias("b"))
    return found.select(
        "doc_id",
        F.size("a").cast("long").alias("n_source"),
        F.size("b").cast("long").alias("n_translated"),
        F.array_join(F.array_except("a", "b"), ",").alias("missing"),
        F.array_join(F.array_except("b", "a"), ",").alias("extra"),
    )


@query(r"""WITH t AS (SELECT doc_id, text AS s, replace(text, 'a', '') || CASE WHEN doc_id % 2 = 0 THEN '<table>```' ELSE '<table></table>' END AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(s, '(?is)<table\b')) AS source_open, len(regexp_extract_all(s, '(?is)</table>')) AS source_close, len(regexp_extract_all(t, '(?is)<table\b')) AS translated_open,
 len(regexp_extract_all(t, '(?is)</table>')) AS translated_close, len(regexp_extract_all(t, '(?is)<table\b')) <> len(regexp_extract_all(t, '(?is)</table>')) AS unclosed,
 CAST((length(t) - length(replace(t, '```', ''))) // 3 AS INTEGER) AS fences FROM t""")
def malformed_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("text")
    t = F.concat(F.replace(s, F.lit("a"), F.lit("")), F.when(F.col("doc_id") % 2 == 0, "<table>```").otherwise("<table></table>"))
    opened, closed = T.tags_opened(t, "table"), T.tags_closed(t, "table")
    return _documents(spark, sf_dir).select(
        "doc_id",
        T.tags_opened(s, "table").cast("long").alias("source_open"),
        T.tags_closed(s, "table").cast("long").alias("source_close"),
        opened.cast("long").alias("translated_open"),
        closed.cast("long").alias("translated_close"),
        (opened != closed).alias("unclosed"),
        T.occurrences(t, "```").alias("fences"),
    )


@query("""WITH t AS (SELECT doc_id, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c) % 7) AS ids FROM documents), n AS (SELECT *, len(ids) AS n FROM t)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(range(greatest(0, n - 50), n - 2), lambda i: ids[i + 1] = ids[n - 1] AND ids[i + 2] = ids[n]), lambda i: ids[i + 3]),
 lambda x: x <> 2))), ',') AS banned FROM n""")
def ngram_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens (code points modulo 7) that would repeat a trigram in a text's last 50."""
    ids = F.transform(F.filter(F.split("text", ""), lambda ch: ch != ""), lambda ch: (F.ascii(ch) % 7).cast("int"))
    return _documents(spark, sf_dir).select("doc_id", F.array_join(T.banned_tokens(ids, 3, 50, [2]).cast("array<string>"), ",").alias("banned"))


@query(r"""WITH p AS (SELECT doc_id, text AS s, lang AS context FROM documents)
SELECT doc_id, length('SYSTEM' || chr(10) || chr(10) || CASE WHEN context <> '' THEN chr(10) || 'SECTION CONTEXT (for terminology only, do not translate this unless it appears in TEXT):' || chr(10) || context || chr(10) ELSE '' END
 || chr(10) || 'TEXT:' || chr(10) || s || chr(10) || chr(10) || 'ENGLISH:') AS n_chars FROM p""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.translation import prompt

    return _documents(spark, sf_dir).select("doc_id", F.length(prompt(F.col("text"), F.col("lang"), "SYSTEM")).cast("long").alias("n_chars"))
