"""Markdown as HTML: headings, paragraphs, lists, tables, fenced code, quotes and markup that is HTML already."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)(?:\s+#+)?\s*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([\w+-]*)")
_ITEM = re.compile(r"^( *)(?:[-*+]|(\d+)[.)])\s+(.*)$")
_RULE = re.compile(r"^ {0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
_DASHES = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_MARKUP = re.compile(r"^ {0,3}<(?:!--|/?[a-zA-Z][\w-]*[\s/>])")
_INLINE = re.compile(
    r"(?P<code>`+)(?P<coded>.+?)(?P=code)(?!`)|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]+)[^)]*\)|\[(?P<label>[^\]]*)\]\((?P<href>[^)\s]+)[^)]*\)"
    r"|\\(?P<plain>[\\`*_{}\[\]()#+.!|-])|(?P<tag><!--.*?-->|</?[a-zA-Z][^<>]*>)|(?P<bold>\*\*|__)(?=\S)(?P<strong>.+?)(?<=\S)(?P=bold)|\*(?=\S)(?P<em>[^*]+?)(?<=\S)\*",
    re.S,
)


def inline(text: str) -> str:
    """Code, images, links, escapes, tags and emphasis within a block; the rest is escaped."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(html.escape(text[at : m.start()], quote=False))
        at = m.end()
        if m["code"]:
            out.append(f"<code>{html.escape(m['coded'].strip(), quote=False)}</code>")
        elif m["src"]:
            out.append(f'<img alt="{html.escape(m["alt"])}" src="{html.escape(m["src"])}" />')
        elif m["href"]:
            out.append(f'<a href="{html.escape(m["href"])}">{inline(m["label"])}</a>')
        elif m["plain"]:
            out.append(html.escape(m["plain"], quote=False))
        elif m["tag"]:
            out.append(m["tag"])
        elif m["bold"]:
            out.append(f"<strong>{inline(m['strong'])}</strong>")
        else:
            out.append(f"<em>{inline(m['em'])}</em>")
    out.append(html.escape(text[at:], quote=False))
    return "".join(out)


def _cells(row: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", row.strip().removeprefix("|").removesuffix("|"))]


def _table(lines: list[str]) -> str:
    head, sides = _cells(lines[0]), _cells(lines[1])
    side = [{(True, True): "center", (False, True): "right", (True, False): "left"}.get((s.startswith(":"), s.endswith(":")), "") for s in sides]

    def row(cells: list[str], tag: str) -> str:
        cells = (cells + [""] * len(head))[: len(head)]
        styles = [f' style="text-align: {s}"' if s else "" for s in (side + [""] * len(head))[: len(head)]]
        return "<tr>\n" + "\n".join(f"<{tag}{s}>{inline(c)}</{tag}>" for c, s in zip(cells, styles, strict=True)) + "\n</tr>"

    body = "\n".join(row(_cells(x), "td") for x in lines[2:])
    return f"<table>\n<thead>\n{row(head, 'th')}\n</thead>\n<tbody>\n{body}\n</tbody>\n</table>"


def _list(items: list[tuple[int, bool, list[str]]]) -> str:
    """Items (indent, numbered, lines); deeper ones make lists within the item before."""
    out, at = [], 0
    depth, numbered = items[0][0], items[0][1]
    while at < len(items):
        end = at + 1
        while end < len(items) and items[end][0] > depth:
            end += 1
        inner = f"\n{_list(items[at + 1 : end])}\n" if end > at + 1 else ""
        out.append(f"<li>{inline(chr(10).join(items[at][2]))}{inner}</li>")
        at = end
    tag = "ol" if numbered else "ul"
    return f"<{tag}>\n" + "\n".join(out) + f"\n</{tag}>"


def to_html(text: str | None) -> str:
    """The HTML of a markdown text; null and blank texts give none."""
    lines, out, at = (text or "").replace("\r\n", "\n").split("\n"), [], 0

    def begins(k: int) -> bool:
        x = lines[k]
        return not x.strip() or any(p.match(x) for p in (_HEADING, _FENCE, _ITEM, _RULE, _MARKUP)) or x.lstrip().startswith(">") or is_table(k)

    def is_table(k: int) -> bool:
        return "|" in lines[k] and k + 1 < len(lines) and "|" in lines[k + 1] and bool(_DASHES.match(lines[k + 1]))

    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif m := _FENCE.match(line):
            end = at + 1
            while end < len(lines) and not lines[end].strip().startswith(m[1]):
                end += 1
            kind = f' class="language-{m[2]}"' if m[2] else ""
            code = "".join(f"{x}\n" for x in lines[at + 1 : end])
            out.append(f"<pre><code{kind}>{html.escape(code, quote=False)}</code></pre>")
            at = end + 1
        elif m := _HEADING.match(line):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            at += 1
        elif _RULE.match(line):
            out.append("<hr />")
            at += 1
        elif is_table(at):
            end = at + 2
            while end < len(lines) and "|" in lines[end] and lines[end].strip():
                end += 1
            out.append(_table(lines[at:end]))
            at = end
        elif _MARKUP.match(line):
            end = at
            while end < len(lines) and lines[end].strip():
                end += 1
            out.append("\n".join(lines[at:end]))
            at = end
        elif line.lstrip().startswith(">"):
            end = at
            while end < len(lines) and lines[end].strip():
                end += 1
            out.append(f"<blockquote>\n{to_html(chr(10).join(re.sub(r'^ {0,3}> ?', '', x) for x in lines[at:end]))}\n</blockquote>")
            at = end
        elif _ITEM.match(line):
            items: list[tuple[int, bool, list[str]]] = []
            while at < len(lines) and lines[at].strip():
                if m := _ITEM.match(lines[at]):
                    items.append((min(len(m[1]), items[-1][0] + 8) if items else len(m[1]), m[2] is not None, [m[3]]))
                elif _HEADING.match(lines[at]) or _FENCE.match(lines[at]):
                    break
                else:
                    items[-1][2].append(lines[at].strip())
                at += 1
            low = items[0][0]
            out.append(_list([(max(low, d), n, x) for d, n, x in items]))
        else:
            end = at + 1
            while end < len(lines) and not begins(end):
                end += 1
            out.append(f"<p>{inline(chr(10).join(x.strip() for x in lines[at:end]))}</p>")
            at = end
    return "\n".join(out)


def markdown_html(text: Column) -> Column:
    """A markdown column as HTML, in Arrow batches: nested blocks are beyond column expressions."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(to_html, na_action=None).astype(object)

    return convert(text)
