"""Readers of HTML, JSON, CSV, XML and markdown text, and chunkers whose cuts depend on the cuts before."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import text as T

# Tags, selectors and limits of the readers.
DROP_TAGS = {"script", "style", "iframe", "noscript"}
PAGE_DROP_TAGS = DROP_TAGS | {"nav", "footer", "header", "aside", "form", "button", "label", "svg"}
MAIN_CLASSES = ["content", "post-content", "entry-content", "article-content"]
JUNK_LINES = [
    "log in", "sign up", "privacy policy", "cookie policy", "subscribe", "related articles", "follow us on", "more from", "recommended for you",
    "read more", "terms of service", "accessibility",
]
END_MARKERS = ["related topics", "most read", "editors' picks", "footer", "sidebar", "navigation"]
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CHUNK, OVERLAP = 2000, 300


class _Walker(HTMLParser):
    """Collects text runs with the open elements around them; elements in ``drop`` and all inside them are left out."""

    def __init__(self, drop: set[str]):
        super().__init__(convert_charrefs=True)
        self.drop, self.open, self.count = drop, [], 0
        self.runs: list[tuple[str, tuple[int, ...]]] = []
        self.info: dict[int, tuple[str, dict]] = {}
        self.around: dict[int, tuple[int, ...]] = {}
        self.links: list[dict] = []
        self.title, self.description = "", None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = dict(attrs)
        if tag == "meta" and found.get("name") == "description" and self.description is None:
            self.description = found.get("content")
        if tag in VOID_TAGS:
            return
        self.count += 1
        self.around[self.count] = tuple(self.open)
        self.open.append(self.count)
        self.info[self.count] = (tag, found)
        if tag == "a" and found.get("href") and not self._hidden():
            self.links.append({"href": found["href"], "text": "", "at": self.count})

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.info[self.open[i]][0] == tag:
                del self.open[i:]
                return

    def _hidden(self) -> bool:
        return any(self.info[e][0] in self.drop for e in self.open)

    def handle_data(self, data: str) -> None:
        if self._hidden():
            return
        if self.open and self.info[self.open[-1]][0] == "title":
            self.title += data
        self.runs.append((data, tuple(self.open)))
        for link in self.links:
            if link["at"] in self.open:
                link["text"] += data.strip()

    def first(self, *tests) -> int | None:
        """The first element, in document order, that passes the first of the tests that any passes."""
        for test in tests:
            for e, (tag, attrs) in self.info.items():
                if test(tag, attrs):
                    return e
        return None

    def text(self, inside: int | None, strip: bool = True) -> str:
        runs = [r for r, around in self.runs if inside is None or inside in around]
        return "\n".join(r.strip() for r in runs if r.strip()) if strip else "\n".join(runs)


def walked(html: str, drop: set[str]) -> _Walker:
    w = _Walker(drop)
    w.feed(html or "")
    w.close()
    return w


def _has_class(name: str):
    return lambda tag, attrs: name in (attrs.get("class") or "").split()


def read_html(html: str) -> dict[str, Any]:
    """Title, description, links and the text of the first main element, or of the page."""
    w = walked(html, DROP_TAGS)
    tests = [lambda t, a: t == "article", lambda t, a: t == "main", lambda t, a: a.get("role") == "main", _has_class("content"), lambda t, a: a.get("id") == "content", *map(_has_class, MAIN_CLASSES[1:])]
    body = ""
    for test in tests:
        if (e := w.first(test)) is not None:
            body = w.text(e)
            break
    return {"title": w.title or None, "description": w.description, "links": [{"href": x["href"], "text": x["text"]} for x in w.links], "content": body or w.text(None)}


def main_text(html: str) -> str:
    """All text of the first main element of a page, else of the page, without furniture."""
    w = walked(html, PAGE_DROP_TAGS)
    e = w.first(lambda t, a: t == "main", lambda t, a: t == "article", lambda t, a: t == "div" and a.get("id") == "content", lambda t, a: t == "div" and "content" in (a.get("class") or "").split())
    return w.text(e, strip=False)


def readable_lines(text: Column) -> Column:
    """The phrases of a page worth reading, one a line; null for null.

    Phrases are over ten characters between line ends and double spaces. One of under five words with a junk phrase goes.
    At the first phrase with an end marker the page ends if less than 500 characters were kept; later markers come after
    more text, so none of them can end it.
    """
    ends = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    phrases = F.filter(F.transform(F.flatten(F.transform(F.split(text, ends), lambda line: F.split(T.strip(line), "  "))), T.strip), lambda p: F.length(p) > 10)
    holds = lambda p, words: F.lower(p).rlike("|".join(map(re.escape, words)))
    read = lambda lines: F.array_join(F.filter(lines, lambda p: (F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) >= 5) | ~holds(p, JUNK_LINES)), "\n")

    def cut(lines: Column) -> Column:
        marker = F.array_position(F.transform(lines, lambda p: holds(p, END_MARKERS)), True).cast("int")
        head = read(F.slice(lines, F.lit(1), F.greatest(marker - 1, F.lit(0))))
        return F.when((marker > 0) & (F.length(head) < 500), head).otherwise(read(lines))

    return F.element_at(F.transform(F.array(phrases), cut), 1)


def page_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, body``: the readable text of every page; empty for a null page."""
    return map_texts(pages, key, html, "body string", lambda t: [(main_text(t),)]).withColumn("body", readable_lines(F.col("body")))


def json_leaves(text: str) -> list[str]:
    """All strings of a JSON value, depth first; nothing for invalid JSON."""
    try:
        todo = [json.loads(text)]
    except (TypeError, ValueError):
        return []
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict):
            todo.extend(reversed(list(x.values())))
    return out


def json_profile(text: str, most: int = 5) -> str | None:
    """Types and lengths of a JSON value down to a depth, as JSON."""

    def shape(x: Any, depth: int) -> Any:
        if depth >= most:
            return "..."
        if isinstance(x, dict):
            return {"type": "object", "keys": {k: shape(v, depth + 1) for k, v in x.items()}}
        if isinstance(x, list):
            return {"type": "array", "length": len(x), "items": shape(x[0], depth + 1) if x else None}
        return {"type": type(x).__name__}

    try:
        return json.dumps(shape(json.loads(text), 0), sort_keys=True)
    except (TypeError, ValueError):
        return None


def chunk_spans(breaks: list[list[int]], length: int, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Start and end of chunks of at most ``size`` characters; each starts ``overlap`` before the last one's end.

    ``breaks`` are sorted positions of characters to end after, by preference; the last one in the second half of a
    full chunk is where it ends. The overlap is under half of the size, so that every chunk moves on.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("the overlap must be under half of the size")
    start = 0
    while start < length:
        full = start + size
        inner = (at[i - 1] + 1 for at in breaks if (i := bisect_left(at, full)) and at[i - 1] >= start + size // 2)
        end = full if full >= length else next(inner, full)
        yield start, end
        start = end - overlap


def chunk_characters(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The chunks of ``chunk_spans`` that break after newlines, else spaces, trimmed; blank ones are left out. Linear in the text."""
    text = text.replace("\n\n\n", "\n\n")
    breaks = [[m.start() for m in re.finditer(mark, text)] for mark in ("\n", " ")]
    return [body for a, b in chunk_spans(breaks, len(text), size, overlap) if (body := text[a:b].strip())]


def chunk_sentences(sentences: list[str], most: int = 512, overlap: int = 200, count=lambda s: int(len(s.split()) * 1.3)) -> list[str]:
    """Sentences packed up to a number of tokens; the sentences at a chunk's end that fit the overlap open the next."""
    out: list[str] = []
    held: list[tuple[str, int]] = []
    for s in sentences:
        n = count(s)
        if held and sum(k for _, k in held) + n > most:
            out.append(" ".join(x for x, _ in held))
            tail: list[tuple[str, int]] = []
            for x, k in reversed(held):
                if sum(j for _, j in tail) + k > overlap:
                    break
                tail.insert(0, (x, k))
            held = tail
        held.append((s, n))
    return out + [" ".join(x for x, _ in held)] if held else out


#: Texts of a batch whose rows are held at once.
TEXTS = 128


def map_texts(df: DataFrame, key: str, text: str, schema: str, rows) -> DataFrame:
    """Rows made from each text by a Python function: Arrow batches in, batches of a few texts' rows out."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, *[f.split(":")[0].strip().split()[0] for f in _fields(schema)]]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in (frame[start : start + TEXTS] for start in range(0, len(frame), TEXTS)):
                yield pd.DataFrame([(k, *r) for k, t in zip(part[key], part[text], strict=True) for r in rows(t or "")], columns=names)

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {schema}")


def _fields(schema: str) -> list[str]:
    return [f.strip() for f in re.split(r",(?![^<]*>)", schema)]


def html_documents(pages: DataFrame, key: str, html: str) -> DataFrame:
    one = lambda t: [(d["title"], d["description"], len(d["links"]), d["content"])] if (d := read_html(t)) else []
    return map_texts(pages, key, html, "title string, description string, links long, content string", one)


def csv_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Naive CSV as maps: split at commas without quoting, cells trimmed, rows of another width than the header skipped."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != "")
    x = df.select(key, lines.alias("lines")).where(F.size("lines") > 0)
    cells = lambda line: F.transform(F.split(line, ","), lambda c: F.trim(c))
    rows = x.select(key, cells(F.get("lines", F.lit(0))).alias("head"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))).alias("row", "line")).withColumn("cells", cells(F.col("line")))
    return rows.where(F.size("cells") == F.size("head")).select(key, "row", F.map_from_arrays(F.col("head"), F.col("cells")).alias("values"))


def xml_text(text: Column) -> Column:
    """Text between tags, and distinct tags."""
    body = F.array_join(F.filter(F.transform(F.split(F.regexp_replace(text, r"(?s)<\?.*?\?>|<!--.*?-->", ""), r"<[^>]*>"), T.strip), lambda t: t != ""), "\n")
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"<([A-Za-z_][\w.-]*)"), F.lit(1))))
    return F.struct(body.alias("content"), tags.alias("tags"))


def list_items(text: Column, kind: str) -> Column:
    pattern = {"bullet": r"[-*•]", "numbered": r"[0-9]+\.", "checkbox": r"\[[ x]\]"}[kind]
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?m)^[ \t]*{pattern}[ \t]+(.+)"), F.lit(1)), lambda c: F.trim(c))


def code_snippets(text: Column) -> Column:
    """Fenced, inline and HTML code, with its kind."""
    kinds = {"markdown": r"(?s)```\w*\n(.*?)```", "inline": r"(?<!`)`([^`\n]+)`(?!`)", "html": r"(?s)<code[^>]*>(.*?)</code>"}
    return F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), _tag(k)) for k, p in kinds.items()])


def _tag(kind: str):
    return lambda c: F.struct(F.lit(kind).alias("kind"), T.strip(c).alias("code"))
