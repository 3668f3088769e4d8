"""Web pages to sections: one pass over the tags, a section for each heading of the first three levels."""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADINGS = ("h1", "h2", "h3")
BLOCKS = ("p", "li", "div", "dt", "dd", "blockquote", "pre", "details", "h4", "h5", "h6")
SKIPPED = ("style", "script")
VOID = ("img", "br", "hr", "meta", "link", "input", "wbr", "area", "base", "col", "embed", "source", "track")
SPOILER_START, SPOILER_END = "\u27e6", "\u27e7"


class Sections(HTMLParser):
    """Collects (heading, anchor, text, image) rows; ``rows`` are read after ``close``."""

    def __init__(self, title: str, vanilla: bool = False):
        super().__init__(convert_charrefs=True)
        self.vanilla = vanilla
        self.rows: list[dict] = [{"heading": title, "anchor": "", "parts": [], "image": ""}]
        self.hero = ""
        self.skip: list[str] = []  # open tags within one that is left out
        self.heading: list[str] | None = None
        self.row: list[list[str]] | None = None  # cells of an open table row

    def put(self, text: str) -> None:
        if self.heading is not None:
            self.heading.append(text)
        elif self.row is not None:
            if self.row:
                self.row[-1].append(text)
        else:
            self.rows[-1]["parts"].append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        has = {k: v or "" for k, v in attrs}
        if self.skip:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag in SKIPPED or tag == "summary" or (tag == "a" and "toc-anchor" in has.get("class", "").split()):
            self.skip.append(tag)
        elif tag in HEADINGS:
            self.rows.append({"heading": "", "anchor": has.get("id", ""), "parts": [], "image": ""})
            self.heading = []
        elif tag == "details":
            self.put(f" {SPOILER_START} ")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append([])
        elif tag == "li":
            self.put("• ")
        elif tag == "br":
            self.put("\n")
        elif tag == "img" and not self.vanilla:
            src = has.get("src", "").strip()
            if src and not src.startswith("data:") and "/recipe/" not in src and not src.lower().endswith(".svg"):
                self.hero = self.hero or src
                if has.get("alt") and not self.rows[-1]["image"]:
                    self.rows[-1]["image"] = src

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if tag in HEADINGS and self.heading is not None:
            self.rows[-1]["heading"] = " ".join("".join(self.heading).split())
            self.heading = None
        elif tag == "details":
            self.put(f" {SPOILER_END} \n")
        elif tag == "tr" and self.row is not None:
            cells, self.row = [" ".join("".join(c).split()) for c in self.row], None
            self.put(" | ".join(c for c in cells if c) + "\n")
        elif tag in BLOCKS:
            self.put("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.put(data)

    def result(self) -> list[dict]:
        out = []
        for r in self.rows:
            text = re.sub(r" ?\n\s*", "\n", re.sub(r"[^\S\n]+", " ", "".join(r["parts"]))).strip()
            if text or r["anchor"]:
                out.append({"heading": r["heading"], "anchor": r["anchor"], "text": text, "image": r["image"] or self.hero})
        return out


def split(html: str | None, title: str, vanilla: bool = False) -> list[dict]:
    """Sections of one page; broken or missing pages give none."""
    parser = Sections(title, vanilla)
    parser.feed(html or "")
    parser.close()
    return parser.result()


def sections(pages: DataFrame, key: str, html: str = "html", title: str = "title") -> DataFrame:
    """``key, nth, heading, anchor, text, image`` of every section, page by page in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, s["heading"], s["anchor"], s["text"], s["image"]) for k, h, t in zip(f["key"], f["html"], f["title"]) for i, s in enumerate(split(h, t or ""))]
            yield pd.DataFrame(rows, columns=["key", "nth", "heading", "anchor", "text", "image"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"), F.col(title).alias("title"))
    return rows.mapInPandas(run, f"key {kind}, nth int, heading string, anchor string, text string, image string").withColumnRenamed("key", key)


def unescape(text: Column) -> Column:
    """The five predefined entities and the hard space."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def heading(html: Column) -> Column:
    """The first main heading, natively."""
    return unescape(F.regexp_replace(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))


def items(html: Column) -> Column:
    """List items in order, natively."""
    got = F.regexp_extract_all(html, F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))
    return F.transform(got, lambda x: unescape(F.regexp_replace(x, "<[^>]+>", "")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*?href="([^"]*)"'), F.lit(1))


def picture(src: Column) -> Column:
    """A picture worth showing, else the empty string."""
    s = F.trim(F.coalesce(src, F.lit("")))
    return F.when(s.startswith("data:") | s.contains("/recipe/") | F.lower(s).endswith(".svg"), "").otherwise(s)
