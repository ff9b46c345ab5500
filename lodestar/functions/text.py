"""Text functions: chunks, plain text of HTML, FNV-1a, identifiers."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

TARGET, OVERLAP = 180, 30
_SPACE = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    """Split on ASCII white space; trailing empties are dropped, a leading one counts."""
    return F.split(F.regexp_replace(text, _SPACE + "$", ""), _SPACE)


def chunks(docs: DataFrame, slug: Column, text: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Windows of target words, overlap of them shared; ends with the window that reaches the end.

    id, slug, ordinal, text; blank texts have none.
    """
    if target < 1 or not 0 <= overlap < target:
        raise ValueError("target must be positive and overlap within 0..target-1")
    step = target - overlap
    rows = docs.select(slug.alias("slug"), words(F.col(text)).alias("w")).where(F.exists("w", lambda x: x != ""))
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - target) / F.lit(float(step)))).cast("int")
    cut = rows.select("slug", "w", F.posexplode(F.sequence(F.lit(0), last)).alias("ordinal", "k"))
    return cut.select(
        F.concat("slug", F.lit("-chunk-"), F.format_string("%03d", "ordinal")).alias("id"),
        "slug", "ordinal", F.trim(F.array_join(F.slice("w", F.col("k") * step + 1, target), " ")).alias("text"),
    )


_KEEP = {"p", "h1", "h2", "h3", "h4", "li"}
_DROP = {"table", "style", "script", "sup"}
_DROP_CLASSES = {"navbox", "reflist", "reference", "references", "mw-editsection", "toc", "infobox", "metadata"}
_STOP = {"see also", "references", "external links", "further reading", "notes"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Plain(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.now: list[str] | None = None
        self.tag, self.drop, self.over = "", [], False

    def _close(self) -> None:
        if self.now is not None:
            text = " ".join("".join(self.now).split())
            if self.tag.startswith("h") and text.lower() in _STOP:
                self.over = True
            elif text and not self.over:
                self.out.append(text)
            self.now = None

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            if self.now is not None and tag == "br":
                self.now.append(" ")
            return
        classes = set((dict(attrs).get("class") or "").split())
        if self.drop or tag in _DROP or classes & _DROP_CLASSES:
            self.drop.append(tag)
        elif tag in _KEEP:
            self._close()
            self.tag, self.now = tag, []

    def handle_endtag(self, tag):
        if self.drop:
            if tag in self.drop:
                while self.drop.pop() != tag:
                    pass
        elif tag in _KEEP:
            self._close()

    def handle_data(self, data):
        if self.now is not None and not self.drop and not self.over:
            self.now.append(data)


def plain(html: str | None) -> str | None:
    """Headings, paragraphs and list items, apart by blank lines, up to a heading that ends the article."""
    if html is None:
        return None
    p = _Plain()
    p.feed(html)
    p.close()
    p._close()
    return "\n\n".join(p.out)


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(plain, na_action="ignore")


@F.pandas_udf(LongType())
def fnv1a64(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, as a signed long."""

    def one(s: str) -> int:
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return text.map(one, na_action="ignore").astype("Int64")


def qualify(bucket: Column, index: Column) -> Column:
    return F.concat_ws("/", bucket, index)


def unqualify(qualified: Column) -> Column:
    return F.regexp_replace(qualified, "^[^/]*/", "")
