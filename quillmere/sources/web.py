"""Web pages as a source: text of HTML, file links, their kinds and addresses."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# What is no content, and how files are named.
NOISE_TAGS = ("script", "style", "nav", "footer", "header", "iframe", "noscript")
NOISE_NAMES = ("menu", "navbar", "breadcrumb", "sidebar", "footer", "header")
NOISE_IDS = ("menu",)
FILE_LINK = r"""(?i)href=["']([^"']+\.(?:pdf|docx?|xlsx?))["']"""
DECISION_HINTS = ("quyet-dinh", "qd-", "quy-che", "quy-dinh", "thong-tu", "nghi-dinh")
FORM_HINTS = ("don-", "mau-", "bieu-mau", "-don", "mau12", "mau-12")
EXTENSIONS = ("pdf", "docx", "doc", "xlsx", "xls")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Text(HTMLParser):
    """Collects the title and the text outside noise."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.title, self.open, self.noise = [], [], [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            return
        a = dict(attrs)
        bad = tag in NOISE_TAGS or bool({*(a.get("class") or "").split()} & {*NOISE_NAMES}) or a.get("id") in NOISE_IDS
        self.open.append((tag, bad))
        self.noise += bad

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, bad = self.open.pop()
                self.noise -= bad
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "title":
            self.title.append(data)
        elif not self.noise:
            self.lines.append(data)


def extract(html: str | None) -> tuple[str, str]:
    """(title, text); text has one stripped, non-blank line for each text node line."""
    p = _Text()
    p.feed(html or "")
    p.close()
    lines = (x.strip() for x in "\n".join(p.lines).split("\n"))
    return "".join(p.title).strip(), "\n".join(x for x in lines if x)


@F.arrow_udf(StructType([StructField("title", StringType()), StructField("text", StringType())]))
def html_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for x in batches:
        titles, texts = zip(*map(extract, x.to_pylist()), strict=True) if len(x) else ((), ())
        yield pa.StructArray.from_arrays([pa.array(titles, pa.string()), pa.array(texts, pa.string())], ["title", "text"])


def file_kind(name: Column) -> Column:
    has = lambda hints: F.rlike(F.lower(name), F.lit("|".join(hints)))
    return F.when(has(DECISION_HINTS), "decision").when(has(FORM_HINTS), "form").otherwise("unknown")


def extension(content_type: Column, url: Column) -> Column:
    """pdf by content type or the end of the URL, office formats by the end of the URL alone, else html."""
    end = F.lower(F.coalesce(url, F.lit("")))
    out = F.when(F.contains(F.coalesce(content_type, F.lit("")), F.lit("pdf")), "pdf")
    for e in EXTENSIONS:
        out = out.when(F.endswith(end, F.lit(f".{e}")), e)
    return out.otherwise("html")


def absolute(link: Column, base: Column) -> Column:
    """A link that begins with http as it is; any other from the root of its page's site."""
    origin = F.substring_index(base, "/", 3)
    return F.when(F.startswith(link, F.lit("http")), link).when(F.startswith(link, F.lit("/")), F.concat(origin, link)).otherwise(F.concat(origin, F.lit("/"), link))


def file_links(pages: DataFrame) -> DataFrame:
    """(page_id, link, url, kind, extension) of links to files, in order of the page."""
    links = pages.select("page_id", F.col("url").alias("_base"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(FILE_LINK), F.lit(1)))).alias("link"))
    url = absolute(F.col("link"), F.col("_base"))
    return links.select("page_id", "link", url.alias("url"), file_kind(F.col("link")).alias("kind"), extension(F.lit(None).cast("string"), url).alias("extension"))
