"""Readers: anything that turns files or tables into rows of elements in reading order.

A reader is a function from a DataFrame of documents to a DataFrame of elements; ``Reader`` names that interface, so
that a layout model for PDF can be plugged in where one is installed. Text and HTML readers are built in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.session import ship_package

Reader = Callable[[DataFrame], DataFrame]

#: A page of a plain text has so many lines; a title is at most so long.
PAGE_LINES, TITLE_LENGTH = 20, 60


def line_kind(text: Column) -> Column:
    """A row of a table by its bars; a list item by its mark; a title if short and without an end mark; else narrative text."""
    trimmed = F.trim(text)
    return (
        F.when(trimmed.rlike(r" \| .* \|"), S.TABLE)
        .when(trimmed.rlike(r"^(?:[-*•] |[0-9]+[.)] )"), S.LIST_ITEM)
        .when((F.length(trimmed) <= TITLE_LENGTH) & ~trimmed.rlike(r"[.!?:;,]\z"), S.TITLE)
        .otherwise(S.NARRATIVE)
    )


def text_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One element per line that isn't blank; its parent is the latest title above it.

    Columns: doc_id, seq (the line's number), element_id, parent_id, category, text, page_number. A null text has no
    elements.
    """
    # A document's lines are in its row: their titles are found there, so that no text is shuffled.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    rows = rows.withColumn("kinds", F.transform("lines", lambda x: F.when(F.trim(x) != "", line_kind(x))))
    places = F.filter(F.transform("kinds", lambda k, i: F.when(k == S.TITLE, i)), lambda i: i.isNotNull())
    rows = rows.withColumn("titles", places)
    # Each title is above the lines up to the next one, which included, or up to the end.
    nexts = F.concat(F.slice("titles", 2, F.greatest(F.size("titles") - 1, F.lit(0))), F.array(F.size("lines") - 1))
    below = F.flatten(F.zip_with("titles", nexts, lambda a, b: F.array_repeat(a, b - a)))
    none = F.array_repeat(F.lit(None).cast("int"), F.when(F.size("titles") > 0, F.get("titles", F.lit(0)) + 1).otherwise(F.size("lines")))
    above = F.when(F.size("titles") > 0, F.concat(none, below)).otherwise(none)
    each = rows.withColumn("above", above).select("doc_id", F.posexplode(F.arrays_zip("lines", "kinds", "above")).alias("seq", "line"))
    typed = each.select("doc_id", "seq", F.col("line.lines").alias("text"), F.col("line.kinds").alias("category"), F.col("line.above").alias("above")).where(F.col("category").isNotNull())
    parent = F.when((F.col("category") != S.TITLE) & F.col("above").isNotNull(), F.concat_ws(":", "doc_id", "above"))
    page = (F.floor(F.col("seq") / PAGE_LINES) + 1).cast("int")
    return typed.select("doc_id", "seq", F.concat_ws(":", "doc_id", "seq").alias("element_id"), parent.alias("parent_id"), "category", "text", page.alias("page_number"))


#: What becomes of HTML tags: blocks that start an element of a kind, and containers that make all within them of one.
BLOCKS = {"h1": S.TITLE, "h2": S.TITLE, "h3": S.TITLE, "h4": S.TITLE, "h5": S.TITLE, "h6": S.TITLE, "p": S.NARRATIVE, "li": S.LIST_ITEM, "figcaption": S.CAPTION, "div": S.PLAIN, "td": S.PLAIN, "th": S.PLAIN}
REGIONS = {"nav": S.HEADER, "header": S.HEADER, "footer": S.FOOTER}
IGNORED = {"script", "style", "noscript", "template", "head"}
BREAKS = {"br", "ul", "ol", "article", "section", "main", "body", "tr", "table"}


class _Partitioner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.ignored = 0
        self.regions: list[tuple[str, str]] = []
        self.kind = S.PLAIN
        self.text: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.bold: list[str] = []
        self.anchor: tuple[str, list[str]] | None = None
        self.strong: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            category = self.regions[-1][1] if self.regions else self.kind
            self.rows.append({"category": category, "text": text, "link_texts": [t for t, _ in self.links], "link_urls": [u for _, u in self.links], "emphasized_text_contents": self.bold})
        self.text, self.links, self.bold = [], [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in IGNORED:
            self.flush()
            self.ignored += 1
        elif tag in REGIONS or tag == "div" and "ad" in (dict(attrs).get("class") or "").split():
            self.flush()
            self.regions.append((tag, REGIONS.get(tag, S.HEADER)))
        elif tag in BLOCKS:
            self.flush()
            self.kind = BLOCKS[tag]
        elif tag in BREAKS:
            if tag != "br":
                self.flush()
            self.text.append(" ")
        elif tag == "a":
            self.anchor = (dict(attrs).get("href") or "", [])
        elif tag in ("b", "strong", "em", "i"):
            self.strong = []
        elif tag == "img":
            self.flush()
            self.rows.append({"category": S.IMAGE, "text": dict(attrs).get("alt") or "", "image_path": dict(attrs).get("src"), "link_texts": [], "link_urls": [], "emphasized_text_contents": []})

    def handle_endtag(self, tag: str) -> None:
        if tag in IGNORED:
            self.ignored = max(0, self.ignored - 1)
        elif self.regions and self.regions[-1][0] == tag:
            self.flush()
            self.regions.pop()
        elif tag in BLOCKS or tag in BREAKS:
            self.flush()
            self.kind = S.PLAIN
        elif tag == "a" and self.anchor:
            self.links.append((" ".join("".join(self.anchor[1]).split()), self.anchor[0]))
            self.anchor = None
        elif tag in ("b", "strong", "em", "i") and self.strong is not None:
            if "".join(self.strong).strip():
                self.bold.append(" ".join("".join(self.strong).split()))
            self.strong = None

    def handle_data(self, data: str) -> None:
        if self.ignored:
            return
        self.text.append(data)
        if self.anchor:
            self.anchor[1].append(data)
        if self.strong is not None:
            self.strong.append(data)


def partition_html(html: str) -> list[dict]:
    """The elements of a page in reading order: titles, paragraphs, list items; regions like nav make headers."""
    parser = _Partitioner()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.rows


def html_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per element of a page, as ``text_elements`` has them, with links and emphasised text."""
    ship_package(pages.sparkSession)
    id_kind = dict(pages.dtypes)[id_col]
    schema = f"doc_id {id_kind}, seq int, category string, text string, link_texts array<string>, link_urls array<string>, emphasized_text_contents array<string>, image_path string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                rows = [{"doc_id": i, "seq": n, "image_path": None} | row for i, html in zip(part["doc_id"], part["html"]) if html is not None for n, row in enumerate(partition_html(html))]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "seq", "category", "text", "link_texts", "link_urls", "emphasized_text_contents", "image_path"])

    rows = pages.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html")).mapInPandas(run, schema)
    rows = rows.withColumn("element_id", F.concat_ws(":", "doc_id", "seq"))
    above = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("category") == S.TITLE, F.col("element_id")), ignorenulls=True).over(above)
    inside = ~F.col("category").isin(S.TITLE, S.HEADER, S.FOOTER)
    return rows.withColumn("parent_id", F.when(inside, parent)).withColumn("page_number", F.lit(1))


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files as rows: path, name, directory, content and size."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.regexp_replace("path", "/[^/]*$", "").alias("file_directory"), "content", "length", "modificationTime")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files as elements; the document's id is the file's path."""
    files = read_files(spark, path).select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))
    return text_elements(files)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    files = read_files(spark, path).select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("html"))
    return html_elements(files, "doc_id", "html")


def image_kind(content: Column) -> Column:
    """The MIME type that a picture's first bytes name, else null."""
    start = F.hex(F.substring(content, 1, 12))
    known = {"FFD8FF": "image/jpeg", "89504E47": "image/png", "47494638": "image/gif", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "424D": "image/bmp"}
    found = F.coalesce(*[F.when(start.startswith(begin), kind) for begin, kind in known.items()])
    return F.coalesce(found, F.when(start.rlike("^52494646.{8}57454250"), "image/webp"))


def with_images(elements: DataFrame, files: DataFrame) -> DataFrame:
    """Elements with ``image`` bytes and ``image_kind``: of the file named by image_path, else of inline base64; neither is an error."""
    pictures = files.select(F.col("path").alias("image_path"), F.col("content").alias("from_file"))
    joined = elements.join(pictures, "image_path", "left")
    found = F.coalesce("from_file", F.unbase64("image_base64"))
    missing = F.raise_error(F.concat(F.lit("no image for element "), F.col("element_id")))
    wanted = (F.col("category") == S.IMAGE) & (F.col("image_path").isNotNull() | F.col("image_base64").isNotNull())
    given = F.col("image_mime_type") if "image_mime_type" in elements.columns else F.lit(None).cast("string")
    out = joined.withColumn("image", F.when(wanted, F.coalesce(found, missing.cast("binary")))).drop("from_file")
    return out.withColumn("image_kind", F.when(F.col("image").isNotNull(), F.coalesce(image_kind(F.col("image")), given)))


def unseen(files: DataFrame, seen: DataFrame, key: str = "filename") -> DataFrame:
    """Files whose key hasn't been processed."""
    return files.join(seen.select(key).distinct(), key, "left_anti")


def latest_by_name(files: DataFrame, name: str = "filename", order: str = "seq") -> DataFrame:
    """Of files with one name the last."""
    columns = [c for c in files.columns if c != name]
    return files.groupBy(name).agg(F.max_by(F.struct(*columns), order).alias("f")).select(name, "f.*")
