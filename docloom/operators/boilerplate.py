"""Headers and footers that repeat, and page numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.functions.fuzzy import Texts, alike_pairs, indel_similarity
from docloom.functions.text import is_page_number, starts_with_page_number, without_page_numbers
from docloom.operators.structure import without
from docloom.session import kept, materialise, ship_package

WINDOW, ALIKE = 3, 80.0
#: Texts of a zone, or of a part of it, that a task compares.
TILE = 256


def zones(nodes: DataFrame, window: int = WINDOW) -> DataFrame:
    """With ``in_header`` and ``in_footer``: whether a node is among the first or last of its page. ``page`` may be null."""
    w = Window.partitionBy("doc_id", "page")
    with_page = nodes.withColumn("page", F.array_min("page_numbers")) if "page" not in nodes.columns else nodes
    return with_page.withColumn("in_header", F.row_number().over(w.orderBy("seq")) <= window).withColumn("in_footer", F.row_number().over(w.orderBy(F.desc("seq"))) <= window)


def stripped(zoned: DataFrame) -> DataFrame:
    """With ``page_number_only``, and texts of headers and footers without a leading page number's kind."""
    margin = (F.col("in_header") & (F.col("type") == S.HEADER)) | (F.col("in_footer") & (F.col("type") == S.FOOTER))
    marked = zoned.withColumn("page_number_only", F.coalesce(margin & is_page_number(F.col("text")), F.lit(False)))
    prefix = margin & ~F.col("page_number_only") & starts_with_page_number(F.col("text"))
    return marked.withColumn("text", F.when(prefix, without_page_numbers(F.col("text"))).otherwise(F.col("text")))


def candidates(zoned: DataFrame) -> DataFrame:
    """(doc_id, zone, node_id, text) of zone nodes with text that aren't pictures or tables."""
    rows = zoned.where(~F.col("type").isin(S.IMAGE, S.TABLE) & (F.length("text") > 0))
    zone = F.filter(F.array(F.when(F.col("in_header"), "header"), F.when(F.col("in_footer"), "footer")), lambda z: z.isNotNull())
    return rows.select("doc_id", "node_id", "text", F.explode(zone).alias("zone"))


def repeated_exact(found: DataFrame) -> DataFrame:
    """(doc_id, zone, node_id) of candidates whose text another candidate of the same document and zone has."""
    key = ["doc_id", "zone", "text"]
    often = found.groupBy(*key).agg(F.countDistinct("node_id").alias("n")).where("n > 1").select(*key)
    return found.join(often, key, "left_semi").select("doc_id", "zone", "node_id")


def _in_zones(alike: float):
    """From (doc_id, zone, text) in order of zones: the rows that are alike to another one of their zone."""

    def found(rows: pa.RecordBatch) -> pa.RecordBatch:
        names: dict = {}
        zone = np.array([names.setdefault(name, len(names)) for name in zip(*(rows.column(i).to_pylist() for i in (0, 1)))])
        starts = np.flatnonzero(np.diff(zone, prepend=-1))
        sizes = np.diff(np.append(starts, len(zone)))
        a = [np.triu_indices(n, 1) for n in sizes.tolist()]
        left, right = (np.concatenate([start + pair[i] for start, pair in zip(starts, a)] + [np.zeros(0, np.int64)]) for i in (0, 1))
        alike_ones = alike_pairs(Texts(rows.column(2).to_pylist()), left, right, alike)
        return rows.take(pa.array(np.union1d(left[alike_ones], right[alike_ones])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            last = (rows.column(0)[-1], rows.column(1)[-1])
            at = rows.num_rows - 1
            while at and (rows.column(0)[at - 1], rows.column(1)[at - 1]) == last:
                at -= 1
            held = rows.slice(at)  # the last zone may go on
            if at:
                yield found(rows.slice(0, at))
        if held is not None:
            yield found(held)

    return run


def _between_tiles(alike: float):
    """From (doc_id, zone, texts, others, same): texts of the one list that are alike to one of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, zone, texts, others, same in zip(*(batch.column(i).to_pylist() for i in range(5))):
                rows = texts if same else texts + others
                n = len(texts)
                left, right = np.triu_indices(n, 1) if same else (x.ravel() for x in np.mgrid[:n, n : len(rows)])
                open_ = np.array([r["open"] for r in rows], bool)
                wanted = open_[left] | open_[right]
                left, right = left[wanted], right[wanted]
                yes = alike_pairs(Texts([r["text"] for r in rows]), left, right, alike)
                out = [rows[i]["text"] for i in np.union1d(left[yes], right[yes]).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(out), batch.schema.field(0).type), pa.array([zone] * len(out), pa.string()), pa.array(out, pa.string())], names=["doc_id", "zone", "text"])

    return run


def alike_texts(texts: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Of different texts (doc_id, zone, text) those of which another one in the zone has at least this Indel ratio.

    A zone of at most ``TILE`` texts is compared in one task, with many others. Of larger ones each text first meets the
    first of those that differ from it in numbers only, which shows most running heads to be alike to another one; what is
    left meets the tiles of the zone whose lengths allow the ratio, two tiles a task, all pairs of which go through their
    characters together. At a ratio of 80 two texts may differ in a fifth of their characters, so texts that are alike
    needn't share any run of three; parts of texts as keys of a join would be of two and name almost all pairs.
    """
    ship_package(texts.sparkSession)
    key = ["doc_id", "zone"]
    texts = materialise(texts.select(*key, "text"), "zone-texts")
    sizes = texts.groupBy(*key).agg(F.count("*").alias("n"))
    kinds = f"doc_id {dict(texts.dtypes)['doc_id']}, zone string, text string"
    small = texts.join(sizes.where((F.col("n") > 1) & (F.col("n") <= TILE)).select(*key), key)
    near = small.repartition(*key).sortWithinPartitions(*key).mapInArrow(_in_zones(alike), kinds)
    large = materialise(texts.join(sizes.where(F.col("n") > TILE).select(*key), key), "large-zones")
    if not large.limit(1).count():
        return near
    skeleton = large.withColumn("skeleton", F.regexp_replace("text", "[0-9]+", "0"))
    first = skeleton.groupBy(*key, "skeleton").agg(F.min("text").alias("first"))
    met = skeleton.join(first, [*key, "skeleton"]).where("text <> first").where(indel_similarity("text", "first") >= alike)
    shown = materialise(met.select(*key, "text", "first"), "shown-alike")
    shown = materialise(shown.select(*key, "text").union(shown.select(*key, "first")).distinct(), "shown-texts")
    # Lengths that allow the ratio are in one bucket or in neighbouring ones.
    bucket = F.floor(F.log(F.length("text").cast("double")) / F.log(F.lit((200 - alike) / alike))).cast("int")
    marked = large.join(shown.withColumn("shown", F.lit(True)), [*key, "text"], "left").select(*key, "text", F.col("shown").isNull().alias("open"), bucket.alias("bucket"))
    parts = marked.groupBy(*key, "bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    dealt = marked.join(parts, [*key, "bucket"]).withColumn("tile", F.pmod(F.xxhash64("text"), F.col("parts")))
    tiles = dealt.groupBy(*key, "bucket", "tile").agg(F.collect_list(F.struct("text", "open")).alias("texts"), F.max("open").alias("open"))
    tiles = materialise(tiles, "zone-tiles")
    one = tiles.select(*key, F.col("bucket").alias("own"), F.col("tile").alias("at"), "texts", F.col("open").alias("some"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    other = tiles.select(*key, "bucket", "tile", F.col("texts").alias("others"), "open")
    two = one.join(other, [*key, "bucket"]).where((F.col("some") | F.col("open")) & ((F.col("own") < F.col("bucket")) | (F.col("at") <= F.col("tile"))))
    same = (F.col("own") == F.col("bucket")) & (F.col("at") == F.col("tile"))
    proved = two.select(*key, "texts", F.when(~same, F.col("others")).alias("others"), same.alias("same")).mapInArrow(_between_tiles(alike), kinds)
    return near.union(shown).union(proved).distinct()


def repeated_alike(found: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(doc_id, zone, node_id) of candidates to which another one in the zone, with another text, is at least so alike."""
    key = ["doc_id", "zone", "text"]
    return found.join(alike_texts(found.select(*key).distinct(), alike), key, "left_semi").select("doc_id", "zone", "node_id")


def remove_repeated(nodes: DataFrame, window: int = WINDOW, alike: float = ALIKE) -> DataFrame:
    """Nodes without repeated headers and footers and without bare page numbers; neighbours are to be linked anew."""
    zoned = materialise(stripped(zones(nodes, window)), "zoned")

    def repeated() -> DataFrame:
        found = materialise(candidates(zoned), "zone-candidates")
        numbers = zoned.where("page_number_only").select("doc_id", "node_id")
        return numbers.union(repeated_exact(found).select("doc_id", "node_id")).union(repeated_alike(found, alike).select("doc_id", "node_id"))

    return without(zoned.select(*nodes.columns), kept(nodes.sparkSession, "repeated", repeated))
