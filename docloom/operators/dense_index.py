"""A stored index for exact nearest vectors by cosine: clusters with radii, of which a query reads those that may matter.

Vectors of length one that lie d apart have the cosine 1 - d * d / 2, and distances obey the triangle inequality: no
vector of a cluster is nearer to a query than the query's distance from the centre less the cluster's radius. Centres are
fitted to at most ``FIT_ROWS`` vectors on the driver; every vector goes to its nearest centre. A cluster's vectors are
kept in blocks of at most ``BLOCK``, in order of their distance from the centre, so a block is a shell, and a query
passes over the shells that are too near to the centre or too far from it.

``top_k`` serves all queries in one plan: a query first meets its nearest clusters that hold k vectors between them, which
gives the score that the k-th best has at least, and then the other clusters that its bound allows. Queries that meet a
cluster travel to it in groups of at most ``GROUP``; nothing but the centres is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom.operators.fusion import DIGITS, ranked
from docloom.session import materialise, scratch, ship_package

FIT_ROWS, PER_CENTRE, CENTRES, ROUNDS = 8192, 1024, 1024, 6
BLOCK, GROUP = 1024, 1024
#: Scores are compared after rounding, and bounds are taken from doubles.
SLACK = 2 * 10.0**-DIGITS


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def centres_of(sample: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """Centres of a sample of unit vectors, of which the whole table has ``n``."""
    k = int(min(CENTRES, len(sample), max(1, n // PER_CENTRE)))
    centres = sample[np.random.default_rng(seed).choice(len(sample), k, replace=False)]
    for _ in range(ROUNDS if k > 1 else 1):
        nearest = np.argmax(sample @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(node_id, vec) of vectors that have a direction: neither null nor empty, no null in them, not zero, finite."""
    kind = "array<float>" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).alias("node_id"), F.col(vector_col).cast(kind).alias("vec"))
    rows = rows.where(F.col("node_id").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.where(F.exists("vec", lambda x: x != 0))


def _by_size(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows, as doubles, of the vectors of each length."""
    sizes = vectors.value_lengths().to_numpy()
    for size in np.unique(sizes):
        where = np.flatnonzero(sizes == size)
        yield where, vectors.take(pa.array(where)).flatten().to_numpy().reshape(len(where), size).astype(np.float64)


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def build(vectors: DataFrame, path: str, id_col: str = "node_id", vector_col: str = "embedding") -> None:
    """The index of all usable vectors; lengths that the sample lacks make one cluster each. Nothing else stays."""
    with scratch(vectors.sparkSession):
        _build(vectors, path, id_col, vector_col)


def _build(vectors: DataFrame, path: str, id_col: str, vector_col: str) -> None:
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, id_col, vector_col)
    counts = {r["size"]: r["n"] for r in rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).collect()}
    drawn = rows.orderBy(F.xxhash64("node_id"), "node_id").limit(FIT_ROWS).select("vec").collect() if counts else []
    by_size = {s: np.array([r["vec"] for r in drawn if len(r["vec"]) == s], np.float64) for s in counts}
    centres = {s: centres_of(units(x), counts[s]) if len(x) else np.zeros((1, s)) for s, x in by_size.items()}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for where, x in _by_size(batch.column(1)):
                apart = _apart(units(x), centres[x.shape[1]])
                cluster[where] = np.argmin(apart, axis=1)
                away[where] = apart[np.arange(len(where)), cluster[where]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(away)], names=["node_id", "vec", "cluster", "away"])

    kind = rows.schema["node_id"].dataType.simpleString()
    placed = materialise(rows.mapInArrow(nearest, f"node_id {kind}, vec {rows.schema['vec'].dataType.simpleString()}, cluster int, away double").withColumn("size", F.size("vec")), "placed-vectors")
    clusters = placed.groupBy("size", "cluster").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    clusters = materialise(clusters, "cluster-sizes")
    shell = F.floor(F.col("away") / (F.col("radius") + 1e-9) * F.ceil(F.col("n") / BLOCK)).cast("int")
    shells = placed.join(clusters.select("size", "cluster", "n", "radius"), ["size", "cluster"]).withColumn("shell", shell)
    shells = shells.drop("n", "radius")
    crowded = shells.groupBy("size", "cluster", "shell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = shells.join(crowded, ["size", "cluster", "shell"]).withColumn("part", F.pmod(F.xxhash64("node_id"), F.col("parts")))
    blocks = dealt.groupBy("size", "cluster", "shell", "part").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.collect_list(F.struct("node_id", "vec")).alias("rows"))
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    listed = [(s, i, c.tolist()) for s, x in centres.items() for i, c in enumerate(x)]
    named = spark.createDataFrame(listed, "size int, cluster int, centre array<double>")
    named.join(clusters, ["size", "cluster"]).write.mode("overwrite").parquet(f"{path}/clusters")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/clusters/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _visits(clusters: dict, k: int, kind: T.DataType):
    """From (query_id, vec, least): the clusters that a query meets. Without ``least`` the nearest that hold k vectors
    between them, with it the others that its bound allows."""
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            for where, x in _by_size(batch.column(1)):
                if x.shape[1] not in clusters:
                    continue
                numbers, centres, n, radius = clusters[x.shape[1]]
                apart = _apart(units(x), centres)
                order = np.argsort(apart, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                first = np.zeros(apart.shape, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                bound = 1 - np.maximum(apart - radius, 0) ** 2 / 2
                asked = np.isnan(least[where])[:, None]
                meets = np.where(asked, first, ~first & (bound >= least[where][:, None] - SLACK))
                i, j = np.nonzero(meets)
                ids = batch.column(0).take(pa.array(where[i])).cast(arrow_kind)
                yield pa.RecordBatch.from_arrays([ids, batch.column(1).take(pa.array(where[i])), batch.column(2).take(pa.array(where[i])), pa.array([x.shape[1]] * len(i), pa.int32()), pa.array(numbers[j], pa.int32()), pa.array(apart[i, j])], names=["query_id", "vec", "least", "size", "cluster", "apart"])

    return run


def _meets(k: int, skip_own: bool):
    """From (rows, low, high, asked): each query's best rows of a block, and those that tie with the last of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, low, high, asked in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                names, queries = block.values.field("node_id"), asked.values.field("query_id")
                apart, least = (asked.values.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("apart", "least"))
                bound = 1 - np.maximum(np.maximum(apart - high, low - apart), 0) ** 2 / 2
                some = np.flatnonzero(~(bound < least - SLACK))  # without a least, all
                x, q = (np.array(v.values.field("vec").flatten(), np.float64).reshape(len(v.values), -1) for v in (block, asked))
                scores = np.round(units(q[some]) @ units(x).T, DIGITS)
                if skip_own:
                    own = np.array(queries.take(pa.array(some)).to_pylist(), object)[:, None] == np.array(names.to_pylist(), object)
                    scores[own] = -np.inf
                if len(names) > k:
                    last = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero((scores >= last) & np.isfinite(scores))
                else:
                    i, j = np.nonzero(np.isfinite(scores))
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(some[i])), names.take(pa.array(j)), pa.array(scores[i, j])], names=["query_id", "node_id", "score"])

    return run


class Search:
    """The ``k`` nearest by cosine of every query (query_id, query_vec), exact, from the index at ``path``."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, k: int, skip_own: bool = False) -> None:
        ship_package(spark)
        self.k, self.skip_own = k, skip_own
        self.blocks = spark.read.parquet(f"{path}/blocks")
        self.clusters = spark.read.parquet(f"{path}/clusters")
        kinds = queries.schema["query_id"].dataType, self.blocks.schema["rows"].dataType.elementType["node_id"].dataType
        self.kind, self.found_kind = kinds[0], f"query_id {kinds[0].simpleString()}, node_id {kinds[1].simpleString()}, score double"
        rows = self.clusters.orderBy("size", "cluster").collect()  # the centres
        self.known = {}
        for size in {r["size"] for r in rows}:
            own = [r for r in rows if r["size"] == size]
            self.known[size] = tuple(np.array([r[c] for r in own]) for c in ("cluster", "centre", "n", "radius"))
        asked = materialise(usable(queries.withColumnRenamed("query_id", "node_id"), "node_id", "query_vec").withColumnRenamed("node_id", "query_id"), "dense-queries")
        self.first = self._visited(asked.withColumn("least", F.lit(None).cast("double")), "first-visits")
        found = materialise(ranked(self._scored(self.first)).where(F.col("rank") <= k), "first-found")
        least = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        least = least.select("query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("least"))
        bounded = asked.join(least, "query_id", "left").select("query_id", "vec", F.coalesce("least", F.lit(-2.0)).alias("least"))
        self.second = self._visited(bounded, "second-visits")
        both = found.select("query_id", "node_id", "score").union(self._scored(self.second))
        self.result = ranked(both).where(F.col("rank") <= k).select("query_id", "node_id", "score", "rank")

    def _visited(self, asked: DataFrame, label: str) -> DataFrame:
        kind = f"query_id {self.kind.simpleString()}, vec {asked.schema['vec'].dataType.simpleString()}, least double, size int, cluster int, apart double"
        return materialise(asked.select("query_id", "vec", "least").mapInArrow(_visits(self.known, self.k + self.skip_own, self.kind), kind), label)

    def _scored(self, visits: DataFrame) -> DataFrame:
        key = ["size", "cluster"]
        groups = visits.groupBy(*key).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
        dealt = visits.join(groups, key).withColumn("g", F.pmod(F.xxhash64("query_id"), F.col("groups")))
        asked = dealt.groupBy(*key, "g").agg(F.collect_list(F.struct("query_id", "vec", "apart", "least")).alias("asked"))
        return self.blocks.join(asked, key).select("rows", "low", "high", "asked").mapInArrow(_meets(self.k, self.skip_own), self.found_kind)

    def share_read(self) -> float:
        """Of all pairs of a query and a vector the share in clusters that the query met."""
        met = self.first.union(self.second).join(self.clusters.select("size", "cluster", "n"), ["size", "cluster"]).agg(F.sum("n")).first()[0] or 0
        asked = self.first.groupBy("size").agg(F.countDistinct("query_id").alias("q")).join(self.clusters.groupBy("size").agg(F.sum("n").alias("n")), "size")
        return met / max(1, asked.agg(F.sum(F.col("q") * F.col("n"))).first()[0] or 0)
