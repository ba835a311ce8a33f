"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector less the centre, scaled to length one, is written in ``CODE_BITS`` or more dimensions, rotated at random
there, and coded by its signs; two scalars go with the bits: the vector's distance to the centre, and the inner product
of the rotated vector with its own code. Together they estimate the inner product with any query without bias, and the
error stays below a bound that shrinks with that inner product and the number of bits (with certainty growing in
``certainty``). Squared distance follows from the inner product, so each code gives an estimate and a lower bound of its
distance to a query. A rotated query is rounded to 4 bits a dimension, so that estimates come from packed bits alone:
four times ANDs and bit counts of 64 dimensions at once. The rounding's error is part of the bound.

A search goes over the index twice, for a block of at most ``BLOCK`` queries at a time. The first pass reads codes, not
vectors, and takes each part's best ``k`` by estimate; the best ``k`` of all parts are joined to their vectors, and the
largest of their true distances is a radius that surely holds ``k`` neighbours. The second pass reranks every vector
whose lower bound is within the radius by its true distance, and no other; the radius shrinks as a part finds nearer
ones. No candidate list is capped. What is broadcast is one block of queries, of bounded size; queries beyond it get
passes of their own.

The index is a table: every vector is coded; the centre is the mean of all. Vectors that are null, empty, zero, of
another length than most, or have null or non-finite components take no part, neither do rows without an id; rows
that repeat an id are neighbours of others each on its own, but not of rows with that id. Ties go to the smaller id.
Other columns aren't read, so they can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.arrow import quoted
from docloom.session import materialise, ship_package

#: Queries in a block; vectors, and queries of the block, whose bounds are computed at once; pairs whose distances are.
BLOCK, CHUNK, QUERIES, PAIRS = 2048, 512, 256, 1 << 16
#: Dimensions of the codes at least, in whole multiples of the vectors'.
CODE_BITS = 512
#: Bits to which a dimension of a rotated query is rounded.
QUERY_BITS = 4
#: The error bound holds for all but about 1 in 2,000 pairs.
CERTAINTY = 3.5


def usable(vector: Column, dim: int) -> Column:
    """A vector of ``dim`` finite numbers that aren't all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0)


def common_dim(vectors: DataFrame, vector_col: str) -> int:
    found = vectors.where(F.size(quoted(vector_col)) > 0).groupBy(F.size(quoted(vector_col)).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0


def rotation(dim: int, bits: int = CODE_BITS, seed: int = 42) -> np.ndarray:
    """A random embedding of ``dim`` dimensions in ``bits`` or a few more of them: rows of a random orthogonal matrix."""
    wide = dim * max(1, -(-bits // dim))
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, dim)))
    return (q * np.sign(np.diag(r))).T


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = CODE_BITS, seed: int = 42) -> tuple[DataFrame, dict]:
    """The written index (id, vector, bits, radius, fit) and what a search needs to know besides."""
    ship_package(vectors.sparkSession)
    dim = common_dim(vectors, vector_col)
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"), dim)) if dim else rows.limit(0)
    means = rows.agg(*[F.avg(F.col("vector")[i].cast("double")) for i in range(dim)]).first() if dim else []
    centre = np.array([x or 0.0 for x in means], np.float64)
    turn = rotation(dim, bits, seed) if dim else np.zeros((0, 0))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = matrix(batch.column(1), dim) - centre
            radius = np.sqrt((off * off).sum(axis=1))
            turned = (off / np.where(radius > 0, radius, 1.0)[:, None]) @ turn
            fit = np.where(radius > 0, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1]), 1.0)
            packed = packed_words(turned > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(radius), pa.array(fit)], names=["id", "vector", "bits", "radius", "fit"])

    kind = dict(vectors.dtypes)[vector_col]
    coded = rows.mapInArrow(code, f"id long, vector {kind}, bits binary, radius double, fit double")
    return materialise(coded, "index"), {"dim": dim, "centre": centre, "turn": turn}


def packed_words(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, filled up with zeros."""
    packed = np.packbits(signs, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class Block:
    """A block of queries and their bounds against batches of codes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, about: dict) -> None:
        self.ids, self.vectors, self.dim = ids, vectors, about["dim"]
        self.wide = about["turn"].shape[1]
        off = vectors - about["centre"]
        self.radius = np.sqrt((off * off).sum(axis=1))
        turned = off @ about["turn"]
        # A dimension is low + step * a whole number; random rounding keeps the sums without bias.
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**QUERY_BITS - 1), 1e-300)
        draw = np.random.default_rng(len(ids)).random(turned.shape)
        whole = np.minimum(np.floor((turned - self.low[:, None]) / self.step[:, None] + draw), 2**QUERY_BITS - 1).astype(np.uint8)
        self.sums = whole.sum(axis=1, dtype=np.int64)
        self.planes = [packed_words((whole >> j) & 1 > 0) for j in range(QUERY_BITS)]

    def inner(self, bits: np.ndarray) -> np.ndarray:
        """Inner product of rounded queries with codes (64-bit words, a row a vector), in whole numbers of their steps."""
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        both = np.zeros((len(self.ids), len(bits)), np.int64)
        columns = np.ascontiguousarray(bits.T)
        shared = np.empty((min(QUERIES, len(self.ids)), len(bits)), np.uint64)
        for at in range(0, len(self.ids), QUERIES):
            part = both[at : at + QUERIES]
            space = shared[: len(part)]
            for j, plane in enumerate(self.planes):
                counted = np.zeros(part.shape, np.uint16)
                for w, column in enumerate(columns):
                    np.bitwise_and(plane[at : at + QUERIES, w, None], column, out=space)
                    counted += np.bitwise_count(space)
                part += counted.astype(np.int64) << j
        # The sum over signs is twice that over ones, less that over all.
        return self.step[:, None] * (2 * both - self.sums[:, None]) + self.low[:, None] * (2 * ones - self.wide)

    def squares(self, bits: np.ndarray, radius: np.ndarray, fit: np.ndarray, certainty: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimate and lower bound of the squared distance, queries by vectors."""
        root = np.sqrt(self.wide)
        inner = self.inner(bits) / (root * fit)  # with the unit vector, times the query's radius
        code_error = np.sqrt(np.maximum(0.0, 1 - fit * fit)) / fit / np.sqrt(max(1, self.wide - 1))
        round_error = self.step / 2 / self.radius.clip(1e-300)  # of a dimension at random rounding, at most
        loose = np.sqrt(code_error**2 + (round_error[:, None] / fit) ** 2)
        whole = self.radius[:, None] ** 2 + radius**2
        estimate = whole - 2 * radius * inner
        return estimate, estimate - 2 * radius * certainty * self.radius[:, None] * loose - 1e-9 * whole

    def distances(self, q: np.ndarray, v: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """True distances of pairs, summed dimension by dimension."""
        out = np.empty(len(q))
        for at in range(0, len(q), PAIRS):
            a, b = self.vectors[q[at : at + PAIRS]], vectors[v[at : at + PAIRS]]
            total = np.zeros(len(a))
            for d in range(self.dim):
                step = a[:, d] - b[:, d]
                total += step * step
            out[at : at + PAIRS] = np.sqrt(total)
        return out


class Best:
    """The ``k`` best (distance, id) of each query so far; of equal ones the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.q, self.id, self.distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.queries = queries

    def add(self, q: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        q, ids, distance = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.distance, distance)))
        order = np.lexsort((ids, distance, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(self.queries))
        keep = np.arange(len(q)) - first[q] < self.k
        self.q, self.id, self.distance = q[keep], ids[order][keep], distance[order][keep]

    def limits(self) -> np.ndarray:
        """The k-th distance of each query, infinite where there are fewer."""
        out = np.full(self.queries, np.inf)
        sizes = np.bincount(self.q, minlength=self.queries)
        ends = np.cumsum(sizes)
        full = sizes == self.k
        out[full] = self.distance[ends[full] - 1]
        return out


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """id, code, radius and fit of a batch that begins with these columns."""
    bits = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
    return batch.column(0).to_numpy(), bits, batch.column(2).to_numpy(), batch.column(3).to_numpy()


def _nearest_by_estimate(index: DataFrame, block: Block, k: int, certainty: float) -> DataFrame:
    """Query number, id and estimate of each part's ``k`` best. Vectors aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.ids), k)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                ids, bits, radius, fit = _codes(whole.slice(at, CHUNK))
                estimate, _ = block.squares(bits, radius, fit, certainty)
                estimate[block.ids[:, None] == ids] = np.inf
                n = min(k, len(ids))
                v = np.argpartition(estimate, n - 1, axis=1)[:, :n].ravel()
                q = np.repeat(np.arange(len(block.ids)), n)
                found = np.isfinite(estimate[q, v])
                best.add(q[found], ids[v[found]], estimate[q[found], v[found]])
        yield pa.RecordBatch.from_arrays([pa.array(best.q), pa.array(best.id), pa.array(best.distance)], names=["q", "id", "distance"])

    return index.select("id", "bits", "radius", "fit").mapInArrow(run, "q long, id long, distance double")


def _true_radii(index: DataFrame, near: DataFrame, block: Block, k: int) -> np.ndarray:
    """The largest true distance of the ``k`` rows (q, id) of each query, infinite where there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(0).to_numpy()
            distance = block.distances(q, np.arange(len(q)), matrix(batch.column(1), block.dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(distance)], names=["q", "distance"])

    wanted = F.broadcast(near.select("q", "id").distinct())  # at most BLOCK * k rows
    met = index.select("id", "vector").join(wanted, "id").select("q", "vector").mapInArrow(run, "q long, distance double")
    radii = np.full(len(block.ids), np.inf)
    for r in met.groupBy("q").agg(F.max("distance").alias("far"), F.count("*").alias("n")).where(F.col("n") >= k).collect():  # a row a query of the block
        radii[r["q"]] = r["far"]
    return radii


def _within(index: DataFrame, block: Block, k: int, certainty: float, radii: np.ndarray) -> DataFrame:
    """Query number, id and true distance of each part's ``k`` best within the radii, and how many vectors were reranked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.ids), k)
        tried = np.zeros(len(block.ids), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                ids, bits, radius, fit = _codes(batch)
                _, lower = block.squares(bits, radius, fit, certainty)
                limit = np.minimum(radii, best.limits())
                q, v = np.nonzero((lower <= (limit * limit)[:, None] * (1 + 1e-9)) & (block.ids[:, None] != ids))
                if not len(q):
                    continue
                tried += np.bincount(q, minlength=len(tried))
                used, place = np.unique(v, return_inverse=True)
                vectors = matrix(batch.column(4).take(pa.array(used)), block.dim)
                best.add(q, ids[v], block.distances(q, place, vectors))
        first = np.r_[True, best.q[1:] != best.q[:-1]] if len(best.q) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(best.q), pa.array(best.id), pa.array(best.distance), pa.array(np.where(first, tried[best.q], 0))], names=["q", "id", "distance", "tried"])

    return index.select("id", "bits", "radius", "fit", "vector").mapInArrow(run, "q long, id long, distance double, tried long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, about: dict, queries: DataFrame, k: int = 10, certainty: float = CERTAINTY, block_rows: int = BLOCK, reranked: bool = False) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``score`` (Euclidean distance) of each query's neighbours.

    ``queries`` has id and vector as the index has them. Their blocks are read one after the other. With ``reranked``
    there is also the number of vectors whose true distance was computed for the query in the second pass.
    """
    spark = index.sparkSession
    ordered = queries.select("id", "vector").orderBy("id")
    numbered = materialise(ordered.withColumn("n", F.monotonically_increasing_id()), "queries")
    parts = numbered.groupBy(F.shiftright("n", 33).alias("part")).agg(F.min("n").alias("first"), F.count("*").alias("count")).orderBy("part").collect()
    starts, before = [], 0
    for r in parts:  # a block may span parts: numbers grow from part to part
        starts += range(r["first"] + -before % block_rows, r["first"] + r["count"], block_rows)
        before += r["count"]
    done = []
    for start, end in zip(starts, [*starts[1:], None]):
        inside = F.col("n") >= start if end is None else (F.col("n") >= start) & (F.col("n") < end)
        rows = numbered.where(inside).orderBy("n").collect()
        block = Block(np.array([r["id"] for r in rows], np.int64), np.array([r["vector"] for r in rows], np.float64), about)
        near = _top(_nearest_by_estimate(index, block, k, certainty), k)
        radii = _true_radii(index, near, block, k)
        names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(block.ids)], "q long, query_id long")
        within = _within(index, block, k, certainty, radii)
        if reranked:
            within = within.withColumn("tried", F.sum("tried").over(Window.partitionBy("q")))
        found = _top(within, k).join(F.broadcast(names), "q")  # at most BLOCK rows
        columns = ["query_id", F.col("rank").cast("int").alias("rank"), "id", F.col("distance").alias("score"), *["tried"] * reranked]
        done.append(materialise(found.select(*columns), "neighbours"))
    out = spark.createDataFrame([], "query_id long, rank int, id long, score double" + ", tried long" * reranked)
    for part in done:
        out = out.union(part)
    return out


def op7_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of every vector whose id is divisible by 100."""
    index, about = build_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = search(index, about, index.where(F.col("id") % 100 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP7_SQL = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
