"""Near-duplicates by SimHash fingerprints, found with BK-trees.

A fingerprint has 64 bits, each the majority of that bit over the hashes of a text's word shingles. Two fingerprints
link if they differ in at most ``radius`` bits, and documents belong together if a chain of links joins them.

Equal fingerprints are one node. Nodes are dealt to shards by whole blocks of bits: with ``radius + g`` blocks, two
linked fingerprints agree in at least ``g`` of them, so each pair meets in the shard of some choice of ``g`` blocks.
A shard with more than four times ``SHARD`` nodes is dealt again by blocks of its remaining bits, which loses no pair for
the same reason. In each shard a BK-tree (children keyed by their Hamming distance to the parent) takes the nodes one by
one: a search follows only edges within the radius, skips subtrees that already belong to the searching node's
component, and reports a link only if it joins two components, so a group of m near copies gives m - 1 links.
A shard of up to ``TREE`` nodes is one tree, built where the shuffle brings its nodes: all trees together grow with the
corpus, so they can't be broadcast. What is still larger, a crowd of fingerprints that agree in most bits, is cut into
chunks by hash. Its trees are a written table, one row a chunk, which is joined to the chunks that search them: Spark
broadcasts that table if its exact size is below the session's limit, and shuffles it otherwise. So every crowd's tree
meets every chunk of it, no task holds more than two chunks, and links of a chunk count once for each component they
reach in a tree.

One fingerprint misses near copies by chance, as its bits differ in more places the fewer shingles two texts share.
With ``prints`` above one, each text gets so many independent fingerprints, made from the same hashes mixed anew, and
a link in any of them counts. The first is always the plain one.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; with fewer words than a
shingle the whole sequence is the shingle; null ids count as larger than all ids; repeated rows share a component;
an empty table gives an empty result. Only named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.arrow import arrow_column, quoted
from docloom.llm.components import component_roots
from docloom.session import materialise

BITS, SEED = 64, 42
#: A shard is meant to hold so many nodes; the number of blocks follows from it.
SHARD = 256
#: A tree has about so many nodes at most.
TREE = 1 << 16
#: Shingles whose bits are counted at once.
COUNTED = 1 << 14


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another set of hashes from the given ones, by the mixing steps of SplitMix64; turn 0 leaves them."""
    if not turn:
        return hashes
    z = hashes + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << BITS) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), COUNTED):
        ones += np.unpackbits(hashes[i : i + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words_per_shingle: int = 4, prints: int = 1) -> tuple[int, ...]:
    """The fingerprints of a UTF-8 text; A-Z count as a-z, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return (0,) * prints
    n = max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        sizes = list(map(len, words))
        starts = list(accumulate([0, *sizes[: n - 1]], lambda at, size: at + size + 1))
        length = sum(sizes[:words_per_shingle]) + words_per_shingle - 1
        lengths = accumulate((b - a for a, b in zip(sizes, sizes[words_per_shingle:])), initial=length)
        hashes = np.array([digest(joined[s : s + k], SEED) for s, k in zip(starts, lengths)], np.uint64)
    return tuple(_majority(_mixed(hashes, turn)) for turn in range(prints))


def fingerprints_of(text: Column, words_per_shingle: int = 4, prints: int = 1) -> Column:
    """The fingerprints of a text as an array of signed longs."""

    def kernel(texts: pa.Array) -> pa.Array:
        found = [fingerprint(x or b"", words_per_shingle, prints) for x in texts.cast(pa.binary()).to_pylist()]
        values = np.array(found, np.uint64).reshape(-1).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, prints, dtype=np.int32)), pa.array(values))

    return arrow_column([text], T.ArrayType(T.LongType()), kernel)


def fingerprints(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, words_per_shingle: int = 4, prints: int = 1) -> DataFrame:
    """``carry`` (default: all columns) and ``fps``, the fingerprints as signed longs."""
    kept = [c for c in (docs.columns if carry is None else carry) if c != "fps"]
    return docs.select(*map(quoted, kept), fingerprints_of(quoted(text_col), words_per_shingle, prints).alias("fps"))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(bits: list[int], blocks: int, chosen: int) -> list[int]:
    """Masks of every choice of ``chosen`` out of ``blocks`` nearly equal runs of the given bit positions."""
    cuts = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    runs = [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(runs, chosen)]


def blocks_for(nodes: int, radius: int) -> tuple[int, int]:
    """Blocks, and how many of them name a shard, for shards of about SHARD nodes."""
    chosen = 1
    while chosen < 3 and nodes / 2 ** (BITS * chosen / (radius + chosen)) > SHARD:
        chosen += 1
    return radius + chosen, chosen


class Tree:
    """A BK-tree over fingerprints that knows which of its nodes a chain of links joins."""

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.up: list[int] = []  # union-find over nodes
        self.whole: list[int] = []  # a node of the one component that holds the subtree, or -1

    def component(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def add(self, x: int) -> list[int]:
        """Insert ``x``; the values to which it links, one for each component that it joins."""
        values, children, whole, radius = self.values, self.children, self.whole, self.radius
        me = len(values)
        links = []
        values.append(x)
        children.append({})
        self.up.append(me)
        whole.append(me)
        stack = [0] if me else []
        while stack:
            i = stack.pop()
            if whole[i] >= 0 and self.component(whole[i]) == self.component(me):
                continue
            d = (values[i] ^ x).bit_count()
            if d <= radius and (a := self.component(i)) != (b := self.component(me)):
                self.up[b] = a
                links.append(values[i])
            below = children[i]
            if len(below) > 2 * radius + 1:
                stack += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
            else:
                stack += [j for e, j in below.items() if -radius <= e - d <= radius]
        i = 0
        while i != me:
            if whole[i] >= 0 and self.component(whole[i]) != self.component(me):
                whole[i] = -1
            i = children[i].setdefault((values[i] ^ x).bit_count(), me)
        return links


    def reached(self, x: int) -> list[int]:
        """The values within the radius of ``x``, one for each component; ``x`` isn't inserted."""
        values, children, whole, radius = self.values, self.children, self.whole, self.radius
        links, seen = [], set()
        stack = [0] if values else []
        while stack:
            i = stack.pop()
            if whole[i] >= 0 and self.component(whole[i]) in seen:
                continue
            d = (values[i] ^ x).bit_count()
            if d <= radius and (a := self.component(i)) not in seen:
                seen.add(a)
                links.append(values[i])
            stack += [j for e, j in children[i].items() if -radius <= e - d <= radius]
        return links


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _chunk_links(radius: int):
    """From (p, nodes of a tree, nodes of a chunk or null): links inside the tree, or of the chunk's nodes with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                p, tree, us, vs = batch.column(0)[at].as_py(), Tree(radius), [], []
                nodes, searching = (batch.column(c)[at].values for c in (1, 2))
                for x in nodes.to_numpy().view(np.uint64).tolist():
                    for y in tree.add(x):
                        if searching is None:
                            us.append(x)
                            vs.append(y)
                for x in [] if searching is None else searching.to_numpy().view(np.uint64).tolist():
                    for y in tree.reached(x):
                        us.append(x)
                        vs.append(y)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(us), pa.int32()), _longs(us), _longs(vs)], names=["p", "u", "v"])

    return run


def _crowd_links(crowded: DataFrame, order: list[str], radius: int) -> DataFrame:
    """Links inside shards of more than TREE nodes, from (order, fp, chunk)."""
    trees = materialise(crowded.groupBy(*order, "chunk").agg(F.collect_list("fp").alias("nodes")), "trees")  # about TREE nodes each
    inside = trees.select("p", "nodes", F.lit(None).cast("array<bigint>").alias("searching"))
    other = trees.select(*order, F.col("chunk").alias("later"), F.col("nodes").alias("searching"))
    across = trees.join(other, order).where(F.col("chunk") < F.col("later")).select("p", "nodes", "searching")
    return inside.union(across).mapInArrow(_chunk_links(radius), "p int, u long, v long")


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns - 1))))
            ps, us, vs = [], [], []
            for key, x in zip(keys, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64).tolist()):
                if key != shard:
                    shard, tree = key, Tree(radius)
                for y in tree.add(x):
                    ps.append(key[0])
                    us.append(x)
                    vs.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), _longs(us), _longs(vs)], names=["p", "u", "v"])

    return run


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """From distinct (p, fp): links (p, u, v) that join the same components as all pairs within the radius, print by print."""
    about = nodes.agg(F.count("*").alias("n"), F.max("p").alias("last")).first()
    blocks, chosen = blocks_for(about["n"] // ((about["last"] or 0) + 1), radius)
    masks = block_masks(list(range(BITS)), blocks, chosen)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]))
    dealt = nodes.select("p", "fp", tables.alias("s")).select("p", "s.t", "s.key", "fp")
    shard = ["p", "t", "key"]
    large = materialise(dealt.groupBy(*shard).count().where(F.col("count") > 4 * SHARD).select(*shard, F.lit(True).alias("large")), "large-shards")

    again = F.lit(None)
    for t, mask in enumerate(masks):
        rest = block_masks([b for b in range(BITS) if not mask >> b & 1], radius + 1, 1)
        parts = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(rest)])
        again = F.when(F.col("t") == t, parts).otherwise(again)
    order = [*shard, "i", "part"]
    redealt = dealt.join(large, shard, "left_semi").select(*shard, "fp", F.explode(again).alias("s")).select(*shard, "s.i", "s.part", "fp")
    crowds = None
    if large.limit(1).count():
        chunks = F.ceil(F.count("*") / TREE).cast("int")
        crowds = materialise(redealt.groupBy(*order).agg(chunks.alias("chunks")).where("chunks > 1"), "crowds")

    alone = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("part")))
    placed = dealt.join(large, shard, "left").select(*shard, "fp", F.explode(F.when(F.col("large"), again).otherwise(alone)).alias("s"))
    placed = placed.select(*shard, F.col("s.i").alias("i"), F.col("s.part").alias("part"), "fp")
    if crowds is None or not crowds.limit(1).count():
        return placed.repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(_shard_links(radius), "p int, u long, v long")
    fitting = placed.join(crowds, order, "left_anti").repartition(*order).sortWithinPartitions(*order, "fp")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk")
    return fitting.mapInArrow(_shard_links(radius), "p int, u long, v long").union(_crowd_links(redealt.join(crowds, order).select(*order, "fp", chunk), order, radius))


def _node_links(values: DataFrame, radius: int) -> DataFrame:
    """Links between nodes from their distinct fingerprints (node, p, fp): by equal ones and by those within the radius.

    Of the nodes that share a fingerprint the smallest stands for all, so m of them give m - 1 links.
    """
    standing = materialise(values.groupBy("p", "fp").agg(F.min("node").alias("node")), "standing")
    equal = values.select("p", "fp", F.col("node").alias("u")).join(standing.withColumnRenamed("node", "v"), ["p", "fp"]).select("u", "v")
    near = materialise(links(standing.select("p", "fp"), radius), "near")
    for end in ("u", "v"):
        near = near.join(standing.select("p", F.col("fp").alias(end), F.col("node").alias(f"{end}_node")), ["p", end])
    return equal.unionByName(near.select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))).where("u <> v")


def components(rows: DataFrame, radius: int = 4, id_col: str = "doc_id", fps_col: str = "fps", prints: int = 1) -> DataFrame:
    """Of rows with ``prints`` fingerprints each: ``fp``, ``root``, ``component_id``: for each distinct first fingerprint its component and the smallest id in it."""
    first = F.get(quoted(fps_col), F.lit(0))
    nodes = materialise(rows.groupBy(first.alias("fp")).agg(F.min(quoted(id_col)).alias("first_id")), "fingerprints")
    if prints == 1:  # a node is its fingerprint
        near = links(nodes.select(F.lit(0).alias("p"), "fp"), radius).select("u", "v")
    else:
        each = rows.select(first.alias("node"), F.posexplode(quoted(fps_col)).alias("p", "fp")).distinct()
        near = _node_links(materialise(each, "prints"), radius)
    roots = component_roots(near)
    placed = nodes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    placed = materialise(placed, "placed")
    least = materialise(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "least-ids")
    return placed.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words_per_shingle: int = 4, prints: int = 1) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` of every row."""
    rows = materialise(fingerprints(docs, text_col, [id_col], words_per_shingle, prints), "fingerprint-rows")
    found = materialise(components(rows, radius, id_col, prints=prints), "components")
    return rows.withColumn("fp", F.get("fps", F.lit(0))).join(found, "fp").select(quoted(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words_per_shingle: int = 4, prints: int = 1) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays.

    Rows are numbered in a written table, so exactly one stays even where ids repeat or are null.
    """
    carry = docs.columns
    inner = [f"c{i}" for i in range(len(carry))]
    where = dict(zip(carry, inner))
    rows = fingerprints(docs.toDF(*inner), where[text_col], inner, words_per_shingle, prints).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "numbered")
    narrow = rows.select(F.col(where[id_col]).alias("id"), "fps", F.get("fps", F.lit(0)).alias("fp"), "row")
    found = materialise(components(narrow, radius, "id", prints=prints), "components")
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    stay = narrow.join(found, "fp").groupBy("root").agg(F.min(rank).getField("row").alias("row")).select("row")
    return rows.join(stay, "row", "left_semi").select(*[F.col(c).alias(name) for c, name in zip(inner, carry)])


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
