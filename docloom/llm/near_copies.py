"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash name groups, whole sets decide.

Texts with one set of shingles are one node. Two things are looked at: the links of operator 8's BK-trees over the nodes'
fingerprints, and groups of nodes that share a MinHash band. Of ``BANDS`` bands of ``BAND_ROWS`` minima two texts at the
least similarity of 0.8 share none in 3 of a million cases, and more similar ones yet more seldom. Within a group no link
is lost, however many nodes it has.

The smallest node of a group is its centre, and groups of one centre are one crowd. A crowd of at most ``CROWD`` nodes
and ``SHINGLES`` shingles goes to a task with its sets, which finds all links in it. One of at most ``TILED`` nodes is cut into tiles, and each two
tiles are a task, which tells of links between nodes that aren't joined inside a tile. Of a yet larger one all nodes are
first held against the centre, set by set, which costs in proportion to the crowd:

* Let x share i of its shingles with centre c, and let r be its other ones. x links to c if (x + c) 4/9 <= i, for numbers
  of shingles x and c.
* If x doesn't link to c, a link of x to any y of the crowd needs (x + y) 4/9 >= (x + c) 4/9 shared shingles, and at most
  i of them are shingles of c. So k = (x + max(c, 0.8 x)) 4/9 - i >= 1 of them are in both texts' rests, and one is
  among the r - k + 1 first of x's rest in any order.
* Two nodes that both link to c are joined already.

So the next round's groups are those of a centre's nodes that share a shingle of their rests (all of the rest for nodes
that link to the centre, the r - k + 1 first for the others, of which a group holds at least one), unless their nodes are
all joined already. Pages of one template differ in their rests only, so their crowd falls apart; copies of one text
mostly link to the centre. What is still that large after ``ROUNDS`` rounds is cut into tiles too.

What moves: bands; sets of shingles, made once, of nodes that share a band with another or hang in a tree with one, to
their crowds; and the rests of nodes that go on. Texts are written once, with their row numbers. They are met
with the rows whose sets are wanted, or that go in the end, by broadcast of these numbers if there are at most ``FEW``
of them, and else by shuffle.

Defined results: null, empty and blank texts are copies of each other and of nothing else; with fewer words than a
shingle the whole sequence is the shingle; A-Z count as a-z; null ids count as larger than all ids; an empty table
gives an empty result. Only named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.arrow import arrow_column, arrow_map
from docloom.llm.components import component_roots
from docloom.llm.simhash import SEED, _majority, links
from docloom.session import materialise, new_path, scratch

WORDS, RADIUS = 5, 4
#: The least similarity of a link, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, BAND_ROWS = 24, 4
#: Nodes of a crowd that a task takes whole, and of one that is cut into tiles at once; rounds for larger ones.
CROWD, TILED, ROUNDS = 512, 1 << 14, 3
#: Shingles of a crowd that a task takes whole, all nodes together; a tile has a quarter of them, or one node.
SHINGLES = 1 << 20
#: Shingles that a task counts at once.
COLUMNS = 1 << 13
#: So many row numbers are broadcast.
FEW = 1 << 20
#: Shingles of a text that meet all multipliers at once.
AT_ONCE = 1 << 12

_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * BAND_ROWS, 2), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (BANDS, BAND_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, words_per_shingle: int = WORDS) -> np.ndarray:
    """A hash of each shingle of a UTF-8 text, in order."""
    words = text.lower().split()
    n = len(words) - words_per_shingle + 1
    joined = b" ".join(words)
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = list(accumulate(words, lambda at, w: at + len(w) + 1, initial=0))
    return np.array([xxhash.xxh64_intdigest(joined[ends[i] : ends[i + words_per_shingle] - 1], SEED) for i in range(n)], np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of the hash functions."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), AT_ONCE):
        part = shingles[i : i + AT_ONCE]
        mixed = part[None, :] * _ODD[:, :1]
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * _ODD[:, 1:]).min(axis=1))
    return least ^ least >> np.uint64(29)


def bands(least: np.ndarray) -> np.ndarray:
    """The names of a set's bands; equal names mean equal minima in the same band."""
    parts = least.reshape(BANDS, BAND_ROWS) * _MIX
    parts ^= parts >> np.uint64(31)
    return (parts * _MIX[::-1]).sum(axis=1, dtype=np.uint64)


SKETCH = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("names", T.ArrayType(T.LongType()))])


def _sketches(texts: pa.Array) -> pa.Array:
    nodes, sizes, prints, names = [], [], [], []
    for text in texts.cast(pa.binary()).to_pylist():
        hashes = shingle_hashes(text or b"")
        own = np.unique(hashes)
        nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
        sizes.append(len(own))
        prints.append(_majority(hashes))
        names.append(bands(minima(own)))
    long = lambda a: pa.array(np.array(a, np.uint64).reshape(-1).view(np.int64))
    lists = lambda a, n: pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(nodes) + 1, n, dtype=np.int32)), long(a))
    return pa.StructArray.from_arrays([long(nodes), pa.array(sizes, pa.int32()), long(prints), lists(names, BANDS)], names=SKETCH.names)


def _sets(texts: pa.Array) -> list:
    return [pa.array([np.unique(shingle_hashes(x or b"")).view(np.int64) for x in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))]


def _needed(a: Column, b: Column) -> Column:
    """How many shingles sets of these sizes share at the least similarity."""
    whole = LEAST[0] + LEAST[1]
    return F.floor((LEAST[0] * (a + b) + F.lit(whole - 1)) / F.lit(whole))


def _met(rows: DataFrame, numbers: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined to some of their numbers (row, ...), which are broadcast where they are few."""
    return rows.join(F.broadcast(numbers) if numbers.count() <= FEW else numbers, "row", how)


def _sets_of(wanted: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """The sets (node, shingles) of written nodes (node, row)."""
    made = arrow_map(_met(rows.select("row", text_col), wanted), ["node"], [F.col(text_col)], [T.StructField("shingles", T.ArrayType(T.LongType()))], _sets)
    return materialise(made, "shingle-sets")


def _tree_pairs(nodes: DataFrame) -> DataFrame:
    """(u, nu, v, nv): nodes with equal fingerprints, by one that stands for all, and what operator 8's trees link."""
    standing = materialise(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("s")).select("fp", "s.node", "s.n"), "standing")
    equal = nodes.select("fp", F.col("node").alias("u"), F.col("n").alias("nu")).join(standing.select("fp", F.col("node").alias("v"), F.col("n").alias("nv")), "fp")
    near = links(standing.select(F.lit(0).alias("p"), "fp"), RADIUS).select(F.col("u").alias("fu"), F.col("v").alias("fv"))
    for end in ("u", "v"):
        near = near.join(standing.select(F.col("fp").alias(f"f{end}"), F.col("node").alias(end), F.col("n").alias(f"n{end}")), f"f{end}")
    return equal.select("u", "nu", "v", "nv").union(near.select("u", "nu", "v", "nv")).where("u <> v")


def _held(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (node, n, centre, nc) with ``shared``, how many shingles they have in common, and ``rest``, what only the node has."""
    own, other = sets.select("node", F.col("shingles").alias("a")), sets.select(F.col("node").alias("centre"), F.col("shingles").alias("b"))
    return pairs.join(own, "node").join(other, "centre").select("node", "n", "centre", "nc", F.array_except("a", "b").alias("rest")).withColumn("shared", F.col("n") - F.size("rest"))


def _in_groups(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """From (name, node, n, open): (node, n, centre, nc), the centre itself too, of the groups that may hold links.

    These have two nodes or more, one of them open, and not all of them joined by ``roots``.
    """
    if roots is not None:
        members = members.join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        members = members.withColumn("root", F.col("node"))
    groups = members.groupBy("name").agg(F.min(F.struct("n", "node")).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("open").alias("open"))
    met = members.join(groups.where("open AND low < high").select("name", "c"), "name")
    return met.select("node", "n", F.col("c.node").alias("centre"), F.col("c.n").alias("nc")).distinct()


def _linked(sizes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of some sets are similar enough, counted shingle by shingle."""
    m = len(sets)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    some = times[column] > 1
    renamed = np.cumsum(times > 1) - 1
    column, owner = renamed[column[some]], owner[some]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((m, m), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((m, int(column[z - 1]) + 1 - start), np.float32)
        part[owner[a:z], column[a:z] - start] = 1
        shared += part @ part.T  # whole numbers far below 2 ** 24
    return (LEAST[0] + LEAST[1]) * shared >= LEAST[0] * (sizes[:, None] + sizes[None, :])


def _spanning(linked: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join the same nodes as all of ``linked``, and each node's part."""
    m = len(linked)
    out, part = [], np.full(m, -1)
    for i in range(m):
        if part[i] < 0:
            part[i] = i
            stack = [i]
            while stack:
                k = stack.pop()
                more = np.flatnonzero(linked[k] & (part < 0))
                part[more] = i
                stack += more.tolist()
                out += [(k, j) for j in more.tolist()]
    return out, part


def crowd_links(sizes: np.ndarray, sets: list[np.ndarray], split: int = 0) -> list[tuple[int, int]]:
    """Links (i, j) that join the same nodes as all links between sets.

    With ``split`` the first so many sets and the others are two tiles; the links inside each are known elsewhere, and
    those are told that join what these leave apart.
    """
    linked = _linked(sizes, sets)
    if not split:
        return _spanning(linked)[0]
    inside = linked.copy()
    inside[:split, split:] = inside[split:, :split] = False
    part = _spanning(inside)[1]
    i, j = np.nonzero(linked[:split, split:])
    _, first = np.unique(part[i] * len(sets) + part[split + j], return_index=True)  # one link for each two parts
    out, above = [], {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    for a, b in zip(i[first].tolist(), (split + j[first]).tolist()):
        one, other = top(int(part[a])), top(int(part[b]))
        if one != other:
            above[one] = other
            out.append((a, b))
    return out


def _longs(values: list[int]) -> pa.Array:
    return pa.array(values, pa.int64())


def _whole_crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (centre, node, shingles) in order of centres."""
    name, nodes, sets = None, [], []

    def found() -> pa.RecordBatch:
        pairs = crowd_links(np.array(list(map(len, sets)), np.int64), sets) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([_longs([nodes[i] for i, _ in pairs]), _longs([nodes[j] for _, j in pairs])], names=["u", "v"])

    for batch in batches:
        for centre, node, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if centre != name:
                yield found()
                name, nodes, sets = centre, [], []
            nodes.append(node)
            sets.append(shingles.values.to_numpy())
    yield found()


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (nodes, others): lists of (node, shingles); without others, links between the nodes."""
    for batch in batches:
        for nodes, others in zip(batch.column(0), batch.column(1)):
            rows = [*nodes, *(others if others.is_valid else [])]
            names = [r["node"].as_py() for r in rows]
            sets = [r["shingles"].values.to_numpy() for r in rows]
            pairs = crowd_links(np.array(list(map(len, sets)), np.int64), sets, len(nodes) if others.is_valid else 0)
            yield pa.RecordBatch.from_arrays([_longs([names[i] for i, _ in pairs]), _longs([names[j] for _, j in pairs])], names=["u", "v"])


def _tiled(crowds: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside crowds (centre, node) of any size, from tiles of about CROWD / 2 nodes and SHINGLES / 4 shingles each."""
    parts = F.greatest(F.ceil(F.col("crowd") / F.lit(CROWD // 2)), F.ceil(F.col("weight") / F.lit(SHINGLES // 4)))
    tile = F.pmod(F.xxhash64("node"), parts).alias("tile")
    dealt = crowds.join(sizes, "centre").select("centre", "node", tile).join(sets, "node")
    tiles = materialise(dealt.groupBy("centre", "tile").agg(F.collect_list(F.struct("node", "shingles")).alias("nodes")), "tiles")
    inside = tiles.select("nodes", F.lit(None).cast(tiles.schema["nodes"].dataType).alias("others"))
    later = tiles.select("centre", F.col("tile").alias("later"), F.col("nodes").alias("others"))
    across = tiles.join(later, "centre").where("tile < later").select("nodes", "others")
    return inside.union(across).mapInArrow(_tile_pairs, "u long, v long")


def _roots(nodes: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """From nodes (node, n, fp, names, row): one row (v, root) for each node that a chain of links joins to a smaller one."""
    spark = nodes.sparkSession
    members = nodes.select(F.explode("names").alias("name"), "node", "n", F.lit(True).alias("open"))
    pairs = materialise(_in_groups(members, None), "group-pairs")
    trees = materialise(_tree_pairs(nodes).select(F.col("u").alias("node"), F.col("nu").alias("n"), F.col("v").alias("centre"), F.col("nv").alias("nc")), "tree-pairs")
    ends = pairs.select("node").union(trees.select("node")).union(trees.select("centre")).distinct()
    sets = _sets_of(materialise(nodes.select("node", "row").join(ends, "node", "left_semi"), "wanted"), rows, text_col)
    linked = F.col("shared") >= _needed(F.col("n"), F.col("nc"))
    path = new_path(spark, "links")
    _held(trees, sets).where(linked).select(F.col("node").alias("u"), F.col("centre").alias("v")).write.parquet(path)
    turn = 0
    while True:
        sizes = materialise(pairs.groupBy("centre").agg(F.count("*").alias("crowd"), F.sum("n").alias("weight")), "crowds")
        fits = (F.col("crowd") <= CROWD) & (F.col("weight") <= SHINGLES)
        small = pairs.join(sizes.where(fits), "centre").select("centre", "node").join(sets, "node").select("centre", "node", "shingles")
        small = small.repartition("centre").sortWithinPartitions("centre")
        small.mapInArrow(_whole_crowds, "u long, v long").write.mode("append").parquet(path)
        whole = turn >= ROUNDS
        tiled = sizes.where(~fits & (F.lit(whole) | (F.col("crowd") <= max(CROWD, TILED))))
        if tiled.limit(1).count():
            _tiled(pairs.join(tiled.select("centre"), "centre").select("centre", "node"), tiled, sets).write.mode("append").parquet(path)
        large = sizes.where(F.col("crowd") > max(CROWD, TILED))
        if whole or not large.limit(1).count():
            return component_roots(spark.read.schema("u long, v long").parquet(path))
        turn += 1
        pairs = pairs.join(large.select("centre"), "centre")
        held = materialise(_held(pairs.where("node <> centre"), sets).withColumn("linked", linked), "held")
        held.where("linked").select(F.col("node").alias("u"), F.col("centre").alias("v")).write.mode("append").parquet(path)
        roots = component_roots(spark.read.schema("u long, v long").parquet(path))
        least = F.greatest(F.col("nc"), F.floor((LEAST[0] * F.col("n") + F.lit(LEAST[1] - 1)) / F.lit(LEAST[1])))
        first = F.size("rest") - (_needed(F.col("n"), least) - F.col("shared")) + 1
        going = F.when(F.col("linked"), F.col("rest")).when(first > 0, F.slice(F.sort_array("rest"), 1, F.greatest(first, F.lit(1)).cast("int")))
        on = held.select("centre", "node", "n", (~F.col("linked")).alias("open"), F.explode(going).alias("shingle"))
        members = on.select(F.xxhash64("centre", "shingle").alias("name"), "node", "n", "open")
        pairs = materialise(_in_groups(members, roots), "group-pairs")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each joined group the row with the smallest id stays.

    Rows are numbered in a written table, so exactly one stays even where ids repeat or are null. Python gets texts
    and gives sketches; the rows themselves stay in the JVM.
    """
    carry = docs.columns
    inner = [f"c{i}" for i in range(len(carry))]
    where = dict(zip(carry, inner))
    rows = docs.toDF(*inner).withColumn("sketch", arrow_column([F.col(where[text_col])], SKETCH, _sketches))
    rows = materialise(rows.select(*inner, "sketch.*", F.monotonically_increasing_id().alias("row")), "numbered")
    path = new_path(docs.sparkSession, "gone")
    with scratch(docs.sparkSession):  # what is written on the way to the rows that go isn't needed any more then
        narrow = rows.select(F.col(where[id_col]).alias("id"), "node", "row")
        first = F.min(F.struct("row", "n", "fp", "names")).alias("s")
        nodes = materialise(rows.groupBy("node").agg(first).select("node", "s.*"), "nodes")
        roots = _roots(nodes, rows, where[text_col])
        rooted = materialise(narrow.join(roots.withColumnRenamed("v", "node"), "node", "left").select("id", "row", F.coalesce("root", "node").alias("root")), "rooted")
        rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
        stay = rooted.groupBy("root").agg(F.min(rank).getField("row").alias("row"), F.count("*").alias("n")).where("n > 1").select("root", F.col("row").alias("kept"))
        rooted.join(stay, "root").where("row <> kept").select("row").write.parquet(path)
    gone = docs.sparkSession.read.schema("row long").parquet(path)
    return _met(rows, gone, "left_anti").select(*[F.col(c).alias(name) for c, name in zip(inner, carry)])
