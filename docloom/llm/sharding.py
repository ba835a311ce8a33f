"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

The leaves of the tree are shards, above them racks, above these regions; a node's weight is the sum of its leaves'.
From the root down a row draws one number per child, -ln(u) / weight with u hashed from the row's key and the
child's name, and goes to the smallest. If one child's weight changes, the draws of its siblings stay what they
were, so rows move only into a subtree that has grown or out of one that has shrunk. A new shard comes as a region
of its own: no other weight below the root changes, so it takes rows only into itself.

The key and the tree decide alone, so the law is ``key``; shards hold rows in proportion to their weights, up to
chance. Equal texts aren't kept together: their keys differ.

Defined results: a null key draws as the empty string; repeated rows share a shard and get slots of their own; a null
text has size 1 and the checksum of the empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.arrow import quoted
from docloom.llm.numbering import number_within

#: Random numbers have so many bits, which doubles hold exactly.
DRAW_BITS = 52


@dataclass(frozen=True)
class Node:
    """A leaf has a shard number and a weight; an inner node has children. Names are unique in a tree."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def leaves(self) -> Iterator[Node]:
        if not self.children:
            yield self
        for c in self.children:
            yield from c.leaves()

    def grown(self, weight: float = 1.0) -> Node:
        """This tree and one more shard, in a region and rack of its own."""
        n = 1 + max(leaf.shard for leaf in self.leaves())
        leaf = Node(f"shard{n}", shard=n, own_weight=weight)
        return Node(self.name, (*self.children, Node(f"region-of-{n}", (Node(f"rack-of-{n}", (leaf,)),))))


def tree(regions: list[list[list[float]]]) -> Node:
    """From weights by region, rack and shard; shards are numbered in reading order."""
    n = iter(range(sum(len(rack) for region in regions for rack in region)))

    def rack_of(name: str, weights: list[float]) -> Node:
        return Node(name, tuple(Node(f"shard{i}", shard=i, own_weight=w) for w, i in zip(weights, n)))

    return Node("root", tuple(Node(f"region{r}", tuple(rack_of(f"region{r}-rack{k}", rack) for k, rack in enumerate(region))) for r, region in enumerate(regions)))


#: Two regions of two racks of two equal shards.
EIGHT = tree([[[1.0, 1.0], [1.0, 1.0]], [[1.0, 1.0], [1.0, 1.0]]])


def draw(key: Column, name: str, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, DRAW_BITS // 4)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**DRAW_BITS))
    return -F.log(u) / F.lit(weight)


def shard_of(key: Column, node: Node) -> Column:
    """The shard of a string key. Only the draws on a row's own way down are made."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return shard_of(key, live[0])
    won = F.array_min(F.array(*[F.struct(draw(key, c.name, c.weight).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)])).getField("i")
    out: Column = F.when(won == 0, shard_of(key, live[0]))
    for i, c in enumerate(live[1:], 1):
        out = out.when(won == i, shard_of(key, c))
    return out


def sharded(docs: DataFrame, topology: Node, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, shard, slot and the shard in the tree with one more shard, of every row."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    key = F.coalesce(quoted(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        quoted(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        shard_of(key, topology).cast("int").alias("shard"),
        shard_of(key, topology.grown()).cast("int").alias("grown_shard"),
    )
    numbered = number_within(rows, ["shard"], ["id", "text_crc32", "size"], "slot")
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", "grown_shard")


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = sharded(docs, EIGHT)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _draw_sql(name: str, weight: float) -> str:
    return f"-ln((('0x' || substr(md5(key || '|{name}'), 1, {DRAW_BITS // 4}))::BIGINT + 0.5e0) / {float(2**DRAW_BITS)!r}) / {weight!r}e0"


def shard_sql(node: Node) -> str:
    """``shard_of`` a column ``key``, in DuckDB's SQL."""
    if not node.children:
        return str(node.shard)
    live = [c for c in node.children if c.weight > 0]
    out = shard_sql(live[-1])
    for i in range(len(live) - 2, -1, -1):
        own = _draw_sql(live[i].name, live[i].weight)
        wins = " AND ".join(f"{own} <= {_draw_sql(c.name, c.weight)}" for c in live[i + 1 :])
        out = f"CASE WHEN {wins} THEN {shard_sql(live[i])} ELSE {out} END"
    return out


#: The checksum byte by byte, by a table that its polynomial makes.
OP4_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
rows AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
placed AS (
  SELECT doc_id, len(bytes) + 1 AS size, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
         {shard_sql(EIGHT)} AS shard, {shard_sql(EIGHT.grown())} AS grown_shard
  FROM rows, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed
"""
