"""Merkle manifest of a dataset: a tree of digests over each group's rows in id order, and a proof for every row.

A row's leaf is the digest of its columns, each framed by its length. Exact ranks inside the groups come from digit
histograms (``radix_ranks``). Written to the base of the fan-out, a rank is a path in a trie: nodes whose paths agree
but for the last digit are a run, whose digest is their parent. A task holds all rows whose ranks share the longest
prefix that leaves ``DIGITS`` digits free, at most ``FANOUT ** DIGITS``, and reduces them to one node; these nodes'
positions are the prefixes, and are reduced likewise until one node a group is left. Then the groups' nodes, in order
of the groups' names, are the rows of one more tree, whose top is the root. On the way down every row gets the siblings
on its path, of which the ones above its task's prefix come once for all of the task's rows.

What moves: per row an id and one or two digests, twice (by digit prefix, then by rank prefix). Texts are read once and
stay where they are.

Defined results: each null column counts as ``-``; null ids come first, null groups before all others; rows with one id
follow each other by leaf, rows that are equal throughout in any order (their leaves are the same); a null id is never
tampered with; an empty table gives an empty result. Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.arrow import quoted
from docloom.llm.numbering import number_within
from docloom.llm.radix_ranks import ranks, unsigned_order
from docloom.session import materialise, ship_package

FANOUT, DIGITS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CHUNK_BITS = 3 * DIGITS
_PATH = "array<struct<l: binary, r: binary>>"


def framed(column: Column) -> Column:
    """A column's length in bytes and its value, or a dash."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(framed, columns)), 256))


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def grown(nodes: list[bytes], total: int) -> list[list[bytes]]:
    """The levels over hexadecimal digests that begin a run, the digests first, as far as DIGITS digits and ``total``
    nodes of the whole group allow."""
    levels = [nodes]
    for _ in range(DIGITS):
        if total <= 1:
            break
        below = levels[-1]
        levels.append([sha256(b"".join(below[i : i + FANOUT])).hexdigest().encode() for i in range(0, len(below), FANOUT)])
        total = -(-total // FANOUT)
    return levels


def siblings(levels: list[list[bytes]], at: int) -> Iterator[tuple[bytes, bytes]]:
    """What stands left and right of a node's ancestors (itself first) in their runs, below the top of ``levels``."""
    for nodes in levels[:-1]:
        first = at - at % FANOUT
        yield b"".join(nodes[first:at]), b"".join(nodes[at + 1 : first + FANOUT])
        at //= FANOUT


def _hex(x: bytes) -> bytes:
    return x.hex().encode()


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups, places, nodes, totals = (batch.column(i) for i in range(4))
        tops = [bytes.fromhex(grown([_hex(x["digest"]) for x in row.as_py()], total)[-1][0].decode()) for row, total in zip(nodes, totals.to_pylist())]
        yield pa.RecordBatch.from_arrays([groups, places, pa.array(tops, pa.binary())], names=["g", "pos", "digest"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))
    for batch in batches:
        for g, nodes, total, above in zip(batch["g"].to_pylist(), batch["nodes"], batch["total"].to_pylist(), batch["path"].to_pylist()):
            nodes = nodes.as_py()
            levels = grown([_hex(x["digest"]) for x in nodes], total)
            paths = [[{"l": l, "r": r} for l, r in siblings(levels, i)] + above for i in range(len(nodes))]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(nodes)), pa.array([x["pos"] for x in nodes], pa.int64()), pa.array(paths, kind)], names=["g", "pos", "path"])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a leaf: id, leaf, subroot, proof, folded root."""
    for batch in batches:
        for nodes, total, above, subroot in zip(batch["nodes"], batch["total"].to_pylist(), batch["path"].to_pylist(), batch["subroot"].to_pylist()):
            nodes = nodes.as_py()
            leaves = [_hex(x["digest"]) for x in nodes]
            levels = grown(leaves, total)
            upper = [(x["l"], x["r"]) for x in above]
            shared = b"".join(l + r for l, r in upper)
            proofs, folded = [], []
            for i, x in enumerate(nodes):
                own = list(siblings(levels, i))
                proofs.append(sha256(b"".join([l + r for l, r in own]) + shared).hexdigest())
                node = leaves[i] if x["tampered"] is None else _hex(x["tampered"])
                for l, r in own + upper:
                    node = sha256(l + node + r).hexdigest().encode()
                folded.append(node.decode())
            ids = pa.array([x["id"] for x in nodes], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.decode() for x in leaves]), pa.array([subroot.hex()] * len(nodes)), pa.array(proofs), pa.array(folded)], names=["id", "leaf", "subroot", "proof_sha256", "folded_root"])


def _chunks(nodes: DataFrame, totals: DataFrame, fields: list[str]) -> DataFrame:
    """(g, pos, nodes, total): rows whose positions share all but DIGITS digits, in order, and the nodes of their group."""
    held = nodes.groupBy("g", F.shiftright("pos", _CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("nodes"))
    return held.join(totals, "g").select("g", F.col("chunk").alias("pos"), "nodes", "total")


def _climbed(nodes: DataFrame, totals: DataFrame, label: str) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes (g, pos, digest) and the groups' (g, total): one node a group, and the chunks that were reduced, lowest first.

    Groups that are done go on as chunks of one node, which stays as it is.
    """
    floors: list[DataFrame] = []
    most = totals.agg(F.max("total")).first()[0] or 0
    fields = [c for c in nodes.columns if c not in ("g", "pos")]
    while True:
        floors.append(materialise(_chunks(nodes, totals, fields), f"{label}-chunks"))
        nodes = materialise(floors[-1].select("g", "pos", "nodes", "total").mapInArrow(_tops, "g string, pos long, digest binary"), f"{label}-tops")
        totals = totals.select("g", F.ceil(F.col("total") / F.lit(float(1 << _CHUNK_BITS))).cast("long").alias("total"))
        most = (most + (1 << _CHUNK_BITS) - 1) >> _CHUNK_BITS
        fields = ["digest"]
        if most <= 1:
            return nodes, floors


def _descended(paths: DataFrame, floors: list[DataFrame]) -> DataFrame:
    """From the paths (g, pos, path) of the tops of the last floor, those of the nodes of the first."""
    for floor in reversed(floors):
        paths = materialise(floor.join(paths, ["g", "pos"]).select("g", "nodes", "total", "path").mapInArrow(_paths, f"g string, pos long, path {_PATH}"), "paths")
    return paths


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, tamper: Column | None = None, text_col: str = "text") -> DataFrame:
    """``id``, leaf, subroot, root, proof_sha256, folded_root and verified of every row; digests as hexadecimal text.

    Where ``tamper`` holds, the root is folded from the row with a text in lower case; else from the row as it is.
    ``id_col`` is a long.
    """
    spark = docs.sparkSession
    ship_package(spark)
    columns = [quoted(c) for c in fields]
    changed = [ascii_lower(quoted(c)) if c == text_col else quoted(c) for c in fields]
    wanted = F.coalesce(tamper, F.lit(False)) if tamper is not None else F.lit(False)
    group = F.coalesce(F.concat(F.lit("="), quoted(group_col).cast("string")), F.lit(""))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), group.alias("g"), digest(columns).alias("digest"), F.when(wanted, digest(changed)).alias("tampered"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    lead = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    known = F.col("id").isNotNull().cast("long")  # null ids before the least long
    keyed = rows.withColumns({"key1": unsigned_order(F.coalesce("id", F.lit(-(1 << 63)))), "key2": known, "key3": lead})
    placed = ranks(keyed, "g", ["key1", "key2", "key3", "row"]).select("g", F.col("rank").alias("pos"), "digest", "tampered", "id")
    totals = materialise(rows.groupBy("g").agg(F.count("*").alias("total")), "group-rows")
    subroots, floors = _climbed(placed, totals, "group")

    named = number_within(subroots.select("g", "digest"), [], ["g"], "at")
    named = materialise(named, "subroots")
    n_groups = named.count()
    tops = named.select(F.lit("").alias("g"), F.col("at").alias("pos"), "digest")
    root, upper = _climbed(tops, spark.range(1).select(F.lit("").alias("g"), F.lit(n_groups).cast("long").alias("total")), "root")
    start = root.select("g", "pos", F.array().cast(_PATH).alias("path"))
    by_name = _descended(start, upper).select(F.col("pos").alias("at"), "path").join(named, "at").select("g", F.lit(0).cast("long").alias("pos"), "path")
    paths = _descended(by_name, floors[1:])
    leaves = floors[0].join(paths, ["g", "pos"]).join(named.select("g", F.col("digest").alias("subroot")), "g")
    proved = leaves.select("nodes", "total", "path", "subroot").mapInArrow(_proofs, "id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    found = root.select(F.lower(F.hex("digest")).alias("root"))  # one row, or none over an empty table
    top = found.first()
    whole = F.lit(top["root"] if top else None).cast("string")
    return proved.select("id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))


def third_by_checksum(id_col: str = "doc_id") -> Column:
    """Whether 3 divides the checksum of the decimal id."""
    return F.pmod(F.crc32(F.encode(quoted(id_col).cast("string"), "UTF-8")), F.lit(3)) == 0


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest, proofs and a check of the proofs on a tampered third, over all documents by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = manifest(docs, tamper=third_by_checksum())
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql(floors: int = 8) -> str:
    """The same by numbering all rows and joining level to level, for up to 8 ** floors rows a language."""
    frame = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = "sha256(" + " || ".join(frame(c) for c in FIELDS) + ")"
    bad = "sha256(" + " || ".join(frame(c if c != "text" else lowered) for c in FIELDS) + ")"
    out = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
leaves AS (
  SELECT doc_id, lang, {leaf} AS leaf,
    CASE WHEN xor(list_reduce(list_concat([4294967295], regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..').list_transform(lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 THEN {bad} END AS tampered
  FROM documents, crc),
g0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
n0 AS (SELECT coalesce('=' || lang, '') AS g, pos, leaf AS h FROM g0)"""

    def climb(prefix: str, levels: int) -> str:
        """Levels n0.. of nodes (g, pos, h), where a group with one node stays; k.. have what stands beside a node."""
        text = ""
        for i in range(levels):
            text += f""",
{prefix}m{i} AS (SELECT *, count(*) OVER (PARTITION BY g) AS many FROM {prefix}{i}),
{prefix}k{i} AS (SELECT a.g, a.pos, a.many, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {prefix}m{i} a JOIN {prefix}m{i} b ON a.g = b.g AND a.pos // {FANOUT} = b.pos // {FANOUT} GROUP BY ALL),
{prefix}{i + 1} AS (SELECT g, pos // {FANOUT} AS pos, CASE WHEN any_value(many) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {prefix}m{i} GROUP BY g, pos // {FANOUT})"""
        return text

    out += climb("n", floors)
    out += f""",
t0 AS (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, g AS name FROM n{floors})"""
    out += climb("t", 3)
    out += f""",
f0 AS (SELECT doc_id, leaf, coalesce('=' || lang, '') AS g, pos, '' AS proof, coalesce(tampered, leaf) AS fold FROM g0)"""
    for i in range(floors):
        out += f""",
f{i + 1} AS (SELECT f.doc_id, f.leaf, f.g, f.pos // {FANOUT} AS pos, proof || CASE WHEN many > 1 THEN l || r ELSE '' END AS proof, CASE WHEN many > 1 THEN sha256(l || fold || r) ELSE fold END AS fold FROM f{i} f JOIN nk{i} k ON f.g = k.g AND f.pos = k.pos)"""
    out += f""",
u0 AS (SELECT f.doc_id, f.leaf, t0.h AS subroot, t0.pos, proof, fold FROM f{floors} f JOIN t0 ON f.g = t0.name)"""
    for i in range(3):
        out += f""",
u{i + 1} AS (SELECT f.doc_id, f.leaf, subroot, f.pos // {FANOUT} AS pos, proof || CASE WHEN many > 1 THEN l || r ELSE '' END AS proof, CASE WHEN many > 1 THEN sha256(l || fold || r) ELSE fold END AS fold FROM u{i} f JOIN tk{i} k ON f.pos = k.pos)"""
    return out + """
SELECT doc_id, leaf, subroot, t3.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t3.h AS verified FROM u3, t3"""


OP12_SQL = _sql(6)
