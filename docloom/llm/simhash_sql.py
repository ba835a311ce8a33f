"""Fingerprints and their components in DuckDB's SQL: XXH64 step by step, majorities, and reachability."""

from __future__ import annotations

#: The primes of XXH64, and the seed.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED = 42
WRAP = 1 << 64


def _times(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT * {b}::UHUGEINT) % {WRAP}::UHUGEINT)::UBIGINT"


def _plus(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {WRAP}::UHUGEINT)::UBIGINT"


def _turned(a: str, bits: int) -> str:
    """Rotated to the left: both halves of a product that doesn't overflow."""
    wide = f"(({a})::UHUGEINT * {1 << bits}::UHUGEINT)"
    return f"({wide} % {WRAP}::UHUGEINT + {wide} // {WRAP}::UHUGEINT)::UBIGINT"


def _round(held: str, lane: str) -> str:
    return _times(_turned(_plus(held, _times(lane, P2)), 31), P1)


def _little_endian(first: str, size: int) -> str:
    """The number whose bytes begin at byte ``first`` (from 0) of the column ``digits``."""
    return "('0x' || " + " || ".join(f"substr(digits, ({first}) * 2 + {2 * i + 1}, 2)" for i in reversed(range(size))) + ")::UBIGINT"


def _mixed_in(held: str, lane: str) -> str:
    """The state after one of the four lanes of stripes."""
    return _plus(_times(f"xor({held}, {_round('0', lane)})", P1), str(P4))


_LANES = ((SEED + P1 + P2) % WRAP, (SEED + P2) % WRAP, SEED, (SEED - P1) % WRAP)
_WORD = _round("0", "w")
_STEPS = [
    # A text of 32 bytes or more goes through four lanes first.
    ", ".join(
        f"list_reduce(list_concat([{start}::UBIGINT], list_transform(range(size // 32), lambda i: {_little_endian(f'i * 32 + {8 * n}', 8)})), lambda v, w: {_round('v', 'w')}) AS v{n}" for n, start in enumerate(_LANES)
    ),
    f"{_plus(_plus(_turned('v0', 1), _turned('v1', 7)), _plus(_turned('v2', 12), _turned('v3', 18)))} AS m0",
    *[f"{_mixed_in(f'm{n}', f'v{n}')} AS m{n + 1}" for n in range(4)],
    f"{_plus(f'CASE WHEN size >= 32 THEN m4 ELSE {SEED + P5}::UBIGINT END', 'size')} AS h0",
    # Then what is left, by 8 bytes, 4 bytes, and single ones.
    f"list_reduce(list_concat([h0], list_transform(range(size // 32 * 4, size // 8), lambda i: {_little_endian('i * 8', 8)})), lambda h, w: {_plus(_times(_turned(f'xor(h, {_WORD})', 27), P1), str(P4))}) AS h1",
    f"CASE WHEN size % 8 >= 4 THEN {_plus(_times(_turned(f'xor(h1, {_times(_little_endian("size // 8 * 8", 4), P1)})', 23), P2), str(P3))} ELSE h1 END AS h2",
    f"list_reduce(list_concat([h2], list_transform(range(size // 4 * 4, size), lambda i: {_little_endian('i', 1)})), lambda h, w: {_times(_turned(f'xor(h, {_times("w", P5)})', 11), P1)}) AS h3",
    f"{_times('xor(h3, h3 >> 33)', P2)} AS h4",
    f"{_times('xor(h4, h4 >> 29)', P3)} AS h5",
    "xor(h5, h5 >> 32) AS hash",
]


def xxh64_ctes(source: str) -> str:
    """Common table expressions after ``source`` (text): x{n} has each text's ``hash``."""
    out = [f"x0 AS (SELECT text, lower(hex(encode(text))) AS digits, octet_length(encode(text))::BIGINT AS size FROM {source})"]
    out += [f"x{n} AS (SELECT *, {step} FROM x{n - 1})" for n, step in enumerate(_STEPS, 1)]
    return ",\n".join(out) + f",\nhashed AS (SELECT text, hash FROM x{len(_STEPS)})"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8_SQL = rf"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS m, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT m, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS text FROM words),
distinct_texts AS (SELECT DISTINCT text FROM shingles),
{xxh64_ctes("distinct_texts")},
counted AS (SELECT m, count(*) AS n, {", ".join(f"sum((hash >> {b}) & 1) AS b{b}" for b in range(64))} FROM shingles JOIN hashed USING (text) GROUP BY m),
prints AS (
  SELECT doc_id, coalesce({" + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))}, 0::UBIGINT) AS fp
  FROM words LEFT JOIN counted USING (m)),
nodes AS (SELECT fp, min(doc_id) AS first_id FROM prints GROUP BY fp),
links AS (
  SELECT a.fp AS u, b.fp AS v FROM nodes a JOIN nodes b
  ON bit_count((xor(a.fp, b.fp) >> 32)::BIGINT) + bit_count((xor(a.fp, b.fp) & 4294967295)::BIGINT) <= 4),
reach AS (SELECT fp AS u, fp AS v FROM nodes UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
components AS (SELECT u AS fp, min(first_id) AS component_id FROM reach JOIN nodes ON fp = v GROUP BY u)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN components USING (fp)
"""
