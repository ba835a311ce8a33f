"""Comparisons of many texts at once, against one by one; zones of any size, against all pairs."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from docloom.functions import fuzzy
from docloom.operators import boilerplate


def drawn(draw, letters, n):
    return "".join(draw.choice(letters) for _ in range(n))


def plain_window(short, long, cutoff):
    """Every beginning, run and end, one by one."""
    if len(short) > len(long):
        score = plain_window(long, short, cutoff)[0]
        return (score, 0, len(long)) if score else (0.0, 0, 0)
    at = long.find(short)
    if at >= 0:
        return 100.0, at, at + len(short)
    n, best = len(short), (0.0, 0, 0)
    spans = [(0, k) for k in range(1, n)] + [(i, i + n) for i in range(len(long) - n + 1)] + [(len(long) - k, len(long)) for k in range(n - 1, 0, -1)]
    for a, z in spans:
        common = fuzzy.lcs_length(short, long[a:z])
        score = 100.0 * common / n if z - a == n else 200.0 * common / (n + z - a)
        if score > best[0] and score >= cutoff:
            best = (score, a, z)
    return best


def test_best_window_is_that_of_all_windows():
    draw = random.Random(3)
    for turn in range(250):
        letters = "abcd " if turn % 2 else "abcdefghijklmnopqrstuvwxyz éß\U0001f600"
        long = drawn(draw, letters, draw.randrange(1, 500))
        n = draw.choice([1, 2, 20, 63, 64, 65, 130])
        short = drawn(draw, letters, n)
        if draw.random() < 0.6 and len(long) > n:
            start = draw.randrange(len(long) - n)
            changed = list(long[start : start + n])
            for _ in range(draw.randrange(n // 2 + 1)):
                changed[draw.randrange(n)] = draw.choice(letters)
            short = "".join(changed)
        cutoff = draw.choice([0, 50, 60, 70, 95])
        assert fuzzy.best_window(short, long, cutoff) == plain_window(short, long, cutoff)


@pytest.mark.parametrize("wide", [0, 8])
def test_pairs_at_once(monkeypatch, wide):
    monkeypatch.setattr(fuzzy, "WIDE", wide)
    monkeypatch.setattr(fuzzy, "TOGETHER", 500)
    draw = random.Random(4)
    texts = [drawn(draw, "abcdefgh ", draw.choice([0, 1, 5, 60, 64, 65, 129, 200])) for _ in range(40)]
    texts += [t[: len(t) * 4 // 5] + drawn(draw, "xyz", len(t) // 6) for t in texts]
    a, b = np.triu_indices(len(texts), 1)
    for alike in (50, 66.6, 80, 100):
        got = fuzzy.alike_pairs(fuzzy.Texts(texts), a, b, alike)
        assert got.tolist() == [fuzzy.indel_ratio(texts[i], texts[j]) >= alike for i, j in zip(a, b)]


def zone_texts(draw, n):
    """Running heads with numbers, near copies, texts of their own, very short ones."""
    rows = {f"Chapter {draw.randrange(9)} - page {i}" for i in range(n // 4)} | {"", "a", "b"}
    for _ in range(n // 4):
        base = drawn(draw, "abcdefghijklmnopqrstuvwxyz ", draw.randrange(3, 90))
        rows |= {base, base[: len(base) * 9 // 10]}
    while len(rows) < n:
        rows.add(drawn(draw, "abcdefghijklmnopqrstuvwxyz ", draw.randrange(1, 60)))
    return sorted(x for x in rows if x)


@pytest.mark.parametrize("tile", [256, 7, 1])
def test_zones_of_any_size(spark, monkeypatch, tile):
    """One large zone beside many small ones: the result is that of all pairs, whatever a task compares."""
    monkeypatch.setattr(boilerplate, "TILE", tile)
    draw = random.Random(5)
    rows = [(1, "header", t) for t in zone_texts(draw, 120)]
    rows += [(d, z, t) for d in range(2, 12) for z in ("header", "footer") for t in zone_texts(draw, draw.randrange(1, 12))]
    got = boilerplate.alike_texts(spark.createDataFrame(rows, "doc_id long, zone string, text string").repartition(3)).collect()
    truth = set()
    for (d, z, t), (e, y, u) in combinations(rows, 2):
        if (d, z) == (e, y) and fuzzy.indel_ratio(t, u) >= 80:
            truth |= {(d, z, t), (e, y, u)}
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == truth and 60 < len(truth) < len(rows)


def test_a_zone_across_batches():
    rows = [(1, "header", f"Some running head, page {i}") for i in range(9)] + [(2, "header", "alone")] + [(2, "footer", f"No {i}{i}{i}") for i in range(3)]
    table = pa.table({"doc_id": [r[0] for r in rows], "zone": [r[1] for r in rows], "text": [r[2] for r in rows]})
    for size in (1, 2, 5, 100):
        out = pa.Table.from_batches(list(boilerplate._in_zones(80.0)(iter(table.to_batches(max_chunksize=size)))))
        assert out.num_rows == 9 and set(out["doc_id"].to_pylist()) == {1}
    assert list(boilerplate._in_zones(80.0)(iter([]))) == []


def test_no_zones(spark):
    assert boilerplate.alike_texts(spark.createDataFrame([], "doc_id long, zone string, text string")).collect() == []


def test_many_nodes_of_one_text(spark):
    """A head on every page is one text, whose nodes are met by a join."""
    rows = [(1, "header", i, "Same head") for i in range(3000)] + [(1, "header", 9000, "Same heads"), (1, "footer", 9001, "Same head"), (2, "header", 1, "Same head")]
    found = spark.createDataFrame(rows, "doc_id long, zone string, node_id long, text string")
    assert boilerplate.repeated_exact(found).count() == 3000
    assert {r["node_id"] for r in boilerplate.repeated_alike(found).collect()} == {*range(3000), 9000}
