import random

import pytest
import xxhash
from pyspark.sql import Row

from docloom.llm import simhash
from docloom.llm.components import component_roots


def brute_fingerprint(text, k=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    vs = sorted(up)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {v: find(v) for v in vs}


def near_values(draw, groups=40, size=12, bits=64):
    out = set()
    for _ in range(groups):
        x = draw.getrandbits(bits)
        for _ in range(size):
            for _ in range(draw.randint(0, 5)):
                x ^= 1 << draw.randrange(bits)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("text", ["", "  \n", "One", "a b c", "A B C D", "a b c d e\tf  g", "Ünïcode ÀB c d e f", "x " * 5000, "\x1c a b\x85c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == (brute_fingerprint(text),)
    assert simhash.fingerprint(text.encode(), prints=3)[0] == brute_fingerprint(text)


def test_tree_joins_what_links_join():
    draw = random.Random(1)
    for _ in range(20):
        values = near_values(draw, 10, 8)
        draw.shuffle(values)
        tree = simhash.Tree(4)
        links = [(x, y) for x in values for y in tree.add(x)]
        assert all((x ^ y).bit_count() <= 4 for x, y in links)
        truth = brute_components(values, 4)
        assert len(links) == len(values) - len(set(truth.values()))  # a forest: one link for each join
        seen = brute_components_from(values, links)
        assert all((seen[a] == seen[b]) == (truth[a] == truth[b]) for a in values for b in values)


def test_a_tree_names_each_component_that_is_reached():
    draw = random.Random(3)
    values = near_values(draw, 10, 8)
    tree = simhash.Tree(4)
    for x in values[::2]:
        tree.add(x)
    truth = brute_components(values[::2], 4)
    for x in values[1::2]:
        got = tree.reached(x)
        near = {truth[v] for v in values[::2] if (v ^ x).bit_count() <= 4}
        assert sorted(truth[v] for v in got) == sorted(near)


def brute_components_from(values, links):
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


@pytest.mark.parametrize(("shard", "chosen", "tree"), [(256, 1, 1 << 16), (1, 1, 1 << 16), (256, 2, 1 << 16), (2, 3, 1 << 16), (2, 1, 9), (4, 2, 30)])
def test_components_at_any_shard_size(spark, monkeypatch, shard, chosen, tree):
    """With a small ``tree`` crowds are cut into chunks, each searched in each other's tree."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "TREE", tree)
    monkeypatch.setattr(simhash, "blocks_for", lambda nodes, radius: (radius + chosen, chosen))
    draw = random.Random(2)
    values = near_values(draw, 12, 10) + near_values(draw, 1, 150)
    values = sorted({*values, 0, 1, (1 << 64) - 1, 1 << 63})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([Row(doc_id=i, fps=[s]) for i, s in enumerate(signed)] + [Row(doc_id=-1, fps=[signed[0]])])
    got = {r["fp"]: r["component_id"] for r in simhash.components(rows).collect()}
    truth = brute_components(values, 4)
    least = {}
    for i, v in enumerate(values):
        least[truth[v]] = min(least.get(truth[v], i), i)
    least[truth[values[0]]] = -1
    assert got == {s: least[truth[v]] for s, v in zip(signed, values)}


def test_block_masks_meet_every_pair():
    draw = random.Random(4)
    for chosen in (1, 2, 3):
        masks = simhash.block_masks(list(range(64)), 4 + chosen, chosen)
        for _ in range(300):
            flips = sum(1 << b for b in draw.sample(range(64), 4))
            assert any(not flips & m for m in masks)


def test_roots_of_a_path_a_star_and_odd_links(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    rows = [*path, *star, (7, 7), (None, 3), (500, 501), (501, 500)]
    got = {r["v"]: r["root"] for r in component_roots(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}, 501: 500}
    assert component_roots(spark.createDataFrame([], "u long, v long")).collect() == []


def test_query_against_brute_force(spark, small_tables):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()}
    prints = {d: brute_fingerprint(t) for d, t in docs.items()}
    truth = brute_components(set(prints.values()), 4)
    least = {}
    for d, p in prints.items():
        least[truth[p]] = min(least.get(truth[p], d), d)
    got = simhash.op8_simhash_components(spark, small_tables).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{p:016x}", least[truth[p]]) for d, p in prints.items()}


def odd_documents(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, long), (2, long), (2, long), (3, long + " tail"), (None, long), (4, None), (5, ""), (None, None), (6, "Other words that stand alone here"), (7, " \n ")]
    return spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, fp string, row int")


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd_documents(spark)).collect()
    assert len(got) == 10
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by_id[1] == by_id[2] == by_id[3] == {1}
    assert by_id[None] == {1, 4}
    assert by_id[4] == by_id[5] == by_id[7] == {4}
    assert simhash.near_duplicates(odd_documents(spark).limit(0)).collect() == []


def test_one_of_each_group_stays(spark):
    docs = odd_documents(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6]
    nameless = spark.createDataFrame([(None, "a b c d e")] * 5, "doc_id long, text string")
    assert simhash.one_of_each(nameless).count() == 1
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_several_prints_by_brute_force(spark):
    draw = random.Random(9)
    texts = []
    for _ in range(30):
        words = [f"w{draw.randint(0, 4000)}" for _ in range(120)]
        texts.append(" ".join(words))
        for _ in range(3):
            changed = list(words)
            for _ in range(draw.randint(1, 6)):
                changed[draw.randrange(120)] = "new"
            texts.append(" ".join(changed))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for prints in (1, 4):
        marks = [simhash.fingerprint(t.encode(), prints=prints) for t in texts]
        label = list(range(len(texts)))
        for _ in texts:
            before = list(label)
            for i, a in enumerate(marks):
                for j, b in enumerate(marks[:i]):
                    if any((x ^ y).bit_count() <= 4 for x, y in zip(a, b)):
                        label[i] = label[j] = min(label[i], label[j])
            if label == before:
                break
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, prints=prints).collect()}
        assert got == dict(enumerate(label))
        found[prints] = len(set(label))
    assert found[4] < found[1]


def test_unrelated_documents_stay(spark):
    draw = random.Random(10)
    docs = spark.createDataFrame([(i, " ".join(f"w{draw.randint(0, 900)}" for _ in range(draw.randint(1, 80)))) for i in range(400)], "doc_id long, text string")
    kept = simhash.one_of_each(docs, prints=6).count()
    assert kept == docs.select("text").distinct().count()
