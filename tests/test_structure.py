import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.operators import boilerplate, combine, structure
from docloom.plans.documents import ingest
from docloom.sources import readers

NODES = "doc_id long, seq int, node_id string, type string, parent_id string, text string"


def nodes(spark, rows, doc=1):
    return spark.createDataFrame([(doc, i, *r) for i, r in enumerate(rows)], NODES)


def test_section_assignment_as_worked_by_hand(spark):
    rows = [
        ("h", "Header", None, "x" * 10), ("p0", "NarrativeText", None, "x" * 50), ("t1", "Title", None, "x" * 8), ("a", "NarrativeText", "t1", "x" * 50),
        ("tab", "Table", "t1", "x" * 90), ("b", "NarrativeText", None, "x" * 50), ("big", "NarrativeText", None, "x" * 2000), ("c", "NarrativeText", "zz", "x" * 50),
        ("f", "Footer", None, "x" * 8), ("d", "NarrativeText", None, "x" * 50),
    ]
    got = {r["node_id"]: r["target"] for r in structure.sections(nodes(spark, rows)).collect()}
    assert got == {"h": "h", "p0": "p0", "t1": "t1", "a": "t1", "tab": "tab", "b": "t1", "big": "big", "c": "big", "f": "f", "d": "f"}
    first = nodes(spark, [("x", "NarrativeText", "zz", "text"), ("e", "NarrativeText", None, "y" * 1024)])
    assert {r["node_id"]: r["target"] for r in structure.sections(first).collect()} == {"x": None, "e": "e"}
    assert [r["node_id"] for r in combine.dead_letters(first).collect()] == ["x"]


def sequential(rows, least=1024):
    """The rules one row after the other."""
    out, anchors, emitted = {}, set(), []
    for name, kind, parent, text in rows:
        if kind in ("Header", "Footer", "Image", "Table"):
            out[name] = name
            emitted.append((name, kind))
        elif kind == "Title" or parent not in anchors and parent is None and (len(text) > least or not anchors):
            out[name] = name
            anchors.add(name)
            emitted.append((name, kind))
        elif parent in anchors:
            out[name] = parent
        else:
            out[name] = next((n for n, k in reversed(emitted) if k not in ("Table", "Image")), None)
    return out


def test_sections_equal_a_sequential_model(spark):
    draw = random.Random(7)
    docs, truth = [], {}
    for d in range(300):
        rows = []
        for i in range(draw.randint(1, 14)):
            earlier = [r[0] for r in rows] + [f"{d}-{draw.randint(0, 14)}"]
            parent = draw.choice([None, None, draw.choice(earlier)])
            rows.append((f"{d}-{i}", draw.choice(["Title", "NarrativeText", "NarrativeText", "ListItem", "Table", "Image", "Header", "Footer"]), parent, "x" * draw.choice([5, 1024, 1025])))
        docs += [(d, i, *r) for i, r in enumerate(rows)]
        truth |= sequential(rows)
    got = structure.sections(spark.createDataFrame(docs, NODES)).collect()
    assert {r["node_id"]: r["target"] for r in got} == truth


def test_runs_merge(spark):
    rows = [("a", "Title", None, "A"), ("b", "Title", None, "B"), ("c", "NarrativeText", "b", "text."), ("d", "ListItem", None, "one"), ("e", "ListItem", None, "two"), ("f", "ListItem", None, "three")]
    both = combine.merge_list_items(combine.merge_titles(nodes(spark, rows))).orderBy("seq").collect()
    assert [(r["node_id"], r["type"], r["text"], r["parent_id"]) for r in both] == [("b", "Title", "A\nB", None), ("c", "NarrativeText", "text.", "b"), ("d", "ListItem", "one two three", None)]
    children = combine.merge_titles(nodes(spark, [("a", "Title", None, "A"), ("b", "Title", None, "B"), ("c", "NarrativeText", "a", "x")])).collect()
    assert {r["node_id"]: r["parent_id"] for r in children} == {"b": None, "c": "b"}


@pytest.mark.parametrize(("kinds", "made"), [
    (["Title", "Title"], "Title"), (["NarrativeText", "ListItem"], S.TEXT_COMPOSITE), (["FigureCaption", "Image"], "Image"), (["Title", "NarrativeText"], "Composite"),
    ([S.TEXT_COMPOSITE, "Formula"], S.TEXT_COMPOSITE), (["Composite", "Composite"], "Composite"), (["Table", "Image"], "Composite"), (["Image"], "Image"),
])
def test_kinds_combine(kinds, made):
    assert reduce(combine.combined_kind, kinds) == made


def test_growing_text_is_that_of_joining_whole_texts():
    draw = random.Random(3)
    for _ in range(3000):
        keep = draw.choice(["one_kept", "both_dropped"])
        texts = ["".join(draw.choice("ab. \nA") for _ in range(draw.choice([0, 1, 2, 5, 20, 80]))) for _ in range(draw.randrange(1, 7))]
        texts += texts[:1] if draw.random() < 0.3 else []
        grown = combine.Growing(texts[0], keep)
        for text in texts[1:]:
            grown.add(text)
        made = reduce(lambda a, b: combine.combine_texts(a, b, keep), texts)
        assert (grown.whole() if grown.parts else "", grown.size) == (made, len(made))


def test_a_section_of_very_many_lines(spark):
    """Its lines come one after the other through many batches; no row holds them all but the result."""
    n = 60_000
    lines = spark.range(n).selectExpr(
        "1 AS doc_id", "CAST(id AS INT) AS seq", "concat('n', id) AS node_id", "IF(id = 0, 'Title', 'NarrativeText') AS type", "IF(id = 0, NULL, 'n0') AS parent_id",
        "concat(hex(xxhash64(id)), ' number ', id, '.') AS text", "array(CAST(id DIV 1000 AS INT)) AS page_numbers", "IF(id < 5, NULL, id) AS first_known",
    )
    made = combine.section_nodes(lines).collect()
    assert len(made) == 1 and made[0]["page_numbers"] == list(range(60)) and made[0]["first_known"] == 5
    assert [x.strip() for x in made[0]["text"].split("\n")][1:] == [r["text"] for r in lines.orderBy("seq").select("text").collect()][1:]


def test_sections_fold_texts_and_sets(spark):
    rows = spark.createDataFrame([
        (1, 0, "t", "Title", None, "Head", [1], ["en"]), (1, 1, "a", "NarrativeText", "t", "goes on,", [2], None), (1, 2, "b", "NarrativeText", "t", "to the end.", [2], ["de", "en"]), (1, 3, "i", "Image", None, "pic", [3], None),
    ], NODES + ", page_numbers array<int>, languages array<string>")
    got = {r["node_id"]: r for r in combine.section_nodes(rows).collect()}
    assert got["t"]["text"].split() == "Head goes on, to the end.".split()
    assert (got["t"]["type"], got["t"]["page_numbers"], got["t"]["languages"]) == ("Composite", [1, 2], ["de", "en"])
    assert got["i"]["text"] == "pic"


def test_combining_texts():
    assert combine.combine_texts("same", "same", "one_kept") == "same"
    assert combine.combine_texts("", "b", "one_kept") == "b"
    assert combine.combine_texts("goes on", "X", "one_kept") == "goes on X"
    assert combine.combine_texts("Ends.", "X", "one_kept") == "Ends.\nX"
    assert combine.combine_texts("CAPS", "X", "one_kept") == "CAPS\nX"


def test_links_and_removal(spark):
    rows = nodes(spark, [("a", "Title", None, "A"), ("b", "NarrativeText", "a", "B"), ("c", "NarrativeText", "a", "C")])
    left = structure.without(rows, rows.where("node_id = 'a'"))
    got = {r["node_id"]: (r["parent_id"], r["prev_id"], r["next_id"]) for r in structure.linked(left).collect()}
    assert got == {"b": (None, None, "c"), "c": (None, "b", None)}
    assert [tuple(r) for r in structure.child_counts(rows).collect()] == [(1, "a", 2)]


def test_elements_become_nodes(spark):
    element = "doc_id long, seq int, element_id string, parent_id string, category string, text string, text_as_html string, page_number int, filename string, file_directory string, image_path string, image_base64 string, orig_elements array<struct<text:string,category:string>>, languages array<string>"
    rows = spark.createDataFrame([
        (1, 0, "t", None, "Title", "T", None, 1, "f.pdf", "d", None, None, None, ["en"]),
        (1, 1, "tab", "t", "Table", "plain", "<table/>", 1, None, None, None, None, [], None),
        (1, 2, "img", "gone", "Image", "", None, None, None, None, "p.jpg", None, None, None),
        (1, 3, "c", "t", "Composite", "c", None, 2, None, None, None, None, [("x", "Title"), ("y", "NarrativeText")], None),
        (1, 4, "tab2", "t", "Table", "plain", "", 1, None, None, None, None, None, None),
    ], element)
    made = structure.to_nodes(rows)
    got = {r["node_id"]: r for r in made.collect()}
    assert {n: r["kind"] for n, r in got.items()} == {"t": "text", "tab": "table", "img": "image", "c": "composite", "tab2": "table"}
    assert (got["tab"]["text"], got["tab2"]["text"], got["tab2"]["table_html"]) == ("<table/>", "plain", None)
    assert got["img"]["parent_id"] is None and got["tab"]["parent_id"] == "t"
    assert got["t"]["filename"] == "d/f.pdf" and got["t"]["page_numbers"] == [1] and got["img"]["page_numbers"] is None
    assert [(r["node_id"], r["text"]) for r in structure.composite_parts(made).orderBy("part").collect()] == [("c/0", "x"), ("c/1", "y")]


def test_hidden_keys(spark):
    row = spark.sql("SELECT map('title', 'T', 'filename', 'f', 'b', null) m").select(structure.visible(F.col("m"), structure.HIDDEN_FROM_LLM), structure.kept_keys(F.col("m"), ["b"])).first()
    assert row[0] == "title: T" and row[1] == {"b": None}


def pages(spark, rows):
    return spark.createDataFrame([(1, i, f"n{i}", kind, None, text, [page]) for i, (page, kind, text) in enumerate(rows)], NODES + ", page_numbers array<int>")


def left_over(spark, rows):
    return {r["node_id"]: r["text"] for r in boilerplate.remove_repeated(pages(spark, rows)).collect()}


def test_repeated_headers_go(spark):
    body = [(p, "NarrativeText", f"{w} entirely different body {w * 3}") for p in (1, 2) for w in ("alpha", "omega", "gamma")]
    one = [(1, "Header", "ACME Corp Annual Report 2023"), (1, "Title", "Introduction"), *body[:3], (1, "Image", "same"), (1, "Table", "same")]
    two = [(2, "Header", "ACME Corp Annual Report 2024"), (2, "Title", "Conclusion"), *body[3:], (2, "Image", "same"), (2, "Footer", "Page 3")]
    kept = left_over(spark, one + two)
    texts = list(kept.values())
    assert "Introduction" in texts and "Conclusion" in texts and texts.count("same") == 3
    assert not any("ACME" in t or t == "Page 3" for t in texts)


def test_equal_candidates_on_one_page_go_and_others_stay(spark):
    kept = left_over(spark, [(1, "NarrativeText", "twice"), (1, "NarrativeText", "twice"), (1, "Title", "other words")])
    assert set(kept.values()) == {"other words"}
    middle = [(p, "NarrativeText", f"{p}{i}" * 9 if i != 4 else "in the middle") for p in (1, 2) for i in range(9)]
    assert list(left_over(spark, middle).values()).count("in the middle") == 2


def brute_repeated(rows, alike=80.0):
    from docloom.functions.fuzzy import indel_ratio

    gone = set()
    for i, (za, a) in enumerate(rows):
        for j, (zb, b) in enumerate(rows):
            if i != j and za == zb and (a == b or indel_ratio(a, b) >= alike):
                gone.add(i)
    return gone


def test_alike_candidates_by_brute_force(spark):
    draw = random.Random(3)
    words = ["report", "annual", "page", "chapter", "one", "two"]
    rows = [(draw.choice(["header", "footer"]), " ".join(draw.choices(words, k=draw.randint(1, 4))) + draw.choice(["", "1", "22"])) for _ in range(120)]
    found = spark.createDataFrame([(1, z, str(i), t) for i, (z, t) in enumerate(rows)], "doc_id long, zone string, node_id string, text string")
    got = {int(r["node_id"]) for r in boilerplate.repeated_exact(found).union(boilerplate.repeated_alike(found)).collect()}
    assert got == brute_repeated(rows)


def test_text_and_html_readers(spark):
    docs = spark.createDataFrame([(1, "A title\n\nSome text, that ends.\n- item\na | b | c |"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r["seq"], r["category"], r["parent_id"]) for r in readers.text_elements(docs).orderBy("seq").collect()]
    assert got == [(0, "Title", None), (2, "NarrativeText", "1:0"), (3, "ListItem", "1:0"), (4, "Table", "1:0")]
    html = "<html><head><title>x</title><script>var t='<p>no</p>'</script></head><body><nav><ul><li><a href='/a'>A</a></li></ul></nav><!-- c --><h1>T</h1><p><b>bold</b><br>x<p>two &amp; three</p><footer>f</footer></body></html>"
    rows = readers.html_elements(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("seq").collect()
    assert [(r["category"], r["text"], r["parent_id"]) for r in rows] == [("Header", "A", None), ("Title", "T", None), ("NarrativeText", "bold x", "1:1"), ("NarrativeText", "two & three", "1:1"), ("Footer", "f", None)]
    assert rows[0]["link_urls"] == ["/a"] and rows[2]["emphasized_text_contents"] == ["bold"]


def test_ingest_keeps_words(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    out = ingest(readers.text_elements(docs), adders=())
    assert out.count() > 0
    assert out.where("next_id is null").count() == out.select("doc_id").distinct().count()
