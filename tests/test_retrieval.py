import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import cite, dense_index, enrich, fusion, observe, postprocess, retrieval, split, structure
from docloom.plans import documents as plans
from docloom.sources import readers, stores

LIST = "query_id long, node_id string, score double"


def fused(spark, a, b, **kw):
    rows = fusion.fuse(spark.createDataFrame([(1, n, s) for n, s in a], LIST), spark.createDataFrame([(1, n, s) for n, s in b], LIST), **kw)
    return [(r["node_id"], r["score"]) for r in rows.orderBy("rank").collect()]


def test_fusion_as_worked_by_hand(spark):
    b = [("y", 8.0), ("w", 2.0)]
    assert fused(spark, [("x", 0.9), ("y", 0.5), ("z", 0.1)], b, weight=0.6) == [("y", 0.566667), ("x", 0.422474), ("z", 0.177526), ("w", 0.133333)]
    assert fused(spark, [("x", 0.9)], b, weight=0.6) == [("x", 0.54), ("y", 0.266667), ("w", 0.133333)]
    assert fused(spark, [], b, weight=0.6) == [("y", 0.266667), ("w", 0.133333)]
    assert fused(spark, [("x", None), ("y", float("nan"))], [], weight=0.6) == [("x", 0.0), ("y", 0.0)]
    assert fused(spark, [("x", 1.0), ("y", 1.0)], [("w", 1.5)], weight=0.6) == [("x", 0.6), ("y", 0.6), ("w", 0.6)]
    assert fused(spark, [("x", 0.9), ("y", 0.1)], b, weight=0.5, distribution=False, top_k=1) == [("x", 0.5)]
    assert fused(spark, [("x", 0.9)], b, top_k=0) == []


def test_fusion_ties_go_to_the_first_list(spark):
    assert fused(spark, [("z", 2.0)], [("a", 2.0)], weight=0.5) == [("z", 1.0), ("a", 1.0)]


def test_fusion_rejects_bad_parameters(spark):
    empty = spark.createDataFrame([], LIST)
    for kw in ({"weight": 1.2}, {"weight": -0.1}, {"top_k": -1}):
        with pytest.raises(ValueError):
            fusion.fuse(empty, empty, **kw)


@settings(max_examples=50)
@given(st.floats(0, 1), st.floats(-9, 9), st.floats(-9, 9))
def test_weights_bound_a_combination(weight, a, b):
    assert min(a, b) - 1e-9 <= weight * a + (1 - weight) * b <= max(a, b) + 1e-9


HIERARCHY = "node_id string, parent_id string, prev_id string, next_id string"


def results(spark, rows):
    return spark.createDataFrame([(1, n, s, i + 1) for i, (n, s) in enumerate(rows)], LIST + ", rank int")


def listed(df):
    return [(r["node_id"], r["score"]) for r in df.orderBy("rank").collect()]


def test_gaps_fill(spark):
    chain = spark.createDataFrame([("A", None, None, "B"), ("B", None, "A", "C"), ("C", None, "B", None)], HIERARCHY)
    assert listed(retrieval.fill_gaps(results(spark, [("A", 0.9), ("C", 0.7)]), chain)) == [("A", 0.9), ("B", pytest.approx(0.8)), ("C", 0.7)]
    assert listed(retrieval.fill_gaps(results(spark, [("C", 0.9), ("A", 0.7)]), chain)) == [("C", 0.9), ("A", 0.7)]
    assert listed(retrieval.fill_gaps(results(spark, [("A", 0.9), ("C", 0.7), ("B", 0.1)]), chain)) == [("A", 0.9), ("C", 0.7), ("B", 0.1)]


def test_children_merge(spark):
    family = spark.createDataFrame([(c, "P", None, None) for c in "abc"] + [(c, "Q", None, None) for c in "de"] + [("P", None, None, None), ("Q", None, None, None)], HIERARCHY)
    assert listed(retrieval.merge_up(results(spark, [("a", 0.8), ("d", 0.7), ("b", 0.6)]), family)) == [("d", 0.7), ("P", pytest.approx(0.7))]
    assert listed(retrieval.merge_up(results(spark, [("a", 0.8), ("b", None)]), family)) == [("P", pytest.approx(0.4))]
    assert listed(retrieval.merge_up(results(spark, [("a", 0.8), ("b", 0.6), ("P", 0.1)]), family)) == [("P", 0.1)]


def test_filling_may_lead_to_merging(spark):
    rows = [("a", "P", None, "b"), ("b", "P", "a", "c"), ("c", "P", "b", "d"), ("d", "P", "c", None), ("P", None, None, None)]
    settled = retrieval.settle(results(spark, [("a", 0.9), ("c", 0.7)]), spark.createDataFrame(rows, HIERARCHY))
    assert listed(settled) == [("P", pytest.approx(0.8))]


def test_dense_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense_index, "GROUP", 3)
    monkeypatch.setattr(dense_index, "BLOCK", 16)
    monkeypatch.setattr(dense_index, "PER_CENTRE", 20)
    x = np.random.default_rng(0).standard_normal((200, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0])], "node_id long, embedding array<float>").repartition(3)
    queries = vectors.where("node_id < 7").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    scores = np.round(unit[:7] @ unit.T, 6)
    got = {}
    for r in retrieval.dense_top_k(vectors, queries, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["node_id"], r["score"]))
    for q in range(7):
        truth = sorted(range(200), key=lambda j: (-scores[q, j], j))[:5]
        assert [n for _, n, _ in sorted(got[q])] == truth
    assert retrieval.dense_top_k(vectors, queries.limit(0), 5).collect() == []


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "apple banana"), (2, "apple apple apple"), (3, "cherry banana"), (4, None), (5, "")], "node_id long, text string")
    got = retrieval.bm25_top_k(docs, spark.createDataFrame([(1, "Cherry, apple!"), (2, "nothing here")], "query_id long, query_text string"), 2)
    assert [(r["query_id"], r["node_id"]) for r in got.orderBy("rank").collect()] == [(1, 3), (1, 2)]


def test_post_processing(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, "one two", "One two three. Other words here. One more. And so on. Last."), (1, "b", None, "one two", "nothing"), (1, "c", 0.001, "one two", "one")], LIST + ", query_text string, text string")
    assert {r["node_id"] for r in postprocess.similarity_cutoff(rows).collect()} == {"a"}
    assert [r["node_id"] for r in postprocess.rerank(rows, 2).orderBy("rank").collect()] == ["c", "a"]
    assert {r["node_id"]: r["text"] for r in postprocess.prune_sentences(rows).collect()}["a"] == "One two three."
    assert postprocess.apply_steps(rows, None).count() == 3


def test_splitting_and_packing(spark):
    docs = spark.createDataFrame([(1, "Cats purr. Cats sleep. Cats eat. Stars shine. Stars burn. Stars fade."), (2, None), (3, "")], "doc_id long, text string")
    groups = split.semantic_groups(docs, around=0).orderBy("group").collect()
    assert " ".join(r["text"] for r in groups if r["doc_id"] == 1) == docs.first()["text"]
    windows = split.sentence_windows(docs, 1).where("doc_id = 1").orderBy("n").collect()
    assert windows[1]["window"] == "Cats purr. Cats sleep. Cats eat." and windows[1]["original_text"] == "Cats sleep."
    contexts = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([30, 40, 50, 200, 10])], "query_id long, rank int, text string")
    assert [(r["pack"], r["n_contexts"]) for r in split.compact(contexts, 100).orderBy("pack").collect()] == [(0, 2), (1, 1), (2, 1), (3, 1)]


def test_enrichment(spark):
    rows = spark.createDataFrame([(1, 0, "write to a@b.co at 7am", "kept"), (1, 1, None, "kept")], "doc_id long, seq int, text string, mail string")
    found = enrich.pattern_adder("mail", "[a-z]+@[a-z.]+", "contains")(rows.withColumn("mail", F.lit(None).cast("boolean")))
    assert [r["mail"] for r in found.orderBy("seq").collect()] == [True, None]
    assert [r["t"] for r in enrich.pattern_adder("t", "[0-9]am")(rows).orderBy("seq").collect()] == [["7am"], None]
    assert [r["t"] for r in enrich.pattern_adder("t", "write", "match")(rows).orderBy("seq").collect()] == [True, None]
    keyed = enrich.keyword_adder(3)(spark.createDataFrame([(1, 0, "Apache Spark runs SQL. Spark scales."), (1, 1, "")], "doc_id long, seq int, text string"))
    assert "spark" in enrich.document_keywords(keyed).first()["keywords"]
    summary = enrich.tree_summary(spark.createDataFrame([(1, i, f"Spark sentence {i} is here. Filler.") for i in range(25)], "doc_id long, seq int, text string")).first()
    assert summary["summary"] and summary["summary_oneline"] in summary["summary"]
    tables = spark.createDataFrame([("<table><tr><td>Sales grew</td></tr></table>", "<table><tr><td>Sales grew</td></tr></table>"), ("x", None)], "text string, table_html string")
    assert [r["table_summary"] for r in enrich.table_summaries(tables).collect()] == ["Sales grew.", None]
    pictures = spark.createDataFrame([(1, "p", 0, b"x", 100), (1, "p", 1, b"y", 10), (1, "q", 0, None, None)], "doc_id long, parent_id string, part int, image binary, image_width int")
    captions = enrich.image_summaries(pictures, lambda image: F.concat(F.lit("pic "), F.hex(image)))
    assert [tuple(r) for r in enrich.composite_image_summaries(captions).collect()] == [(1, "p", "pic 78")]


def test_summaries_of_any_depth(spark):
    """A counting summariser shows that no group is wider than allowed, and that each level is made of the one below."""
    lengths = {1: 1, 2: 4, 3: 5, 4: 64, 5: 65, 6: 1000}
    rows = [(d, i, f"{d}-{i}") for d, n in lengths.items() for i in range(n)]
    counted = lambda texts: F.concat(F.lit("("), F.array_join(texts, " "), F.lit(")"))
    got = {r["doc_id"]: r["summary"] for r in enrich.tree_summary(spark.createDataFrame(rows, "doc_id long, seq int, text string"), counted, 4).collect()}

    def nested(items):
        return "(" + " ".join(items) + ")"

    for d, n in lengths.items():
        level = [f"{d}-{i}" for i in range(n)]
        while True:
            level = [nested(level[i : i + 4]) for i in range(0, len(level), 4)]
            if len(level) == 1:
                break
        assert got[d] == level[0]
    with pytest.raises(ValueError):
        enrich.tree_summary(spark.createDataFrame(rows, "doc_id long, seq int, text string"), counted, 1)


def test_citations(spark):
    text = "Long introduction with many words before it. The engine quotes its sources word for word. More text follows after it."
    sources = spark.createDataFrame([(1, "n1", text, "doc", [3], 0.9, 1, {"a": "b"}), (1, "n2", text, "doc2", [4], 0.8, 2, {"a": "b"}), (1, "n3", "unknown", "d", [1], 0.1, 3, {}), (2, "n1", text, "doc", [3], 0.9, 1, {"a": "b"})], "query_id long, node_id string, text string, name string, page_numbers array<int>, score double, rank int, extra map<string,string>")
    responses = spark.createDataFrame([(1, "The engine quotes its sources word for word. Completely unrelated statement about zebras."), (2, ""), (3, "No sources.")], "query_id long, response string")
    got = {r["query_id"]: r for r in cite.cite(responses, sources).collect()}
    assert len(got[1]["citations"]) == 1 and got[1]["citations"][0]["node_id"] == "n1"
    assert got[1]["response"].count("[0]") == 1
    assert cite.without_tags(got[1]["response"]) == responses.first()["response"]
    snippet = got[1]["citations"][0]["snippet"]
    assert "|||||The engine quotes its sources word for word.|||||" in snippet and snippet.endswith("(doc) p. 3")
    assert got[2]["response"] == "" and got[3]["response"] == "No sources." and got[3]["citations"] is None
    assert "Citations" in {r["query_id"]: r["response"] for r in cite.with_citations(cite.cite(responses, sources)).collect()}[1]
    assert [r["node_id"] for r in cite.cited_nodes(responses, sources).collect()] == ["n1"]


def test_nearest_whitespace():
    assert cite.nearest_whitespace("ab cd ef", 4, True) == 2 and cite.nearest_whitespace("ab cd ef", 4) == 5
    assert cite.nearest_whitespace("ab cd ef", 1, True) == 0 and cite.nearest_whitespace("ab cd ef", 7) == 8
    for i in (8, -1):
        with pytest.raises(IndexError):
            cite.nearest_whitespace("ab cd ef", i)


def test_span_trees(spark):
    events = spark.createDataFrame([(1, "s1", 2, "x"), (2, "s1", 1, "y"), (3, None, 3, "z"), (1, "s1", 2, "x")], "event_id long, span_id string, ts int, event_type string")
    once = observe.distinct_events(events)
    assert once.count() == 3
    shown = observe.displayed(observe.span_trees(once)).orderBy("place").collect()
    assert [(r["level"], r["ts"], r["event_id"]) for r in shown] == [(0, 2, None), (1, 1, 2), (1, 2, 1)]
    assert observe.of_kinds(once, ["y"]).count() == 1
    spans = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "zz"), ("e", "c")], "span_id string, parent_id string")
    assert {r["span_id"]: r["depth"] for r in observe.with_depth(spans).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 3}
    assert spark.range(1).select(observe.displayed_node(F.lit("n"), F.lit(0.5), F.lit(" t "))).first()[0] == "[n] 0.5000 t"
    lines = spark.range(1).select(observe.displayed_nodes(F.array(F.struct(F.lit("a").alias("node_id"), F.lit(1.0).alias("score"), F.lit("x").alias("text")), F.struct(F.lit("b").alias("node_id"), F.lit(None).cast("double").alias("score"), F.lit("y").alias("text"))))).first()[0]
    assert lines == "[a] 1.0000 x\n[b] - y"
    staged = observe.by_stage(spark.createDataFrame([("RetrievalStart",), ("LLMChatEndEvent",), ("StreamChatErrorEvent",), ("other",), (None,)], "event_type string")).collect()
    assert [r["stage"] for r in staged] == ["retrieval", "llm", "chat", None, None]
    assert sum(map(len, observe.KINDS.values())) == 28
    with pytest.raises(ValueError, match="ancestors"):
        observe.with_depth(spark.createDataFrame([("a", "b"), ("b", "a")], "span_id string, parent_id string"))


def test_tools_and_routes(spark):
    docs = spark.createDataFrame([(1, "about cats", ["engine"]), (2, "about dogs", [])], "doc_id long, summary_oneline string, built array<string>")
    assert [(r["doc_id"], r["tool_id"]) for r in plans.document_tools(docs, ("engine", "summary"), "built").collect()] == [(1, "1/engine")]
    assert plans.document_tools(docs, ("telepathy",)).collect() == []
    assert [r["doc_id"] for r in plans.route(spark.createDataFrame([(1, "which cats")], "query_id long, query_text string"), docs).collect()] == [1]
    parts = plans.sub_questions(spark.createDataFrame([(1, "What is it? Who made it?")], "query_id long, query_text string"))
    assert [r["query_text"] for r in parts.orderBy("sub_id").collect()] == ["What is it?", "Who made it?"]


def test_answers_are_refined_over_packs(spark):
    results = spark.createDataFrame([(1, f"n{i}", 1.0, i, "q", t) for i, t in enumerate(["Alpha beta gamma. " * 3, "Delta epsilon zeta eta."])], LIST + ", rank int, query_text string, text string")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r["query_id"]: r["response"] for r in plans.answer(results, queries, steps=(), budget=60).collect()}
    assert got[1].count(".") == 3
    assert got[2] is None


def test_ask_cites_only_what_sources_say(spark):
    docs = spark.createDataFrame([(1, "The heron nests in tall reeds near the lake. It eats fish."), (2, "Granite is an igneous rock. It cools slowly underground.")], "doc_id long, text string")
    nodes = plans.ingest(readers.text_elements(docs), adders=())
    answers = plans.ask(nodes, plans.embed(nodes), spark.createDataFrame([(1, "Where does the heron nest?")], "query_id long, query_text string")).collect()
    assert "heron" in answers[0]["response"]
    texts = [r["text"] for r in nodes.collect()]
    for c in answers[0]["citations"]:
        quoted = c["snippet"].split(cite.FENCE)[1]
        assert any(quoted in t for t in texts)
    whole = plans.ask_by_parts(nodes, plans.embed(nodes), spark.createDataFrame([(1, "Where does the heron nest? What is granite?")], "query_id long, query_text string")).collect()
    assert "heron" in whole[0]["response"] and "ranite" in whole[0]["response"]


def test_stores(spark, tmp_path):
    nodes = spark.createDataFrame([(i, f"n{i}", "x") for i in range(50)], "doc_id long, node_id string, text string")
    path = str(tmp_path / "nodes")
    stores.write_nodes(nodes, path)
    assert stores.read_nodes(spark, path).count() == 50
    assert [r["node_id"] for r in stores.read_nodes(spark, path, [7]).collect()] == ["n7"]
    assert stores.lookup(nodes, spark.createDataFrame([("n1",), ("n1",), ("zz",)], "node_id string")).count() == 1
    log = str(tmp_path / "log")
    for turn in (1, 0):
        stores.append_messages(spark.createDataFrame([(1, turn, "user", f"t{turn}")], "conv_id long, turn int, role string, content string"), log)
    assert [r["turn"] for r in stores.replay(spark, log).collect()] == [0, 1]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A title\nSome text here, and more.")
    (tmp_path / "b.html").write_text("<h1>T</h1><p>x</p>")
    (tmp_path / "c.jpg").write_bytes(b"jpeg")
    assert readers.read_files(spark, str(tmp_path), "*.txt").first()["filename"] == "a.txt"
    assert readers.text_files(spark, str(tmp_path / "a.txt")).count() == 2
    assert readers.html_files(spark, str(tmp_path / "b.html")).count() == 2
    files = readers.read_files(spark, str(tmp_path), "*.jpg")
    elements = spark.createDataFrame([("e1", "Image", files.first()["path"], None), ("e2", "Image", None, "eA=="), ("e3", "Title", None, None)], "element_id string, category string, image_path string, image_base64 string")
    assert {r["element_id"]: r["image"] and bytes(r["image"]) for r in readers.with_images(elements, files).collect()} == {"e1": b"jpeg", "e2": b"x", "e3": None}
    seen = spark.createDataFrame([("a.txt",)], "filename string")
    assert readers.unseen(readers.read_files(spark, str(tmp_path)), seen).count() == 2
    names = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "filename string, seq int, v string")
    assert readers.latest_by_name(names).first()["v"] == "new"


def animals(spark):
    texts = ["# Herons\nThe heron nests in high trees near rivers. It fishes at dawn.", "# Rocks\nGranite is a hard rock of quartz and feldspar. It forms underground."]
    return readers.text_elements(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_parts_of_a_question_go_to_their_documents(spark, tmp_path):
    nodes, vectors, _ = plans.build_index(animals(spark), str(tmp_path / "index"))
    described = spark.createDataFrame([(0, "herons and where they nest"), (1, "granite and other rock")], "doc_id long, summary_oneline string")
    queries = spark.createDataFrame([(1, "Where does the heron nest? What rock is granite?"), (2, "zzz")], "query_id long, query_text string")
    got = {r["query_id"]: r for r in plans.ask_tools(nodes, vectors, described, queries).collect()}
    assert [(p["question"], p["documents"]) for p in got[1]["parts"]] == [("Where does the heron nest?", [0]), ("What rock is granite?", [1])]
    assert "heron" in got[1]["parts"][0]["answer"] and "Granite" in got[1]["parts"][1]["answer"]
    assert "heron" in got[1]["response"] and "Granite" in got[1]["response"]
    assert len(got[1]["citations"]) >= 2
    assert got[2]["response"] is None and got[2]["parts"][0]["documents"] is None


def test_factories_and_stored_index(spark, tmp_path):
    path = str(tmp_path / "index")
    nodes, vectors, documents = plans.build_index(animals(spark), path)
    again = plans.load_index(spark, path)
    assert [x.count() for x in again] == [nodes.count(), vectors.count(), 2] and documents.columns == again[2].columns
    queries = spark.createDataFrame([(1, "heron nests in trees")], "query_id long, query_text string")
    results = plans.get_retriever(nodes, vectors, dense_k=2, sparse_k=2, fused_k=1)(queries)
    assert ["heron" in r["text"] for r in results.collect()] == [True]
    answer = plans.get_engine(nodes, vectors)(queries).first()
    assert "heron" in answer["response"]
    sources = results.select("query_id", "node_id", "text", "score", "rank")
    response = spark.createDataFrame([(1, "The heron nests in high trees near rivers.")], "query_id long, response string")
    assert "----- Citations -----" in plans.get_citation_builder(listed=True)(response, sources).first()["response"]
    assert "----- Citations -----" not in plans.get_citation_builder()(response, sources).first()["response"]


def test_models_are_loaded_once_a_worker(spark):
    def load():
        import os
        import time

        born = f"{os.getpid()}-{time.time_ns()}"
        return lambda batch: [f"{born}:{len(x or '')}" for x in batch]

    from docloom.functions.models import model_column

    embed = model_column(load, "string")
    rows = spark.range(4000).repartition(8).select(embed(F.repeat(F.lit("x"), F.col("id").cast("int") % 5)).alias("v")).collect()
    born = {r["v"].split(":")[0] for r in rows}
    assert len(born) == len({b.split("-")[0] for b in born}) and {r["v"].split(":")[1] for r in rows} == set("01234")
    scorer = model_column(lambda: lambda pairs: [float(len(a) + len(b)) for a, b in pairs], "double")
    assert spark.sql("select 'ab' a, 'c' b").select(scorer(F.col("a"), F.col("b"))).first()[0] == 3.0


def test_kinds_of_pictures(spark):
    begins = {"ffd8ffe0": "image/jpeg", "89504e470d0a": "image/png", "474946383961": "image/gif", "52494646000000005745425020": "image/webp", "00": None}
    rows = spark.createDataFrame([(bytes.fromhex(b), k) for b, k in begins.items()], "c binary, k string").select(readers.image_kind(F.col("c")).alias("found"), "k").collect()
    assert all(r["found"] == r["k"] for r in rows)


def test_composites_of_composites_and_kept_metadata(spark):
    inner = "struct<text:string,category:string,text_as_html:string>"
    schema = f"doc_id long, seq int, element_id string, parent_id string, category string, text string, section string, detection_class_prob double, sent_to array<string>, orig_elements array<struct<text:string,category:string,text_as_html:string,orig_elements:array<{inner}>>>"
    rows = [(1, 0, "c", None, "CompositeElement", "all", "s1", 0.5, ["x"], [("a", "Title", None, None), ("b", "CompositeElement", None, [("t", "Table", "<table/>"), ("u", "Table", None)])]), (1, 1, "d", None, "Title", "plain", None, None, None, None)]
    nodes = structure.to_nodes(spark.createDataFrame(rows, schema))
    assert [(r["section"], r["detection_class_prob"], r["sent_to"]) for r in nodes.orderBy("seq").collect()] == [("s1", 0.5, ["x"]), (None, None, None)]
    parts = {r["node_id"]: r for r in structure.composite_parts(nodes).collect()}
    assert {k: (r["parent_id"], r["type"], r["text"], r["prev_id"], r["next_id"]) for k, r in parts.items()} == {
        "c/0": ("c", "Title", "a", None, "c/1"),
        "c/1": ("c", "CompositeElement", "b", "c/0", None),
        "c/1/0": ("c/1", "Table", "<table/>", None, "c/1/1"),
        "c/1/1": ("c/1", "Table", "u", "c/1/0", None),
    }


def test_zero_vectors_hide_no_neighbour(spark):
    """More zero vectors than k in a chunk, and only negative cosines besides."""
    rows = [(i, [0.0, 0.0]) for i in range(20)] + [(100 + i, [-1.0, float(i)]) for i in range(3)]
    vectors = spark.createDataFrame(rows, "node_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vec array<double>")
    assert [r["node_id"] for r in retrieval.dense_top_k(vectors, asked, 5).orderBy("rank").collect()] == [102, 101, 100]
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "node_id long, embedding array<double>").coalesce(1)
    assert [r["node_id"] for r in retrieval.dense_top_k(same, asked, 3, skip_own=True).orderBy("rank").collect()] == [0, 2, 3]
