"""What queries shuffle and leave on disk."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import combine, structure
from docloom.plans import documents as plans
from docloom.plans.queries import QUERIES
from docloom.session import kept, materialise, run_dir
from docloom.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def labels(spark):
    """What is in the run's folder, with numbers instead of names."""
    return {p.name: p.name.rsplit("-", 1)[0] for p in Path(run_dir(spark).removeprefix("file://")).glob("*-*")}


def left_by(spark, run):
    before = labels(spark)
    run()
    return sorted(label for name, label in labels(spark).items() if name not in before)


def test_lines_and_their_nodes_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "Head\n\none.\nTwo\nthree.\n \n"), (2, "a.\nb.\nEnd"), (3, ""), (4, None), (5, " \n \n")], "doc_id long, text string")
    nodes = structure.to_nodes(readers.text_elements(docs), parents_there=True)
    assert "Exchange" not in plan(nodes)
    rows = sorted(map(tuple, nodes.select("doc_id", "seq", "type", "parent_id", "text").collect()))
    assert rows == [
        (1, 0, "Title", None, "Head"), (1, 2, "NarrativeText", "1:0", "one."), (1, 3, "Title", None, "Two"), (1, 4, "NarrativeText", "1:3", "three."),
        (2, 0, "NarrativeText", None, "a."), (2, 1, "NarrativeText", None, "b."), (2, 2, "Title", None, "End"),
    ]
    looked_up = structure.to_nodes(readers.text_elements(docs))
    assert sorted(map(str, looked_up.select(*nodes.columns).collect())) == sorted(map(str, nodes.collect()))


def test_runs_shuffle_texts_once(spark):
    nodes = structure.to_nodes(readers.text_elements(spark.createDataFrame([(1, "A\nB\nc.\nD")], "doc_id long, text string")), parents_there=True)
    assert plan(combine.merged(structure.runs(nodes, "Title"), "run", "last", "one_kept", dealt=True)).count("Exchange") == 1
    rows = combine.merge_titles(nodes).orderBy("seq").collect()
    assert [(r["node_id"], r["parent_id"], r["text"]) for r in rows] == [("1:1", None, "A\nB"), ("1:2", "1:1", "c."), ("1:3", None, "D")]


def test_pairs_of_question_and_document_stay_where_the_document_is(spark):
    questions = spark.createDataFrame([(1, "red fox"), (2, "blue sea")], "query_id long, query_text string")
    told = materialise(spark.createDataFrame([(7, "a red sea"), (8, "the fox is red"), (9, "none")], "doc_id long, summary_oneline string"), "told")
    routed = plans.route(questions, told, 1)
    assert not re.search(r"hashpartitioning\((?:query_id#\w+, doc_id|doc_id#\w+, query_id)", plan(routed))
    assert sorted((r["query_id"], r["doc_id"]) for r in routed.collect()) == [(1, 8), (2, 7)]


def test_only_the_result_is_kept(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    rows = []
    assert left_by(spark, lambda: rows.append(kept(spark, "result", lambda: materialise(spark.range(5), "step").where("id > 2")))) == ["result"]
    assert sorted(r["id"] for r in rows[0].collect()) == [3, 4] and spark.conf.get(setting, None) == before


def test_ingest_leaves_its_sections_only(spark, small_tables):
    assert left_by(spark, lambda: QUERIES["ingested_sections"](spark, small_tables)) == ["nodes"]


def test_answers_leave_texts_once(spark, small_tables):
    left = left_by(spark, lambda: QUERIES["cited_answers"](spark, small_tables))
    assert "sections" in left and not {"nodes", "merged-runs", "zoned", "zone-candidates", "zone-texts"} & set(left)


def test_abbreviations_side_by_side(spark):
    """As in the reference, each is found in the text as it was; the SQL misses the second of two."""
    row = spark.range(1).select(tx.clean_abbreviations(F.lit("no No. No. X")).alias("t")).first()
    assert row["t"] == "no NumberNumberX"
