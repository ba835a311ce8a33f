import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import quotations as qt

MESSAGES = [
    (1, 0, "user", "How do I   bake bread?\n\nThanks"),
    (1, 1, "assistant", "On Monday user wrote:\n> How do I bake BREAD?\n\nWith flour."),
    (1, 2, "user", "> > How do I bake bread?\n> With flour.\nWhich flour?\n> nobody said this"),
    (1, 3, "user", "Unrelated"),
    (1, 4, "assistant", ">Unrelated\nOk.\n  >> deep\n>\n"),
    (1, 5, "user", ">> Which flour?\n> thanks\nLate reply"),
    (2, 0, "user", "> How do I bake bread?\nother conversation"),
    (2, 1, "user", "thanks\n> thanks"),
    (None, 3, "user", "> x\ny"),
    (3, None, "user", "x"),
    (4, 1, None, None),
    (4, 1, None, None),
    (5, 0, "user", ""),
    (6, 0, "user", "a" * 200000 + "\nend"),
    (6, 1, "user", "> end\nfine"),
]


def frame(spark, rows=MESSAGES):
    wide = [(*r, "clash", 7) for r in rows]
    return spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, root string, level int")


def test_threads_and_texts(spark):
    got = {(r["conv_id"], r["turn"]): r for r in qt.reply_order(frame(spark)).collect()}
    said = lambda c, t: (got[c, t]["reply_to"], got[c, t]["root"], got[c, t]["depth"], got[c, t]["own_text"])
    assert said(1, 0) == (None, 0, 0, "How do I   bake bread?\n\nThanks")
    assert said(1, 1) == (0, 0, 1, "With flour.")
    assert said(1, 2) == (1, 0, 2, "Which flour?")
    assert said(1, 3) == (None, 3, 0, "Unrelated")
    assert said(1, 4) == (3, 3, 1, "Ok.")
    assert said(1, 5) == (0, 0, 1, "Late reply")  # level 1 goes before level 2
    assert (got[1, 2]["n_quotes"], got[1, 2]["n_linked"]) == (3, 2)
    assert said(2, 0)[:3] == (None, 0, 0)  # another conversation's message isn't its original
    assert said(2, 1)[:3] == (None, 1, 0)  # nor is a message its own
    assert said(6, 1)[:3] == (0, 0, 1)
    assert [t for _, t in sorted((got[1, t]["position"], t) for t in range(6))] == [0, 1, 2, 5, 3, 4]


def test_links_of_nested_levels(spark):
    links = {(r["turn"], r["passage"]): (r["level"], r["original"]) for r in qt.link_quotes(frame(spark)).where("conv = 1").collect()}
    assert links[2, 0] == (2, 0) and links[2, 1] == (1, 1) and links[2, 2] == (1, None)


TRIMMED = [
    (1, 0, "user", "thanks"),
    (1, 1, "user", "one\ntwo\nthree\n\nfour\n\nfive\nsix"),
    (1, 2, "user", "> two\n> three\nyes"),
    (1, 3, "user", "> one\n> two\n> three\n>\n> Four\nno"),
    (1, 4, "user", "> five\n> changed\nwhy"),
    (1, 5, "user", "> thanks\n> five\n> six\nagain"),
    (1, 6, "user", "> thanks\n> yes\nfirst of two"),
    (1, 7, "user", "> later\n> never\nlost"),
    (1, 8, "user", "later"),
]


def planted():
    """Conversations in which messages quote whole texts, paragraphs, lines and runs of lines of earlier ones, nested or not."""
    draw = random.Random(8)
    rows = []
    for c in range(40):
        said = []
        for t in range(draw.randint(1, 12)):
            own = "\n\n".join("\n".join(f"line {draw.randint(0, 60)} of {c}" for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(1, 3)))
            lines = []
            for _ in range(draw.randint(0, 2) if said else 0):
                of = draw.choice(said).split("\n")
                start = draw.randrange(len(of))
                run = draw.choice([of, of[start : start + draw.randint(1, 4)]])
                mark = draw.choice(["> ", ">", ">> ", "> > "])
                lines += [mark + x for x in run] + draw.choice([[], [""]])
            rows.append((c, t, draw.choice(["user", "assistant", None]), "\n".join([*lines, own])))
            said.append(own)
    return rows


@pytest.mark.parametrize("messages", [MESSAGES, TRIMMED, planted()], ids=["odd", "trimmed", "planted"])
def test_sql_agrees(spark, tmp_path, messages):
    spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = qt.op6_quotation_links(spark, str(tmp_path))
    truth = con.sql(qt.OP6_SQL)
    names = sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(names) == sorted(truth.columns)
    rows = got.select(*names).collect()
    assert sorted(map(key, truth.select(*names).fetchall())) == sorted(map(key, map(tuple, rows)))
    assert any(r["reply_to"] is not None for r in rows)


def test_a_long_chain_and_a_large_conversation(spark):
    chain = spark.range(60).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("> line "), F.col("id") - 1, F.lit("\nline "), F.col("id")).alias("text"))
    got = {r["turn"]: r for r in qt.reply_order(chain).collect()}
    assert all((got[t]["root"], got[t]["depth"], got[t]["position"]) == (0, t, t) for t in range(60))


def test_empty_table(spark):
    assert qt.reply_order(frame(spark).limit(0)).collect() == []


def test_trimmed_quotes(spark):
    """Two of three lines of a paragraph, two of three paragraphs, one line of two, and parts of two messages."""
    got = {r["turn"]: r for r in qt.reply_order(frame(spark, TRIMMED)).collect()}
    assert {t: r["reply_to"] for t, r in got.items()} == {0: None, 1: None, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0, 7: None, 8: None}
    assert all((got[t]["n_quotes"], got[t]["n_linked"]) == (1, 1) for t in range(2, 7)) and got[3]["own_text"] == "no"
