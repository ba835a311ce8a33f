"""Quotation linking of messages, with DataFrame functions only.

A line that starts with ``>`` marks (blanks between them allowed) is quoted, at the level of their number. Runs of
lines of one level are passages; normalised (lower case, single spaces) they are named by their hash. A message's own
text is its unquoted lines; its units are that text, its paragraphs, and its lines. Inside a conversation a passage
belongs to the earliest message that has a unit of that hash, if that is earlier than the quoting one. A trimmed
passage, which as a whole is no unit, is taken apart: into its paragraphs, and if none of them has an original, into
its lines. Each part belongs to a message as a whole passage does, and the passage to the one with most of its parts,
of several such to the one with the first of them. A message replies to the original of its first resolved passage of
the lowest level. Threads follow from replies by pointer doubling, and a conversation's order is by thread (of the
earliest root first) and then by turn, so that every message comes after the one to which it replies. Texts come out without their quotes.

Lines are taken apart inside their row; only hashes of quoted passages, and of those units that some passage of the
same conversation has, are shuffled. The earliest unit is a minimum, so a phrase that everybody writes costs one row
per task, and the order inside a conversation is numbered over ranges, so a conversation may be of any size.

Defined results: a null text is empty; a message whose passages resolve to nothing, or without conversation or turn,
starts a thread of its own; a quotation mark alone is an empty passage and is dropped; an attribution line ("...
wrote:") directly above a quote goes with it; repeated rows are repeated in the result with places of their own; an
empty table gives an empty result. Other columns aren't read, so they can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.arrow import quoted
from docloom.llm.numbering import number_within
from docloom.session import materialise

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
ATTRIBUTION = r"(?i)^[^\n]*\bwrote:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\t-\r ]+", " "))


def lines_of(text: Column) -> Column:
    """The lines of a text with their quote level; attribution lines above a quote have level -1."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    parsed = F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("text")))
    above = F.concat(F.slice(parsed, F.lit(2), F.greatest(F.size(parsed) - 1, F.lit(0))), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("text"))))
    return F.zip_with(parsed, above, lambda x, nxt: F.struct(F.when((x.level == 0) & (nxt.level > 0) & x.text.rlike(ATTRIBUTION), -1).otherwise(x.level).alias("level"), x.text.alias("text")))


def own_text(lines: Column) -> Column:
    """Unquoted lines, without blank ones at either end."""
    kept = F.array_join(F.transform(F.filter(lines, lambda x: x.level == 0), lambda x: x.text), "\n")
    return F.regexp_replace(F.regexp_replace(kept, r"^(?:[ \t\r]*\n)+", ""), r"[ \t\r\n]+$", "")


def passages(lines: Column) -> Column:
    """Runs of quoted lines of one level, as (level, text), in order."""
    n = F.size(lines)
    at = F.sequence(F.lit(0), n - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get(lines, i).level != F.get(lines, i - 1).level))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(F.get(lines, s).level.alias("level"), F.array_join(F.transform(F.slice(lines, s + 1, e - s), lambda x: x.text), "\n").alias("text")))
    return F.filter(runs, lambda r: (r.level > 0) & r.text.rlike(r"[^\t-\r ]"))


def units(own: Column) -> Column:
    """Hashes of the text, its paragraphs and its lines."""
    parts = F.concat(F.array(own), F.split(own, r"\n[ \t\r]*\n"), F.split(own, "\n"))
    return F.array_distinct(F.transform(F.filter(F.transform(parts, normalised), lambda x: x != ""), F.md5))


def parts(text: Column) -> Column:
    """(kind, hash) of a passage's parts in order: 0 the whole, 1 its paragraphs, 2 its lines."""

    def named(kind: int, found: Column) -> Column:
        return F.transform(F.filter(F.transform(found, normalised), lambda x: x != ""), lambda x: F.struct(F.lit(kind).alias("kind"), F.md5(x).alias("hash")))

    return F.concat(named(0, F.array(text)), named(1, F.split(text, r"\n[ \t\r]*\n")), named(2, F.split(text, "\n")))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv, turn, passage, level, hash, original: every different quoted passage, with the turn of its original or null."""
    lines = lines_of(quoted(text_col))
    parsed = messages.select(quoted(conv_col).alias("conv"), quoted(turn_col).alias("turn"), lines.alias("lines"))
    quotes = parsed.where(F.exists("lines", lambda x: x.level > 0)).select("conv", "turn", F.posexplode(passages(F.col("lines"))).alias("passage", "p"))
    named = quotes.select("conv", "turn", "passage", F.col("p.level").alias("level"), parts(F.col("p.text")).alias("parts"))
    named = named.select("conv", "turn", "passage", "level", F.element_at("parts", 1).getField("hash").alias("hash"), F.posexplode("parts").alias("at", "part"))
    quotes = materialise(named.select("conv", "turn", "passage", "level", "hash", "at", F.col("part.kind").alias("kind"), F.col("part.hash").alias("part")), "quotes")
    wanted = materialise(quotes.select("conv", F.col("part").alias("hash")).distinct(), "wanted")
    had = parsed.select("conv", "turn", F.explode(units(own_text(F.col("lines")))).alias("hash")).join(wanted, ["conv", "hash"], "left_semi")
    originals = materialise(had.groupBy("conv", F.col("hash").alias("part")).agg(F.min("turn").alias("first_turn")), "originals")
    linked = quotes.join(originals, ["conv", "part"], "left").withColumn("original", F.when(F.col("first_turn") < F.col("turn"), F.col("first_turn")))
    passage = ["conv", "turn", "passage", "level", "hash"]
    found = linked.groupBy(*passage, "kind", "original").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = F.min(F.when(F.col("original").isNotNull(), F.struct("kind", (-F.col("n")).alias("n"), "at", "original"))).getField("original")
    return found.groupBy(*passage).agg(best.alias("original"))


def threads(replies: DataFrame) -> DataFrame:
    """From replies (conv, turn, parent): root and depth of every message that replies to one."""
    edges = materialise(replies.select("conv", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        above = edges.select("conv", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = edges.join(above, ["conv", "up"], "left")
        moved = joined.agg(F.count("next")).first()[0]
        if not moved:
            return edges.select("conv", "turn", F.col("up").alias("root"), "depth")
        edges = materialise(joined.select("conv", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "replies")


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every message with its own text, what it replies to, its thread, and its place in the conversation.

    Columns: ``conv_col``, ``turn_col``, ``role_col``, reply_to, root, depth, position, n_quotes, n_linked, own_text.
    """
    links = materialise(link_quotes(messages, conv_col, turn_col, text_col), "links")
    by_message = links.groupBy("conv", "turn").agg(
        F.min(F.when(F.col("original").isNotNull(), F.struct("level", "passage", "original"))).getField("original").alias("parent"),
        F.countDistinct("passage").alias("n_quotes"),
        F.countDistinct(F.when(F.col("original").isNotNull(), F.col("passage"))).alias("n_linked"),
    )
    by_message = materialise(by_message, "replying")
    placed = threads(by_message.where(F.col("parent").isNotNull()))
    found = materialise(by_message.join(placed, ["conv", "turn"], "left"), "threads").withColumnRenamed("conv", "c").withColumnRenamed("turn", "t")
    rows = messages.select(quoted(conv_col).alias("conv"), quoted(turn_col).alias("turn"), quoted(role_col).alias("role"), own_text(lines_of(quoted(text_col))).alias("own_text"))
    joined = rows.join(found, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    full = joined.select(
        "conv",
        "turn",
        "role",
        F.col("parent").alias("reply_to"),
        F.coalesce("root", "turn").alias("root"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "own_text",
        F.md5("own_text").alias("text_md5"),
    )
    numbered = number_within(full, ["conv"], ["root", "turn", "role", "text_md5"], "position")
    return numbered.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "reply_to", "root", "depth", "position", "n_quotes", "n_linked", "own_text")


def op6_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in reply order, without quotes."""
    return reply_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP6_SQL = r"""
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS m, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
split0 AS (SELECT m, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM raw),
split1 AS (SELECT m, conv_id, turn, pos, len(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS lv, regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '') AS line FROM split0),
lines AS (
  SELECT m, conv_id, turn, pos, line,
         CASE WHEN lv = 0 AND coalesce(lead(lv) OVER (PARTITION BY m ORDER BY pos), 0) > 0 AND regexp_matches(line, '(?i)^[^\n]*\bwrote:[ \t]*$') THEN -1 ELSE lv END AS level
  FROM split1),
own AS (
  SELECT m, any_value(conv_id) AS conv_id, any_value(turn) AS turn,
         regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), ''), '^(?:[ \t\r]*\n)+', ''), '[ \t\r\n]+$', '') AS own_text
  FROM lines GROUP BY m),
cut AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY m ORDER BY pos) THEN 0 ELSE 1 END AS starts FROM lines),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY m ORDER BY pos) AS run FROM cut),
runs AS (SELECT m, conv_id, turn, level, run, string_agg(line, chr(10) ORDER BY pos) AS text FROM numbered WHERE level > 0 GROUP BY ALL HAVING regexp_matches(string_agg(line, chr(10)), '[^\t-\r ]')),
quotes AS (SELECT *, md5(trim(regexp_replace(lower(text), '[\t-\r ]+', ' ', 'g'))) AS hash, row_number() OVER (PARTITION BY m ORDER BY run) AS passage FROM runs),
taken_apart AS (
  SELECT conv_id, turn, passage, level, hash, 0 AS kind, 1 AS pos, text AS part FROM quotes
  UNION ALL
  SELECT conv_id, turn, passage, level, hash, 1, generate_subscripts(regexp_split_to_array(text, '\n[ \t\r]*\n'), 1), unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM quotes
  UNION ALL
  SELECT conv_id, turn, passage, level, hash, 2, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM quotes),
parts AS (
  SELECT * EXCLUDE (part), md5(trim(regexp_replace(lower(part), '[\t-\r ]+', ' ', 'g'))) AS part_hash
  FROM taken_apart WHERE trim(regexp_replace(lower(part), '[\t-\r ]+', ' ', 'g')) <> ''),
units AS (
  SELECT conv_id, turn, unnest(list_concat([own_text], regexp_split_to_array(own_text, '\n[ \t\r]*\n'), string_split(own_text, chr(10)))) AS unit FROM own),
originals AS (
  SELECT conv_id, md5(trim(regexp_replace(lower(unit), '[\t-\r ]+', ' ', 'g'))) AS hash, min(turn) AS first_turn
  FROM units WHERE trim(regexp_replace(lower(unit), '[\t-\r ]+', ' ', 'g')) <> '' GROUP BY 1, 2),
votes AS (
  SELECT p.conv_id, p.turn, passage, level, p.hash, kind, CASE WHEN o.first_turn < p.turn THEN o.first_turn END AS original, count(*) AS n, min(pos) AS pos
  FROM parts p LEFT JOIN originals o ON p.conv_id = o.conv_id AND p.part_hash = o.hash GROUP BY ALL),
links AS (
  SELECT conv_id, turn, passage, level, hash, (list(original ORDER BY kind, n DESC, pos, original) FILTER (original IS NOT NULL))[1] AS original
  FROM votes GROUP BY ALL),
replying AS (
  SELECT conv_id, turn, (list(original ORDER BY level, passage, original) FILTER (original IS NOT NULL))[1] AS parent,
         count(DISTINCT passage) AS n_quotes, count(DISTINCT passage) FILTER (original IS NOT NULL) AS n_linked
  FROM links GROUP BY conv_id, turn),
climb AS (
  SELECT conv_id, turn, parent AS up, 1 AS depth FROM replying WHERE parent IS NOT NULL
  UNION ALL
  SELECT c.conv_id, c.turn, r.parent, c.depth + 1 FROM climb c JOIN replying r ON r.conv_id = c.conv_id AND r.turn = c.up WHERE r.parent IS NOT NULL),
roots AS (SELECT conv_id, turn, arg_max(up, depth) AS root, max(depth) AS depth FROM climb GROUP BY conv_id, turn),
joined AS (
  SELECT raw.m, raw.conv_id, raw.turn, raw.role, p.parent AS reply_to, coalesce(r.root, raw.turn) AS root, coalesce(r.depth, 0) AS depth,
         coalesce(p.n_quotes, 0) AS n_quotes, coalesce(p.n_linked, 0) AS n_linked, own.own_text
  FROM raw JOIN own USING (m)
  LEFT JOIN replying p ON raw.conv_id IS NOT DISTINCT FROM p.conv_id AND raw.turn IS NOT DISTINCT FROM p.turn
  LEFT JOIN roots r ON raw.conv_id = r.conv_id AND raw.turn = r.turn)
SELECT conv_id, turn, role, reply_to, root, depth,
       row_number() OVER (PARTITION BY conv_id ORDER BY root NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, md5(own_text)) - 1 AS position, n_quotes, n_linked, own_text
FROM joined
"""
