"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

The mix is measured in words. Sources get weights by their order, and share a multiple of all words by weight; no
source gets more than ``most`` times its own words, and what it can't take is shared among the others.

Inside a source documents have unequal propensities: the number of binary digits of a document's words, so that one of
a thousand words has ten times the propensity of a single word. A document's expected copies are its propensity times
the source's level, ``most`` at the highest; the level is the one at which the expected words are the target. As the
propensity depends on the digits alone, it is solved from one word sum per source and number of digits (a band).

A document is allocated the whole part of its expected copies for certain; the rest is its inclusion probability p. For
the remaining words, documents are ranked by their random odds over their inclusion odds, (u / (1 - u)) / (p / (1 - p)),
u being a hash of id and text, and taken in this order: each that fits into the words that are left is taken once
more, each that doesn't is passed over. So the words taken miss the target by less than the smallest document passed
over, even where a very long one stands at the cut. Documents before the first one passed over, which are nearly all,
are a Pareto sample of fixed size in words.

The order is walked in rounds: a round takes the documents up to the first one that doesn't fit, found from word sums in
256 equal steps of the rank per source (summed before the shuffle), then in 256 steps inside the step with the cut, then
among that step's rows, so no task ever holds a source. The next round goes on behind it, with the documents that are no longer than what is left. A round is
kept as an interval of ranks and a longest size, and a row's copies follow from its own rank, its band and its
source's rounds alone, which makes reruns agree and lets the plan be applied where the texts are.

Defined results: a null text has no words and nothing is taken of it; null sources are one source, the last; null ids
are hashed as empty; repeated rows (same id and text) are taken or left together, and not in rounding if all of them are
too long; sources without words have target
0; empty tables give empty results. Other columns aren't read, so they can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.arrow import quoted
from docloom.session import materialise

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Random numbers and ranks have 52 bits; the upper 8 name a rank's step, the upper 16 a step inside it.
DRAW_BITS, STEP_SHIFTS = 52, (44, 36)
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digits_of(size: Column) -> Column:
    """A document's propensity: the binary digits of its words."""
    return F.length(F.bin(size))


def draw_of(row_id: Column, text: Column) -> Column:
    """A number of 52 bits that depends on id and text alone."""
    named = F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(named), 1, DRAW_BITS // 4), 16, 10).cast("long")


def rank_of(draw: Column, inclusion: Column) -> Column:
    """The order of Pareto sampling: random odds over inclusion odds, x, as the 52 bits of x / (1 + x)."""
    u = (draw + F.lit(0.5)) / F.lit(float(2**DRAW_BITS))
    x = (u / (1 - u)) / F.nullif(inclusion / (1 - inclusion), F.lit(0.0))
    return F.floor(x / (1 + x) * float(2**DRAW_BITS)).cast("long")


def _keyed(source: Column) -> list[Column]:
    """A source as two columns without nulls."""
    return [source.isNull().alias("no_source"), F.coalesce(source.cast("string"), F.lit("")).alias("source_key")]


KEY = ["no_source", "source_key"]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """KEY, source_size -> with weight and target. One row per source; the order over all sources needs one task."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(*KEY)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))
    out = sizes.withColumn("weight", weight).withColumn("cap", float(most) * F.col("source_size"))
    out = out.withColumn("fills_at", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("fills_at", *KEY)
    # If the sources before this one are full, the level to which the others fill: right for the first that isn't full.
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before(filling)), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before(filling)), F.lit(0.0))
    out = out.withColumn("level", left / open_weight).withColumn("at", F.row_number().over(filling))
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("at", "level"))).over(everything).getField("level")
    return out.withColumn("target", F.least("cap", F.coalesce(level, F.col("fills_at")) * F.col("weight"))).select(*KEY, "source_size", "weight", "target")


def allocation(bands: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """From (KEY, digits, words) and targets: per band ``whole``, the certain copies, and ``inclusion``, the probability of one more.

    Long documents reach ``most`` copies first. If the bands above this one are full, ``level`` is what the others get
    for each digit: right for the first band that isn't full.
    """
    down = Window.partitionBy(*KEY).orderBy(F.desc("digits"))
    above, upwards = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    out = bands.join(sources.select(*KEY, "target"), KEY)
    open_words = F.sum(F.col("words") * F.col("digits")).over(upwards)
    level = (F.col("target") - float(most) * F.coalesce(F.sum("words").over(above), F.lit(0))) / F.nullif(open_words, F.lit(0))
    out = out.withColumn("level", level)
    right = F.max(F.when(F.col("level") * F.col("digits") <= float(most), F.struct("digits", "level"))).over(Window.partitionBy(*KEY)).getField("level")
    expected = F.least(F.lit(float(most)), F.coalesce(right * F.col("digits"), F.lit(float(most))))
    out = out.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long"))
    return out.select(*KEY, "digits", "words", "whole", (F.col("expected") - F.col("whole")).alias("inclusion"))


def _first_misfit(rows: DataFrame, open_sources: DataFrame) -> DataFrame:
    """Of open sources (KEY, low, limit) the next round: also ``high``, the last rank taken, ``stop``, the rank that doesn't fit or null, and ``left``.

    ``rows`` has KEY, rank and size; those above ``low`` and no longer than ``limit`` are walked.
    """
    walked = rows.join(open_sources, KEY).where((F.col("rank") > F.col("low")) & (F.col("size") <= F.col("limit")))
    reach = None  # each source's step with the cut, the words before it, and the last rank before it
    for level, shift in enumerate(STEP_SHIFTS):
        step = F.shiftright("rank", shift)
        if level == 0:
            inside = walked.withColumns({"before": F.lit(0).cast("long"), "last": F.col("low")})
        else:
            inside = walked.withColumn("cut", F.shiftright("rank", STEP_SHIFTS[level - 1])).join(reach.where(F.col("cut").isNotNull()), [*KEY, "cut"])
        sums = inside.groupBy(*KEY, step.alias("step")).agg(F.sum("size").alias("words"), F.max("rank").alias("end"), *[F.first(c).alias(c) for c in ("limit", "before", "last")])
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy(*KEY).orderBy("step")))
        fits = F.col("upto") <= F.col("limit")
        cut = F.min(F.when(~fits, F.struct("step", (F.col("upto") - F.col("words")).alias("before")))).alias("c")
        whole = F.max(F.when(fits, F.struct("step", "end", "upto"))).alias("w")
        found = sums.groupBy(*KEY).agg(cut, whole, F.first("before").alias("had"), F.first("last").alias("last"))
        found = found.select(*KEY, F.col("c.step").alias("cut"), F.coalesce("c.before", "w.upto", "had").alias("before"), F.coalesce("w.end", "last").alias("last"))
        done = None if reach is None else reach.where(F.col("cut").isNull())
        reach = materialise(found if done is None else found.union(done), "cut-steps")
    inside = walked.withColumn("cut", F.shiftright("rank", STEP_SHIFTS[-1])).join(reach.where(F.col("cut").isNotNull()).select(*KEY, "cut", "before"), [*KEY, "cut"])
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy(*KEY).orderBy("rank")))
    ends = inside.groupBy(*KEY).agg(F.min(F.when(F.col("upto") > F.col("limit"), F.col("rank"))).alias("stop"), F.max(F.when(F.col("upto") <= F.col("limit"), F.struct("rank", "upto"))).alias("fit"))
    found = open_sources.join(reach, KEY).join(ends, KEY, "left")
    return found.select(*KEY, "low", "limit", F.coalesce("fit.rank", "last").alias("high"), "stop", (F.col("limit") - F.coalesce("fit.upto", "before")).alias("left"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From rows (KEY, size, draw): per source and digits its sizes, target, ``whole`` copies, ``inclusion`` and ``rounds``.

    A row is taken ``whole`` times, and once more if one of the rounds (low, high, limit) has its rank and size.
    """
    bands = materialise(rows.groupBy(*KEY, digits_of(F.col("size")).alias("digits")).agg(F.sum("size").alias("words")), "bands")
    sources = materialise(targets(bands.groupBy(*KEY).agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    allocated = materialise(allocation(bands, sources, most), "allocation")

    certain = allocated.groupBy(*KEY).agg(F.sum(F.col("whole") * F.col("words")).alias("certain"))
    ranked = rows.where("size > 0").withColumn("digits", digits_of(F.col("size"))).join(allocated.where("inclusion > 0").select(*KEY, "digits", "inclusion"), [*KEY, "digits"])
    ranked = materialise(ranked.select(*KEY, "size", rank_of(F.col("draw"), F.col("inclusion")).alias("rank")), "ranks")
    start = sources.join(certain, KEY).select(*KEY, F.lit(-1).cast("long").alias("low"), F.floor(F.col("target") - F.col("certain")).cast("long").alias("limit"))
    waiting = materialise(start.where("limit > 0"), "rounds")
    done, lefts = None, waiting.select(*KEY, F.col("limit").alias("left"))
    while waiting.limit(1).count():
        made = materialise(_first_misfit(ranked, waiting), "rounds")
        taken = made.where("high > low").select(*KEY, F.struct("low", "high", "limit").alias("round"))
        done, lefts = taken if done is None else done.union(taken), lefts.union(made.select(*KEY, "left"))
        waiting = made.where(F.col("stop").isNotNull() & (F.col("left") > 0)).select(*KEY, F.col("stop").alias("low"), F.col("left").alias("limit"))
    out = allocated.drop("words").join(sources, KEY)
    none = F.array().cast("array<struct<low: bigint, high: bigint, limit: bigint>>")
    if done is None:
        return materialise(out.withColumn("rounds", none), "mix-plan")
    rounds = materialise(done.groupBy(*KEY).agg(F.collect_list("round").alias("rounds")), "source-rounds")
    extra = _rounding(ranked, lefts.groupBy(*KEY).agg(F.min("left").alias("left")).where("left > 0"), rounds)
    rounds = rounds.join(extra, KEY, "full_outer").select(*KEY, F.concat(F.coalesce("rounds", none), F.coalesce("extra", none)).alias("rounds"))
    return materialise(out.join(rounds, KEY, "left").withColumn("rounds", F.coalesce("rounds", none)), "mix-plan")


def _in_rounds(rank: Column) -> Column:
    return F.exists("rounds", lambda r: (rank > r.low) & (rank <= r.high) & (F.col("size") <= r.limit))


def _rounding(ranked: DataFrame, lefts: DataFrame, rounds: DataFrame) -> DataFrame:
    """KEY, ``extra``: one more round for the first document that isn't taken and overshoots what is left by less than that."""
    lefts = materialise(lefts, "words-left")
    near = ranked.join(lefts, KEY).where((F.col("size") > F.col("left")) & (F.col("size") < 2 * F.col("left")))
    free = near.join(rounds, KEY, "left").where(~F.coalesce(_in_rounds(F.col("rank")), F.lit(False)))
    first = materialise(free.groupBy(*KEY, "left").agg(F.min("rank").alias("rank")), "first-passed-over")
    whole = ranked.join(first, [*KEY, "rank"]).groupBy(*KEY, "rank", "left").agg(F.sum("size").alias("words"), F.max("size").alias("size"))
    as_round = F.struct((F.col("rank") - 1).alias("low"), F.col("rank").alias("high"), F.col("size").alias("limit"))
    return whole.where(F.col("words") < 2 * F.col("left")).select(*KEY, F.array(as_round).alias("extra"))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [*_keyed(quoted(source_col)), words_of(quoted(text_col)).alias("size"), draw_of(quoted(id_col), quoted(text_col)).alias("draw")]


def copies() -> Column:
    again = _in_rounds(rank_of(F.col("draw"), F.col("inclusion")))
    return F.col("whole") + F.when((F.col("inclusion") > 0) & (F.col("size") > 0), again.cast("long")).otherwise(0)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``id_col``, ``source_col``, size, source_size, target, inclusion, copies and taken of every row."""
    rows = materialise(docs.select(quoted(id_col).alias("id"), quoted(source_col).alias("src"), *_measured(docs, id_col, text_col, source_col)), "mix-rows")
    made = rows.withColumn("digits", digits_of(F.col("size"))).join(plan(rows, weights, share, most), [*KEY, "digits"])
    made = made.withColumn("copies", copies())
    return made.select(F.col("id").alias(id_col), F.col("src").alias(source_col), "size", "source_size", "target", "inclusion", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``."""
    rows = materialise(docs.select(*_measured(docs, id_col, text_col, source_col)), "mix-rows")
    inner = [f"c{i}" for i in range(len(docs.columns))]
    where = dict(zip(docs.columns, inner))
    wide = docs.toDF(*inner)
    wide = wide.select(*inner, *_measured(wide, where[id_col], where[text_col], where[source_col])).withColumn("digits", digits_of(F.col("size")))
    made = wide.join(plan(rows, weights, share, most), [*KEY, "digits"]).withColumn("copies", copies())
    # A document without words has nothing that could be taken.
    kept = made.where((F.col("size") > 0) & (F.col("copies") > 0))
    return kept.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*inner).toDF(*docs.columns)


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken", "inclusion")


OP10_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS draw
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, 2e0 * source_size AS cap FROM sizes),
filled AS (
  SELECT *, cap / weight AS fills_at,
         (1.5e0 * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0e0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0e0)) AS level,
         row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS pos
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (
  SELECT source, source_size, least(cap, (SELECT arg_min(level, pos) FROM filled WHERE level <= fills_at) * weight) AS target FROM filled),
bands AS (SELECT source, length(bin(size)) AS digits, sum(size)::BIGINT AS words FROM docs GROUP BY ALL),
levels AS (
  SELECT b.*, t.target, t.source_size,
         (t.target - 2e0 * coalesce(sum(b.words) OVER (PARTITION BY b.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / nullif((sum(b.words * digits) OVER (PARTITION BY b.source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE, 0) AS level
  FROM bands b JOIN target t ON b.source IS NOT DISTINCT FROM t.source),
expecting AS (
  SELECT *, least(2e0, coalesce((arg_max(level, digits) FILTER (level * digits <= 2e0) OVER (PARTITION BY source)) * digits, 2e0)) AS expected FROM levels),
allocated AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS inclusion FROM expecting),
budget AS (SELECT source, floor(any_value(target) - sum(whole * words)::DOUBLE)::BIGINT AS words_left FROM allocated GROUP BY source),
odds AS (
  SELECT d.doc_id, d.source, d.size, a.source_size, a.target, a.whole, a.inclusion,
         CASE WHEN a.inclusion > 0 AND d.size > 0 THEN (((draw + 0.5e0) / 4503599627370496e0) / (1 - (draw + 0.5e0) / 4503599627370496e0)) / (a.inclusion / (1 - a.inclusion)) END AS x
  FROM docs d JOIN allocated a ON d.source IS NOT DISTINCT FROM a.source AND length(bin(d.size)) = a.digits),
ranked AS (SELECT *, floor(x / (1 + x) * 4503599627370496e0)::BIGINT AS rnk FROM odds),
ties AS (SELECT source, rnk, sum(size)::BIGINT AS words, max(size) AS size FROM ranked WHERE rnk IS NOT NULL GROUP BY source, rnk),
walk AS (
  SELECT source, -1::BIGINT AS rnk, words_left FROM budget
  UNION ALL
  SELECT w.source, n.rnk, w.words_left - n.words
  FROM walk w JOIN LATERAL (SELECT rnk, words FROM ties t WHERE t.source IS NOT DISTINCT FROM w.source AND t.rnk > w.rnk AND t.words <= w.words_left ORDER BY rnk LIMIT 1) n ON true),
lefts AS (SELECT source, min(words_left) AS words_left FROM walk GROUP BY source),
near AS (
  SELECT t.source, t.rnk, t.words, l.words_left FROM ties t JOIN lefts l ON t.source IS NOT DISTINCT FROM l.source
  WHERE t.size > words_left AND t.size < 2 * words_left AND NOT EXISTS (SELECT 1 FROM walk w WHERE w.source IS NOT DISTINCT FROM t.source AND w.rnk = t.rnk)
  QUALIFY row_number() OVER (PARTITION BY t.source ORDER BY t.rnk) = 1),
taken AS (SELECT source, rnk FROM walk UNION ALL SELECT source, rnk FROM near WHERE words < 2 * words_left)
SELECT doc_id, size, source_size, target, inclusion, size * (whole + (w.rnk IS NOT NULL)::BIGINT) AS taken
FROM ranked r LEFT JOIN taken w ON r.source IS NOT DISTINCT FROM w.source AND r.rnk = w.rnk
"""
