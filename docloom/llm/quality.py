"""Quality rules: base rules on word statistics, then an isolation forest on rates made from them.

One pass over whole texts makes the counts. From them come rates (symbols, capitals, marks, lines, repeated lines,
repeated windows and echoed words by their wholes, word length), on logarithmic scales and neither rounded nor clipped.
Rates, not sizes, so that long documents and rare languages aren't anomalies by themselves.

A tree splits the space of possible rates, not only the part that its rows fill: random cuts lie anywhere between a
rate's least and greatest possible value, a part without rows is a leaf at once, and one with rows is cut further down
to ``DEPTH``. Its rows are drawn from rows labelled good. So a document like these follows a long path, and one that
differs in any rate, or in how rates go together, soon falls into an empty part, though no tree has seen its like.

Labelled rows that pass the base rules are split in two by a hash. The forest is grown on the driver from at most
``FIT_ROWS`` rows of the one half (that bound is a parameter; each tree sees ``TREE_ROWS`` of them, as the method
has it); a document's anomaly comes from its mean path length over the trees' random splits. The threshold is
calibrated on all rows of the other half, which the forest hasn't seen: the lowest score step from which on at most
``max_good_loss`` of the good rows would go and at least half of what goes is bad, lowered a quarter of the way to the next step
that stays. Without labelled rows, or if no step is good enough, only the base rules reject.

Defined results: a null, empty or blank text has no words and fails the base rules; labels of null ids or null
quality are ignored; of conflicting labels the worse one counts; null ids are kept in the result; repeated rows get
equal verdicts; empty tables give empty results. Output columns replace carried columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.arrow import arrow_column, arrow_map, quoted
from docloom.session import materialise

FIT_ROWS, TREE_ROWS, TREES = 8192, 256, 100
#: Scores are compared in steps of a ten-thousandth.
STEPS = 10_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_echoes"]
WINDOW = 5
#: The least and greatest value of each of ``rates``: shares from none to all, and from half a character to 64 a word.
LOW, HIGH = np.array([0.0] * 7 + [-1.0]), np.array([math.log2(1001)] * 7 + [6.0])
DEPTH = 12

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"!?_=~^@/\\{}[]+"
CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    base = len(known)
    if base == len(words):
        return 0
    code, size = ids, base
    for j in range(1, window):  # exact: codes are renumbered before they could overflow
        if size * base >= 1 << 62:
            seen, code = np.unique(code, return_inverse=True)
            size = len(seen)
        code = code[:-1] * base + ids[j:]
        size *= base
    _, which, times = np.unique(code, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[which] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """The counts named in COUNTS, of a whole UTF-8 text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    having = lambda chars: len(text) - len(text.translate(None, chars))
    return (
        len(words),
        len(text.translate(None, SPACE + CONTINUATION)),
        having(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        having(CAPITALS),
        having(MARKS),
        sum(map(eq, words, words[1:])),
    )


def rates(counts: np.ndarray) -> np.ndarray:
    """Rates of rows of COUNTS on logarithmic scales, on which few are told from none."""
    words, chars, symbols, dup_lines, repeated, lines, capitals, marks, echoes = counts.T
    per = lambda x, whole: x / np.maximum(whole, 1)
    shares = (per(symbols, chars), per(capitals, chars), per(marks, chars), per(lines, words), per(dup_lines, lines), per(repeated, words), per(echoes, words))
    return np.stack([*(np.log2(1 + 1000 * x) for x in shares), np.log2(np.maximum(per(chars, words), 0.5))], axis=1)


def usual_path(rows: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of so many rows."""
    if rows <= 1:
        return 0.0
    return 1.0 if rows == 2 else 2.0 * (math.log(rows - 1) + 0.5772156649015329) - 2.0 * (rows - 1) / rows


@dataclass
class Forest:
    """Trees as arrays: split rate (-1 at a leaf), split value, left child (the right one follows), path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    depth: int
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): 2 to the power of minus the mean path over the usual path."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left, path in zip(self.feature, self.value, self.left, self.path):
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[at] + (x[rows, f] >= value[at])
                at = np.where(inner, step, at)
            total += path[at]
        return np.exp2(-total / (len(self.feature) * self.norm))


def grow_forest(x: np.ndarray, low: np.ndarray = LOW, high: np.ndarray = HIGH, trees: int = TREES, tree_rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = 42) -> Forest:
    """Trees over the box between ``low`` and ``high``, each for a sample of the rows ``x``."""
    random = np.random.default_rng(seed)
    tree_rows = min(tree_rows, len(x))
    grown = []
    for _ in range(trees):
        nodes: list[list] = [[-1, 0.0, 0, 0.0]]  # rate, cut, left child, path
        stack = [(0, random.choice(len(x), tree_rows, replace=False), low, high, 0)]
        while stack:
            node, rows, a, z, level = stack.pop()
            if level == depth or not len(rows):
                nodes[node][3] = level + usual_path(len(rows))
                continue
            f = int(random.integers(len(low)))
            cut = random.uniform(a[f], z[f])
            right = x[rows, f] >= cut
            upper, lower = a.copy(), z.copy()
            upper[f] = lower[f] = cut
            nodes[node][:3] = f, cut, len(nodes)
            stack += [(len(nodes), rows[~right], a, lower, level + 1), (len(nodes) + 1, rows[right], upper, z, level + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        grown.append(nodes)
    size = max(map(len, grown))
    column = lambda i, kind: np.array([[n[i] for n in nodes] + [-1 if i == 0 else 0] * (size - len(nodes)) for nodes in grown], kind)
    return Forest(column(0, np.int32), column(1, float), column(2, np.int32), column(3, float), depth, usual_path(tree_rows) or 1.0)


@dataclass
class Model:
    """A forest, if there was something to fit it on, and the first score step that is rejected."""

    forest: Forest | None = None
    limit: int = STEPS + 1

    def steps(self, counts: np.ndarray) -> np.ndarray:
        if self.forest is None or not len(counts):
            return np.zeros(len(counts), np.int32)
        return np.floor(self.forest.scores(rates(counts)) * STEPS).astype(np.int32)


def fitted(counts: np.ndarray, good: np.ndarray) -> Model:
    """A forest over the good rows, or over all if there are none."""
    return Model(grow_forest(rates(counts[good] if good.any() else counts)))


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistics(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (default: all columns) and COUNTS."""

    def kernel(texts: pa.Array) -> list:
        rows = [text_counts(x or b"") for x in texts.cast(pa.binary()).to_pylist()]
        table = np.array(rows, np.int64).reshape(-1, len(COUNTS))
        return [pa.array(np.ascontiguousarray(c)) for c in table.T]

    return arrow_map(docs, docs.columns if carry is None else carry, [quoted(text_col)], [T.StructField(c, T.LongType()) for c in COUNTS], kernel)


def score(counted: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """``carry`` and ``anomaly``, the score's step, from COUNTS."""

    def kernel(*counts: pa.Array) -> list:
        return [pa.array(model.steps(np.stack([c.to_numpy() for c in counts], axis=1)))]

    return arrow_map(counted, carry, [F.col(c) for c in COUNTS], [T.StructField("anomaly", T.IntegerType())], kernel)


def fit(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_id_col: str = "doc_id", quality_col: str = "quality", fit_rows: int = FIT_ROWS, max_good_loss: float = 0.002) -> Model:
    """A model from documents' COUNTS (with ``id_col``) and labels (quality 1: good, 0: bad)."""
    known = labels.select(quoted(label_id_col).alias("id"), quoted(quality_col).alias("quality")).dropna()
    known = known.groupBy("id").agg(F.min("quality").alias("quality"))
    passed = counted.where(~base_failed()).select(quoted(id_col).alias("id"), *COUNTS)
    drawn = F.pmod(F.xxhash64("id", *COUNTS), F.lit(1 << 30))
    labelled = materialise(passed.join(known, "id").withColumn("draw", drawn), "labelled")
    # The lower half of the draws fits; of it about twice as many rows as needed pass the first test, so that tasks send few.
    half = 1 << 29
    fitting, held_out = labelled.where(F.col("draw") < half), labelled.where(F.col("draw") >= half)
    pool = fitting.where(F.col("draw") < int(half * min(1.0, 2 * fit_rows / max(1, fitting.count()))))
    rows = pool.select(*COUNTS, (F.col("quality") > 0).cast("long"), "draw").orderBy("draw", *COUNTS).limit(fit_rows).collect()
    if not rows:
        return Model()
    table = np.array([r[:-1] for r in rows], np.int64)
    model = fitted(table[:, : len(COUNTS)], table[:, len(COUNTS)] > 0)
    scored = score(held_out, model, ["quality"])
    good, bad = F.sum((F.col("quality") > 0).cast("long")), F.sum((F.col("quality") <= 0).cast("long"))
    steps = scored.groupBy("anomaly").agg(good.alias("good"), bad.alias("bad")).collect()  # at most STEPS + 1 rows
    model.limit = calibrated({r["anomaly"]: (r["good"], r["bad"]) for r in steps}, max_good_loss)
    return model


def calibrated(steps: dict[int, tuple[int, int]], max_good_loss: float) -> int:
    """The lowest step from which on few good rows would go, and no more good ones than bad ones; lowered a quarter of the way to the
    next step that stays, as what wasn't labelled lies on both sides of what was."""
    all_good = sum(good for good, _ in steps.values())
    limit, good, bad = STEPS + 1, 0, 0
    for step in sorted(steps, reverse=True):
        good, bad = good + steps[step][0], bad + steps[step][1]
        if good > max_good_loss * all_good:
            break
        if bad >= good and steps[step][1]:
            limit = step
    below = max((step for step in steps if step < limit), default=limit)
    return limit if limit > STEPS else (3 * limit + below + 3) // 4


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_good_loss: float = 0.002) -> DataFrame:
    """``id_col``, COUNTS, ``base_failed``, ``anomaly`` and ``kept`` of every document."""
    counted = materialise(statistics(docs, text_col, [id_col]), "text-counts")
    model = fit(counted, labels, id_col, max_good_loss=max_good_loss)
    return verdicts(score(counted, model, counted.columns), model)


def verdicts(scored: DataFrame, model: Model) -> DataFrame:
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & (F.col("anomaly") < model.limit))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_good_loss: float = 0.002) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``. Texts are read twice and never shuffled, and come back from no Python."""
    model = fit(materialise(statistics(docs, text_col, [id_col]), "text-counts"), labels, id_col, max_good_loss=max_good_loss)

    def kernel(texts: pa.Array) -> pa.Array:
        table = np.array([text_counts(x or b"") for x in texts.cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(COUNTS))
        failed = (table[:, 0] < 10) | (100 * table[:, 4] > 20 * table[:, 0])
        return pa.array(~failed & (model.steps(table) < model.limit))

    return docs.where(arrow_column([quoted(text_col)], T.BooleanType(), kernel))


def op3_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
