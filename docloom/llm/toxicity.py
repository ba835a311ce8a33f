"""Toxicity by a counterfactual-regularised classifier.

A text's features are its words and the beginnings of its words, by the logarithm of how many words have them, so that
inflected and made-up forms of a stem count together. A logistic model is fitted to labels, with one more term in its
loss: in labelled sentences that name a group of people the group's name is swapped for another's (``GROUPS``), and of
texts that name none, a drawn sentence gets a drawn name put in; the square of each change of the
score's logit is penalised. Toxic texts that name one group more often than others would else teach the model that
the name is toxic, and neutral mentions would be flagged.

Labels are known for a set of ids; texts of these are grouped by hash, so that a text counts once however often it was
copied, and the ``fit_rows`` texts with the smallest hashes are the sample that the model is fitted on (a parameter;
fitting happens on the driver). Features are counted over the sample by Spark; the at most ``FEATURES`` with the
strongest association with toxic texts (a likelihood ratio of ``LEAST_RATIO`` or more) are used. All texts are scored
whole, in one pass that moves nothing.

Defined results: null and empty texts get the score of a text without features; of conflicting labels the toxic one
counts; null labels and labels of null ids are ignored; without labelled texts, or without toxic ones, all scores are 0,
and 1 if there are only toxic ones; repeated rows get equal scores; null ids are kept; an empty table gives an empty result.
Only named columns are read; ids, labels, languages and sources aren't inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.arrow import arrow_map, quoted, small_batches
from docloom.session import materialise, ship_package

FIT_ROWS, FEATURES = 16_384, 2048
LEAST_ROWS, LEAST_RATIO = 3, 10.83
#: Beginnings of words of so many characters; longer words than LONGEST have beginnings only.
BEGINNINGS, LONGEST = (3, 4, 5, 6), 40
#: Weights of the squared weights and of the squared changes of logits; swapped sentences of one text.
SMOOTH, COUNTERFACTUAL, SWAPS = 1e-4, 1.0, 16
STEPS, KNOWN_WORDS = 800, 300_000

#: Names that may stand for each other in a sentence.
GROUPS = [
    line.split()
    for line in """
women men
woman man
girls boys
muslims christians jews hindus buddhists sikhs atheists
muslim christian jewish hindu buddhist sikh atheist
gay lesbian bisexual transgender straight
black white asian latino indigenous
africans asians europeans americans arabs
immigrants refugees foreigners natives
blind deaf disabled autistic
elderly young
frauen männer
muslime christen juden hindus buddhisten atheisten
schwule lesben bisexuelle
ausländer einwanderer flüchtlinge einheimische
behinderte blinde gehörlose
femmes hommes
musulmans chrétiens juifs hindous bouddhistes athées
homosexuels lesbiennes bisexuels
immigrés réfugiés étrangers
handicapés aveugles sourds
mujeres hombres
musulmanes cristianos judíos hindúes budistas ateos
homosexuales lesbianas bisexuales
inmigrantes refugiados extranjeros
discapacitados ciegos sordos
""".strip().splitlines()
]

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> list[str]:
    """The word itself, marked, and its beginnings."""
    whole = ["=" + word] if len(word) <= LONGEST else []
    return whole + [word[:k] for k in BEGINNINGS if len(word) >= k]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def feature_counts(words: Iterable[str]) -> Counter:
    """How many words have each feature."""
    out: Counter = Counter()
    for word, n in Counter(words).items():
        for f in word_features(word):
            out[f] += n
    return out


@dataclass
class Swaps:
    """Makes counterfactual sentences from a text; ``groups`` are lists of names that may stand for each other."""

    groups: list[list[str]] = field(default_factory=lambda: GROUPS)
    limit: int = SWAPS

    def __post_init__(self) -> None:
        self.others: dict[str, list[str]] = {}
        for group in self.groups:
            for name in group:
                self.others.setdefault(name, []).extend(x for x in group if x != name)
        self.names = sorted(self.others)

    def pairs(self, text: str | None) -> Iterator[tuple[list[str], list[str]]]:
        """Words of a sentence and of the same sentence with another name, at most ``limit`` such pairs."""
        sentences = [w for w in map(words_of, _SENTENCE.split(text or "")) if w]
        made = 0
        for words in sentences:
            for name in dict.fromkeys(w for w in words if w in self.others):
                for other in self.others[name]:
                    if made >= self.limit:
                        return
                    made += 1
                    yield words, [other if w == name else w for w in words]
        if not made and sentences and self.names:
            drawn = crc32((text or "").encode())
            words = sentences[drawn % len(sentences)]
            place = drawn // 7 % len(words)
            yield words, [*words[:place], self.names[drawn // 13 % len(self.names)], *words[place:]]


@dataclass
class Model:
    """Features with their weights, and the logit of a text without any."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -math.inf

    def __post_init__(self) -> None:
        self.names = sorted(self.weights)
        self.number = {f: i for i, f in enumerate(self.names)}
        self.values = [self.weights[f] for f in self.names]
        self.known: dict[str, tuple[int, ...]] = {}

    def vector(self, words: Iterable[str]) -> dict[int, float]:
        """Numbers and values of the features that words have."""
        counts: dict[int, int] = {}
        known = self.known
        for word in words:
            own = known.get(word)
            if own is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                own = known[word] = tuple(self.number[f] for f in word_features(word) if f in self.number)
            for i in own:
                counts[i] = counts.get(i, 0) + 1
        return {i: math.log2(1 + n) for i, n in sorted(counts.items())}

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.values[i] * x for i, x in self.vector(words_of(text)).items())
        return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


@dataclass
class Sparse:
    """A matrix by rows: row, column and value of what isn't zero."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, rows: list[dict[int, float]], columns: int) -> Sparse:
        counts = np.array([len(r) for r in rows], np.int64)
        col = np.array([i for r in rows for i in r], np.int64)
        val = np.array([x for r in rows for x in r.values()], float)
        return cls(np.repeat(np.arange(len(rows)), counts), col, val, (len(rows), columns))

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * x[self.col], self.shape[0])

    def back(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * y[self.row], self.shape[1])

    def norm(self) -> float:
        """The largest singular value, squared, by power iteration."""
        x = np.ones(self.shape[1])
        for _ in range(50):
            x = self.back(self.times(x / max(np.linalg.norm(x), 1e-300)))
        return float(np.linalg.norm(x))


def fitted(rows: Sparse, toxic: np.ndarray, changes: Sparse, smooth: float = SMOOTH, counterfactual: float = COUNTERFACTUAL, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of the least penalised logistic loss, by accelerated gradient steps."""
    n, columns = rows.shape
    least = np.concatenate([rows.val, np.ones(n)])
    whole = Sparse(np.concatenate([rows.row, np.arange(n)]), np.concatenate([rows.col, np.full(n, columns)]), least, (n, columns + 1))
    pairs = max(1, changes.shape[0])
    ridge = np.append(np.full(columns, smooth), 0.0)
    bound = 1.05 * (whole.norm() / n / 4 + smooth + counterfactual * changes.norm() / pairs)
    w = ahead = np.zeros(columns + 1)
    pace = 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(whole.times(ahead), -700, 700))) - toxic
        slope = whole.back(error) / n + ridge * ahead
        slope[:columns] += counterfactual / pairs * changes.back(changes.times(ahead[:columns]))
        step = ahead - slope / bound
        following = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = step + (pace - 1) / following * (step - w)
        w, pace = step, following
    return w[:columns], float(w[columns])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """(toxic, text) of labelled texts that are all different; written."""
    keyed = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    known = labels.select(quoted(id_col).alias("id"), (quoted(label_col) > 0).cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    by_text = keyed.select("id", "h").join(known, "id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("id").alias("id"))
    drawn = materialise(by_text.orderBy("h").limit(fit_rows), "drawn-texts")  # fit_rows at most
    return materialise(keyed.join(F.broadcast(drawn), ["id", "h"]).dropDuplicates(["h"]).select("toxic", "text"), "sample-texts")


def features(texts: DataFrame, toxic: int, clean: int) -> list[str]:
    """The features of sampled texts that go with toxic ones, strongest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update(feature_counts(words_of(text)).keys())
            names = list({**seen[0], **seen[1]})
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][f] for f in names], pa.int64()) for k in (1, 0))], names=["f", "a", "b"])

    counted = texts.mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = F.col("a") + F.col("b")
    usual = rows * F.lit(toxic / (toxic + clean))
    part = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    ratio = 2 * (part(F.col("a"), usual) + part(F.col("b"), rows - usual))
    strong = counted.where((rows >= LEAST_ROWS) & (F.col("a") > usual)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    return [r["f"] for r in strong.orderBy(F.desc("ratio"), "f").limit(FEATURES).select("f").collect()]


_ITEM = T.StructType([T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.DoubleType()))])
_ITEM_ARROW = pa.struct([("i", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))])


def _item(vector: dict[int, float]) -> dict:
    return {"i": list(vector), "x": list(vector.values())}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", swaps: Swaps | None = None, counterfactual: float = COUNTERFACTUAL, fit_rows: int = FIT_ROWS) -> Model:
    """A model from labelled rows: labels hold an id and 1 for toxic, 0 for clean."""
    ship_package(docs.sparkSession)
    swaps = swaps or Swaps()
    texts = sample(docs, labels, id_col, text_col, label_col, fit_rows)
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Model(bias=math.inf if n.get(1) else -math.inf)
    names = features(texts, n[1], n[0])
    shape = Model(dict.fromkeys(names, 0.0), 0.0)

    def kernel(column: pa.Array) -> list:
        rows, changes = [], []
        for text in column.to_pylist():
            rows.append(_item(shape.vector(words_of(text))))
            own = []
            for before, after in swaps.pairs(text):
                x, y = shape.vector(before), shape.vector(after)
                change = {i: d for i in {*x, *y} if (d := y.get(i, 0.0) - x.get(i, 0.0))}
                if change:
                    own.append(_item(dict(sorted(change.items()))))
            changes.append(own)
        return [pa.array(rows, _ITEM_ARROW), pa.array(changes, pa.list_(_ITEM_ARROW))]

    made = arrow_map(texts, ["toxic"], [F.col("text")], [T.StructField("row", _ITEM), T.StructField("changes", T.ArrayType(_ITEM))], kernel)
    table = sorted(made.collect(), key=repr)  # fit_rows at most, in one order whatever the partitions were
    vector = lambda item: dict(zip(item["i"], item["x"]))
    rows = Sparse.of([vector(r["row"]) for r in table], len(names))
    changes = Sparse.of([vector(c) for r in table for c in r["changes"]], len(names))
    weights, bias = fitted(rows, np.array([r["toxic"] for r in table], float), changes, counterfactual=counterfactual)
    return Model(dict(zip(shape.names, weights.tolist())), bias)


def scored(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` and ``score``."""
    return arrow_map(docs, carry, [quoted(text_col)], [T.StructField("score", T.DoubleType())], lambda column: [pa.array([model.score(x) for x in column.to_pylist()], pa.float64())])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether 5 divides the checksum of the id as text; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(quoted(id_col).cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by labels of documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    out = scored(docs, fit(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
