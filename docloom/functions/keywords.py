"""Keywords by YAKE's published term features (Campos et al. 2020): unsupervised, one document at a time."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.fuzzy import indel_ratio
from docloom.functions.sentences import split_sentences
from docloom.session import shipped

#: English words that carry no topic.
STOPWORDS = frozenset(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)
LONGEST, MOST_ALIKE, TOP = 3, 90.0, 20


def _term_scores(sentence_words: list[list[str]]) -> dict[str, float]:
    """Lower is better: casing, position, frequency, relatedness to context and spread over sentences."""
    count: Counter[str] = Counter()
    capital: Counter[str] = Counter()
    acronym: Counter[str] = Counter()
    where: dict[str, list[int]] = defaultdict(list)
    left: dict[str, list[str]] = defaultdict(list)
    right: dict[str, list[str]] = defaultdict(list)
    for s, words in enumerate(sentence_words):
        low = [w.lower() for w in words]
        count.update(low)
        for term in low:
            where[term].append(s)
        for before, term in zip(low, low[1:]):
            left[term].append(before)
            right[before].append(term)
        acronym.update(t for t, w in zip(low, words) if len(w) > 1 and w.isupper())
        capital.update(t for t, w in zip(low[1:], words[1:]) if w[:1].isupper())
    content = [n for t, n in count.items() if t not in STOPWORDS]
    if not content:
        return {}
    usual = float(np.mean(content)) + float(np.std(content))
    most = max(count.values())
    out = {}
    for term, n in count.items():
        casing = max(capital[term], acronym[term]) / (1 + math.log(n))
        places = where[term]  # in order
        position = math.log(math.log(3 + (places[n // 2] + places[(n - 1) // 2]) / 2) + 1)
        spread = len(set(where[term])) / len(sentence_words)
        related = 1.0
        for side in (left.get(term), right.get(term)):
            if side:
                related += len(set(side)) / len(side) * n / most
        out[term] = related * position / (casing + n / usual / related + spread / related)
    return out


def keywords(text: str, top: int | None = TOP, longest: int = LONGEST) -> list[tuple[str, float]]:
    """(keyword, 1 - score), best first; of keywords that are nearly the same the better one stays."""
    spans = [re.findall(r"\w+(?:[-']\w+)*", s) for _, _, s in split_sentences(text)]
    scores = _term_scores([w for w in spans if w])
    found: Counter[str] = Counter()
    for words in spans:
        low = [w.lower() for w in words]
        ends = [w not in STOPWORDS for w in low]
        starts = [e and len(w) > 2 for e, w in zip(ends, low)]
        number = [w.isdigit() for w in low]
        for i in range(len(low)):
            if starts[i]:
                for z in range(i + 1, min(i + longest, len(low)) + 1):
                    if number[z - 1]:
                        break
                    if ends[z - 1]:
                        found[" ".join(low[i:z])] += 1
    ranked = []
    for gram, n in found.items():
        parts = [scores[w] for w in gram.split() if w not in STOPWORDS]
        ranked.append((math.prod(parts) / (n * (1 + sum(parts))), gram))
    kept: list[tuple[str, float]] = []
    for score, gram in sorted(ranked):
        if all(indel_ratio(gram, other) < MOST_ALIKE for other, _ in kept):
            kept.append((gram, 1 - score))
            if top is not None and len(kept) >= top:
                break
    return kept


def keywords_function(top: int | None = 5):
    """An Arrow function from text to its keywords."""

    @shipped
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([None if x is None else [k for k, _ in keywords(x, top)] for x in batch])

    return found
