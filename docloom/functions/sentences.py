"""Sentences with their places in the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import shipped

#: Words whose dot ends no sentence; ``operators.abbreviations`` learns those of a corpus.
UNFINISHED = frozenset("mr mrs ms dr prof jr sr st no fig eq vs etc al inc ltd co approx dept est p pp vol".split())
_END = re.compile(r"[.!?]+[\"')\]]*(?=\s|$)|\n\s*\n")


def split_sentences(text: str, unfinished: frozenset[str] = UNFINISHED) -> list[tuple[int, int, str]]:
    """(start, end, text) of each sentence, without the white space between them.

    ``unfinished`` holds words in lower case, with the dots inside them, whose last dot ends no sentence.
    """
    out, start = [], 0

    def take(a: int, z: int) -> None:
        while a < z and text[a].isspace():
            a += 1
        while z > a and text[z - 1].isspace():
            z -= 1
        if a < z:
            out.append((a, z, text[a:z]))

    for end in _END.finditer(text):
        if end[0].startswith("."):
            before = text[max(0, end.start() - 30) : end.start()]
            word, whole = re.search(r"(\w+)$", before), re.search(r"((?:\w+\.)*\w+)$", before)
            follows = text[end.end() : end.end() + 3].lstrip()
            if word and (word[1].lower() in unfinished or whole[1].lower() in unfinished or len(word[1]) == 1 and word[1].isupper()) and follows:
                continue
            if follows[:1].islower():
                continue
        take(start, end.end())
        start = end.end()
    take(start, len(text))
    return out


SENTENCES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


@shipped
@F.pandas_udf(SENTENCES)
def sentences(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([None if x is None else [{"start": a, "end": z, "text": t} for a, z, t in split_sentences(x)] for x in batch])
