"""Combining nodes: kinds, sets and texts of the members of a group, folded in reading order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom import schemas as S
from docloom.functions.fuzzy import OVERLAP_MOST, join_overlapping, overlap
from docloom.operators.structure import runs, sections
from docloom.session import materialise, ship_package

#: A fixed value: last characters after which a text goes on in the same line.
GOES_ON = re.compile(r"[a-z\d\[\](){}<>%^&\"':;,/\-_+= \t\n\r]\Z")


def combined_kind(a: str | None, b: str | None) -> str | None:
    """Of two kinds: the same, else a text composite of texts, an image of image and caption, else a composite."""
    if a == b:
        return a
    for kinds, both in ((S.TEXT_KINDS, S.TEXT_COMPOSITE), (S.IMAGE_KINDS, S.IMAGE)):
        if a in kinds and b in kinds:
            return both
    return S.COMPOSITE


def combine_texts(a: str, b: str, keep: str) -> str:
    if a == b or not b:
        return a
    if not a:
        return b
    return join_overlapping(a, b, " " if GOES_ON.search(a) else "\n", keep=keep)


class Growing:
    """A text to which others are joined as ``combine_texts`` does, at the cost of what is added, not of what is there."""

    def __init__(self, text: str, keep: str) -> None:
        self.parts, self.size, self.keep, self.joined = [text] if text else [], len(text), keep, False

    def whole(self) -> str:
        self.parts = ["".join(self.parts)]
        return self.parts[0]

    def end(self, n: int) -> str:
        """The last ``n`` characters, or all."""
        out, missing = [], n
        for part in reversed(self.parts):
            out.append(part[-missing:])
            missing -= len(out[-1])
            if not missing:
                break
        return "".join(reversed(out))

    def cut(self, n: int) -> None:
        """Without the last ``n`` characters."""
        while n:
            part = self.parts.pop()
            if len(part) > n:
                self.parts.append(part[:-n])
                self.size -= n
                return
            n -= len(part)
            self.size -= len(part)
            self.joined = bool(self.parts)

    def strip(self) -> None:
        while self.parts:
            last = self.parts.pop()
            kept = last.rstrip()
            self.size -= len(last) - len(kept)
            if kept:
                self.parts.append(kept)
                break
        while self.parts and not self.joined:  # afterwards nothing is put in front
            kept = self.parts[0].lstrip()
            self.size -= len(self.parts[0]) - len(kept)
            self.parts[0] = kept
            if kept:
                break
            self.parts.pop(0)
        self.joined = bool(self.parts)

    def add(self, text: str) -> None:
        if not text or self.size == len(text) and self.whole() == text:
            return
        if not self.size:
            self.parts, self.size, self.joined = [text], len(text), False
            return
        # Only ends of so many characters can overlap.
        end = self.end(OVERLAP_MOST)
        between = " " if GOES_ON.search(end) else "\n"
        n = overlap(end, text)
        if n and self.keep != "one_kept":
            self.cut(n)
        added = between + text[n:]
        self.parts.append(added)
        self.size += len(added)
        self.strip()


class _Group:
    """What the members of a group that were seen so far make."""

    def __init__(self, key: tuple, seq: int, row: tuple, sets: int, keep: str) -> None:
        self.key, self.seq, self.ids, self.kind = key, seq, row[:2], row[2]
        self.text, self.others = Growing(row[3] or "", keep), []
        self.sets = [set(x or ()) for x in row[4 : 4 + sets]]
        self.scalars = list(row[4 + sets :])

    def add(self, row: tuple, last: bool) -> None:
        self.others.append(self.ids[0] if last else row[0])
        if last:
            self.ids = row[:2]
        self.kind = combined_kind(self.kind, row[2])
        self.text.add(row[3] or "")
        for own, more in zip(self.sets, row[4:]):
            own.update(more or ())
        for i, value in enumerate(row[4 + len(self.sets) :]):
            if self.scalars[i] is None:
                self.scalars[i] = value

    def row(self) -> tuple:
        ordered = [sorted(x - {None}) + [None] * (None in x) for x in self.sets]
        return (*self.key, self.seq, *self.ids, self.kind, self.text.whole() if self.text.parts else "", *ordered, *self.scalars, self.others)


def merged(members: DataFrame, group: str, survivor: str, keep: str, dealt: bool = False) -> DataFrame:
    """One node per (doc_id, ``group``), with ``others``, the ids of its other members; ``survivor`` says whether the first
    or the last member gives the id.

    Members come sorted to the task that folds them, which holds what they have made so far and a batch of rows; so a
    group may have any number of members, and costs in proportion to their texts. ``dealt``: whole documents are in one
    partition already, as a window by document leaves them, so texts needn't be shuffled once more.
    """
    ship_package(members.sparkSession)
    sets = [c for c in S.SET_COLUMNS if c in members.columns]
    scalars = [c for c in members.columns if c not in {"doc_id", group, "seq", "node_id", "type", "text", "parent_id", "prev_id", "next_id", *sets}]
    columns = ["doc_id", group, "seq", "node_id", "parent_id", "type", "text", *sets, *scalars]
    rows = members.select(*columns)
    rows = (rows if dealt else rows.repartition("doc_id", group)).sortWithinPartitions("doc_id", group, "seq", "node_id")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + [T.StructField("others", T.ArrayType(members.schema["node_id"].dataType))])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(groups: list[_Group]) -> pa.RecordBatch:
            columns = zip(*(g.row() for g in groups)) if groups else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, columns), kinds)], names=schema.names)

        now: _Group | None = None
        for batch in batches:
            done = []
            for doc_id, name, seq, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and now.key == (doc_id, name):
                    now.add(tuple(row), survivor == "last")
                    continue
                if now is not None:
                    done.append(now)
                now = _Group((doc_id, name), seq, tuple(row), len(sets), keep)
            yield batch_of(done)
        if now is not None:
            yield batch_of([now])

    return rows.mapInArrow(fold, schema)


def merge_runs(nodes: DataFrame, kind_name: str, survivor: str, keep: str = "one_kept") -> DataFrame:
    """Every maximal run of ``kind_name`` as one node; children of any member become children of the survivor."""
    out = materialise(merged(runs(nodes, kind_name), "run", survivor, keep, dealt=True).drop("run"), "merged-runs")
    moved = out.select("doc_id", F.col("node_id").alias("new_parent"), F.explode("others").alias("parent_id"))
    # Only rows whose parent changes meet the texts.
    changed = materialise(out.select("doc_id", "node_id", "parent_id").join(moved, ["doc_id", "parent_id"]).select("doc_id", "node_id", "new_parent"), "moved-children")
    joined = out.drop("others").join(changed, ["doc_id", "node_id"], "left")
    return joined.withColumn("parent_id", F.coalesce("new_parent", "parent_id")).drop("new_parent")


def merge_titles(nodes: DataFrame, keep: str = "one_kept") -> DataFrame:
    return merge_runs(nodes, S.TITLE, "last", keep)


def merge_list_items(nodes: DataFrame, keep: str = "one_kept") -> DataFrame:
    return merge_runs(nodes, S.LIST_ITEM, "first", keep)


def section_nodes(nodes: DataFrame, least: int = 1024, keep: str = "one_kept") -> DataFrame:
    """Sections: every emitted node with what goes into it. Dead letters are left out; see ``dead_letters``."""
    places = sections(nodes, least).where(F.col("target").isNotNull()).select("doc_id", "node_id", "target", "anchor", "emitted")
    placed = nodes.join(materialise(places, "section-places"), ["doc_id", "node_id"])
    is_title = F.col("type") == S.TITLE
    new_kind = F.when(F.col("anchor") & is_title, S.COMPOSITE).when(F.col("anchor"), S.TEXT_COMPOSITE).otherwise(F.col("type"))
    newline = is_title | F.col("type").isin(S.HEADER, S.FOOTER, S.TABLE)
    text = F.when(F.col("emitted") & newline, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    rows = placed.withColumn("text", text).withColumn("type", new_kind).drop("anchor", "emitted")
    return merged(rows, "target", "first", keep).drop("target", "others")


def dead_letters(nodes: DataFrame, least: int = 1024) -> DataFrame:
    return sections(nodes, least).where(F.col("target").isNull())
