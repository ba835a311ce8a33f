"""String similarity: plain Python kernels and the Arrow functions that carry them to the executors."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import shipped

#: The ends of two texts may share at most so many characters, at least so alike, to count as overlapping.
OVERLAP_MOST, OVERLAP_LIKE = 50, 0.9


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word (or big integer) of positions at a time."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & at.get(c, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


#: Comparisons that go through the characters together, and characters between two looks at which are decided.
TOGETHER, LOOK = 1 << 13, 32
#: Fewer windows than this, and texts of more words of bits, are compared one by one.
FEW_WINDOWS, WIDE = 64, 8


class Texts:
    """Texts as numbers of their characters, one after the other, and as bits: of each text and character its places."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        alphabet, codes = np.unique(chars, return_inverse=True)
        self.codes = codes.astype(np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = len(alphabet)
        self.number = {chr(c): i for i, c in enumerate(alphabet.tolist())}

    def histogram(self) -> np.ndarray:
        """How often each text has each character."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return np.bincount(owner * self.letters + self.codes, minlength=len(self.sizes) * self.letters).reshape(len(self.sizes), self.letters)

    def bits(self, which: np.ndarray) -> np.ndarray:
        """Places (text, character, word) of some texts, 64 a word."""
        sizes = self.sizes[which]
        words = max(1, int(-(-sizes.max() // 64))) if len(which) else 1
        out = np.zeros((len(which), self.letters, words), np.uint64)
        row = np.repeat(np.arange(len(which)), sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letter = self.codes[np.repeat(self.starts[which], sizes) + place]
        np.bitwise_or.at(out, (row, letter, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        return out


def common_lengths(bits: np.ndarray, codes: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs, all of which go on by a character at a time.

    A pair is a row of ``bits`` (places of each character of the one text) and a run of ``codes``. Pairs that can't
    reach ``least`` any more are given up, with -1.
    """
    rows, letters, words = bits.shape
    flat = bits.reshape(rows * letters, words)
    out = np.zeros(len(row), np.int64)
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), TOGETHER):
        job = order[at : at + TOGETHER]
        base, first, left = row[job] * letters, start[job], size[job]
        state = np.full((words, len(job)), np.iinfo(np.uint64).max, np.uint64)
        for t in range(int(left[0])):
            k = int(np.searchsorted(-left, -t))  # so many have a character at t
            if not k:
                break
            letter, carry = base[:k] + codes[first[:k] + t], None
            for w in range(words):
                x = state[w, :k]
                hit = x & flat[letter, w]
                y = x + hit
                over = y < x
                if carry is not None:
                    z = y + carry
                    over |= z < y
                    y = z
                state[w, :k] = y | (x ^ hit)
                if w + 1 < words:
                    carry = over.astype(np.uint64)
            if least is not None and t % LOOK == LOOK - 1:
                common = 64 * words - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
                hopeless = common + np.maximum(left - t - 1, 0) < least[job]
                if hopeless.any():
                    out[job[hopeless]] = -1
                    job, base, first, left, state = (x[..., ~hopeless] for x in (job, base, first, left, state))
                    if not len(job):
                        break
        if len(job):
            out[job] = 64 * words - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
    return out


def shares(a: str, b: str, least: int) -> bool:
    """Whether the longest common subsequence has at least so many characters; ends as soon as it can't."""
    at, state = _masks(a), (1 << len(a)) - 1
    full = state
    for start in range(0, len(b), LOOK):
        for c in b[start : start + LOOK]:
            hit = state & at.get(c, 0)
            state = (state + hit | state - hit) & full
        common = len(a) - state.bit_count()
        if common >= least:
            return True
        if common + len(b) - start - LOOK < least:
            return False
    return least <= 0


def alike_pairs(texts: Texts, a: np.ndarray, b: np.ndarray, alike: float) -> np.ndarray:
    """Which pairs (numbers of texts) have at least this Indel ratio. Sizes and letters sort out first."""
    sizes = texts.sizes
    # The same products and quotients as in ``indel_ratio``, so that both decide alike.
    both = sizes[a] + sizes[b]
    need = np.ceil(alike * both / 200.0 - 1e-9).astype(np.int64)
    need += (both > 0) & (200.0 * need / np.maximum(both, 1) < alike)
    out = np.zeros(len(a), bool)
    able = np.flatnonzero(np.minimum(sizes[a], sizes[b]) >= need)
    histogram = texts.histogram()
    for at in range(0, len(able), TOGETHER):
        some = able[at : at + TOGETHER]
        some = some[np.minimum(histogram[a[some]], histogram[b[some]]).sum(axis=1) >= need[some]]
        swap = sizes[a[some]] > sizes[b[some]]  # the shorter one as bits
        short, long = np.where(swap, b[some], a[some]), np.where(swap, a[some], b[some])
        words = -(-sizes[short] // 64)
        for i in np.flatnonzero(words > WIDE).tolist():
            out[some[i]] = shares(texts.texts[short[i]], texts.texts[long[i]], int(need[some[i]]))
        for width in np.unique(words[words <= WIDE]):
            same = words == width
            which, row = np.unique(short[same], return_inverse=True)
            common = common_lengths(texts.bits(which), texts.codes, row, texts.starts[long[same]], sizes[long[same]], need[some[same]])
            out[some[same]] = common >= need[some[same]]
    return out


def _best_run(short: str, long: str, least: int) -> tuple[int, int]:
    """Of the runs of ``long`` as long as ``short`` the first that has most in common with it, and how much; -1 and 0 if
    none reaches ``least``.

    Two runs that begin d characters apart differ by d at most, so of the runs between two known ones none has more than
    half of what both have and their distance: halving goes on only where that may be the most.
    """
    n, count = len(short), len(long) - len(short) + 1
    texts = Texts([short, long])
    bits = texts.bits(np.array([0]))
    known = np.full(count, -1, np.int64)

    def look(starts: np.ndarray) -> None:
        known[starts] = common_lengths(bits, texts.codes, np.zeros(len(starts), np.int64), n + starts, np.full(len(starts), n))

    step = max(1, n // 8)
    places = np.unique(np.append(np.arange(0, count, step), count - 1))
    look(places)
    while True:
        gap = np.diff(places)
        most = (known[places[:-1]] + known[places[1:]] + gap) // 2
        open_ = (gap > 1) & (most >= max(least, int(known.max())))
        if not open_.any():
            break
        fresh = places[:-1][open_] + gap[open_] // 2
        look(fresh)
        places = np.union1d(places, fresh)
    top = int(known.max())
    return (int(np.argmax(known)), top) if top >= least else (-1, 0)


def indel_ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths; two empty strings are alike."""
    both = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / both if both else 100.0


def sequence_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@lru_cache(maxsize=1024)
def _parts(n: int, like: float) -> tuple[tuple[int, int, int, int], ...]:
    """Parts of a text of ``n`` characters, and where each may be in another one of that length, of which one is there
    unchanged if both are so alike.

    Both have at least ``like * n`` characters in common, in order. So at most ``apart`` of either aren't, each of which
    breaks one part, and no character that both have is further off than that.
    """
    apart = n - max(0, math.ceil(like * n))
    parts = 2 * apart + 1
    ends = [i * n // parts for i in range(parts + 1)]
    return tuple((i, z, max(0, i - apart), min(n, z + apart)) for i, z in zip(ends, ends[1:]))


def overlap(a: str, b: str, least: int = 1, most: int = OVERLAP_MOST, like: float = OVERLAP_LIKE) -> int:
    """The most characters, at the end of ``a`` and the start of ``b``, that are alike; 0 if there are none."""
    top = min(len(a), len(b), most)
    tail = a[len(a) - top :]
    # What a start has in common with all of the tail, it has at most with an end of it.
    common = [0, *_prefix_lengths(_masks(tail), top, b[:top])]
    for n in range(top, least - 1, -1):
        if common[n] < like * n:
            continue
        at = len(a) - n
        for i, z, low, high in _parts(n, like):
            if a.find(b[i:z], at + low, at + high) >= 0:
                break
        else:
            continue
        end, start = a[-n:], b[:n]
        # Matching blocks are a common subsequence, so its length bounds the ratio.
        if end == start or lcs_length(end, start) >= like * n and sequence_ratio(end, start) >= like:
            return n
    return 0


def join_overlapping(a: str, b: str, between: str = " ", least: int = 1, most: int = OVERLAP_MOST, like: float = OVERLAP_LIKE, keep: str = "both_dropped") -> str:
    """``a`` and ``b`` joined; the longest alike end of ``a`` and start of ``b`` goes.

    ``both_dropped`` loses it on both sides; ``one_kept`` keeps the one of ``a``.
    """
    n = overlap(a, b, least, most, like)
    return ((a if keep == "one_kept" or not n else a[:-n]) + between + b[n:]).strip()


@lru_cache(maxsize=64)
def normalise_with_places(text: str) -> tuple[str, list[int]]:
    """Lower case with blanks for all but letters and digits, trimmed; and each character's place in ``text``."""
    chars, places = [], []
    for i, c in enumerate(text):
        for low in c.lower():
            chars.append(low if low.isalnum() else " ")
            places.append(i)
    a, z = 0, len(chars)
    while a < z and chars[a] == " ":
        a += 1
    while z > a and chars[z - 1] == " ":
        z -= 1
    return "".join(chars[a:z]), places[a:z]


def _masks(text: str) -> dict[str, int]:
    """For each character of ``text`` its places as bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(text):
        at[c] = at.get(c, 0) | 1 << i
    return at


def _prefix_lengths(at: dict[str, int], n: int, text: str) -> Iterator[int]:
    """For each prefix of ``text``, from one character on, its common subsequence with the masked text of length ``n``."""
    full = (1 << n) - 1
    state = full
    for c in text:
        hit = state & at.get(c, 0)
        state = (state + hit | state - hit) & full
        yield n - state.bit_count()


def best_window(short: str, long: str, cutoff: float = 0.0) -> tuple[float, int, int]:
    """Indel ratio and span of the part of ``long`` that is most like ``short``; 0 and no span if none reaches ``cutoff``.

    Parts are all runs as long as ``short``, and shorter ones at either end of ``long``. Of equal ones the first counts:
    beginnings, then runs, then ends. Two runs that begin d characters apart differ by d at most in what they have in
    common with ``short``, so runs near one that falls far short are passed over.
    """
    if not short or not long:
        return 0.0, 0, 0
    if len(short) > len(long):
        score, _, _ = best_window(long, short, cutoff)
        return (score, 0, len(long)) if score else (0.0, 0, 0)
    exact = long.find(short)
    if exact >= 0:
        return 100.0, exact, exact + len(short)
    n, at = len(short), _masks(short)
    best, span = 0.0, (0, 0)

    def better(score: float) -> bool:
        return score > best and score >= cutoff

    for k, common in enumerate(_prefix_lengths(at, n, long[: n - 1]), 1):
        if better(score := 200.0 * common / (n + k)):
            best, span = score, (0, k)
    # Only so many characters in common are better than the best, and reach the cutoff.
    least = max(int(best * n / 100.0 + 1e-9) + 1, math.ceil(cutoff * n / 100.0 - 1e-9))
    if len(long) - n >= FEW_WINDOWS and n <= 64 * WIDE:
        start, common = _best_run(short, long, least)
        if start >= 0 and better(score := 100.0 * common / n):
            best, span = score, (start, start + n)
    else:
        full, start = (1 << n) - 1, 0
        while start <= len(long) - n:
            state = full
            for c in long[start : start + n]:
                hit = state & at.get(c, 0)
                state = (state + hit | state - hit) & full
            common = n - state.bit_count()
            if better(score := 100.0 * common / n):
                best, span = score, (start, start + n)
                least = max(least, common + 1)
            start += max(1, least - common)
    back = _masks(short[::-1])
    ends = [200.0 * common / (n + k) for k, common in enumerate(_prefix_lengths(back, n, long[: len(long) - n : -1]), 1)]
    for k in range(len(ends), 0, -1):
        if better(ends[k - 1]):
            best, span = ends[k - 1], (len(long) - k, len(long))
    return best, *span


def align(sentence: str, source: str, cutoff: float = 0.0) -> tuple[float, int, int, int, int]:
    """Score and spans (sentence, source), in the strings as they are, of the best aligned parts of both."""
    a, at_a = normalise_with_places(sentence)
    b, at_b = normalise_with_places(source)
    if not a or not b:
        return 0.0, 0, 0, 0, 0
    score, s, e, sentence_is_short = 0.0, 0, 0, True
    if len(a) <= len(b):
        score, s, e = best_window(a, b, cutoff)
    if len(a) > len(b) or len(a) == len(b) and score < 100.0:  # texts of one length are tried both ways
        other = best_window(b, a, cutoff)
        if other[0] > score:
            (score, s, e), sentence_is_short = other, False
    if not score:
        return 0.0, 0, 0, 0, 0
    if sentence_is_short:
        return score, at_a[0], at_a[-1] + 1, at_b[s], at_b[e - 1] + 1
    return score, at_a[s], at_a[e - 1] + 1, at_b[0], at_b[-1] + 1


@shipped
@F.pandas_udf(T.DoubleType())
def indel_similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def partial_similarity(a: Column | str, b: Column | str, cutoff: float = 0.0) -> Column:
    """Of normalised texts, the shorter against its best window in the longer; 0 below ``cutoff``."""
    return alignment(a, b, cutoff).getField("score")


ALIGNMENT = T.StructType([T.StructField("score", T.DoubleType())] + [T.StructField(x, T.IntegerType()) for x in ("sent_start", "sent_end", "node_start", "node_end")])


@shipped
def alignment(a: Column | str, b: Column | str, cutoff: float = 0.0) -> Column:
    """Score and spans of the best aligned parts of two texts; score 0 below ``cutoff``, null for a null text."""

    @F.pandas_udf(ALIGNMENT)
    def aligned(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in pairs:
            yield pd.DataFrame([align(s, t, cutoff) if s is not None and t is not None else (None,) * 5 for s, t in zip(x, y)], columns=ALIGNMENT.names)

    return aligned(a, b)
