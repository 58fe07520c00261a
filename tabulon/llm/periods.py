"""Operator 12: periodic runs of words by longest common extensions on suffix trees.

A stretch of words has a suffix tree, and so has its reversal, both built left to right in linear time (Ukkonen). A tour
through the leaves in letter order leaves, between two leaves, the lowest node passed: the least of these depths in a
range is the depth of the lowest common ancestor, which a sparse table gives in constant time. It is the common extension
of two positions to the right in the one tree and to the left in the other. Each run has a Lyndon word as its period
that is the longest one beginning at its place in one of the two letter orders, so the ends of those words are the only
candidates; each is extended in both directions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabulon.llm.common import fresh, slices
from tabulon.llm.words import CHAIN, STEP, hashed, mixed, spans

LEAST_WORDS = 24
LEAST_EXPONENT = 3

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
OUTPUTS = {
    "n_runs": T.LongType(), "runs": T.ArrayType(RUN, False), "start": T.LongType(), "length": T.LongType(),
    "period": T.LongType(), "exponent_milli": T.LongType(), "collapsed": T.StringType(), "runs_sha256": T.StringType(),
    "collapsed_sha256": T.StringType(),
}
ARROW_RUN = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])
ARROW = {
    **dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), pa.int64()),
    "runs": pa.list_(pa.field("element", ARROW_RUN, False)), **dict.fromkeys(("collapsed", "runs_sha256", "collapsed_sha256"), pa.string()),
}


class SuffixTree:
    """Suffix tree of symbols 0 .. ``symbols`` - 1 behind which an end mark is put, with extension queries."""

    def __init__(self, text: list[int], symbols: int):
        # the end mark is 0 and so the smallest, others move up by one
        self.text = [c + 1 for c in text] + [0]
        self.base = symbols + 1
        self._build()
        self._tour()

    def _build(self) -> None:
        text, base, n = self.text, self.base, len(self.text)
        begin, stop, link, child = [0], [0], [0], {}
        node = edge = depth = waiting = 0
        for i, c in enumerate(text):
            waiting += 1
            fresh_node = 0
            while waiting:
                if not depth:
                    edge = i
                key = node * base + text[edge]
                down = child.get(key)
                if down is None:
                    child[key] = len(begin)
                    begin.append(i)
                    stop.append(n)
                    link.append(0)
                    if fresh_node:
                        link[fresh_node] = node
                        fresh_node = 0
                else:
                    size = stop[down] - begin[down]
                    if depth >= size:
                        node, edge, depth = down, edge + size, depth - size
                        continue
                    at = begin[down] + depth
                    if text[at] == c:
                        depth += 1
                        if fresh_node:
                            link[fresh_node] = node
                        break
                    middle = len(begin)
                    begin += (begin[down], i)
                    stop += (at, n)
                    link += (0, 0)
                    child[key] = middle
                    child[middle * base + c] = middle + 1
                    child[middle * base + text[at]] = down
                    begin[down] = at
                    if fresh_node:
                        link[fresh_node] = middle
                    fresh_node = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif depth:
                    depth -= 1
                    edge = i - waiting + 1
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.below = np.fromiter(child.values(), np.int64, len(child))[order]  # children of each node, by symbol
        self.first = np.searchsorted(keys[order], np.arange(len(begin) + 1) * base)
        self.size = np.array(stop) - np.array(begin)

    def _tour(self) -> None:
        """Leaves in letter order, and the depth of the lowest node passed between a leaf and the one before."""
        n = len(self.text)
        below, first, size = self.below.tolist(), self.first.tolist(), self.size.tolist()
        leaves, valleys, stack, low = [], [], [(0, 0)], -1
        while stack:
            node, above = stack.pop()
            if low < 0:
                low = above
            a, b = first[node], first[node + 1]
            depth = above + size[node]
            if a == b:
                leaves.append(n - depth)
                valleys.append(low)
                low = -1
            else:
                stack += [(v, depth) for v in below[b - 1 : a - 1 if a else None : -1]]
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        self.table = [np.array(valleys, np.int32)]
        width = 1
        while 2 * width <= n:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        del self.below, self.first, self.size

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from positions ``a`` and ``b`` (never the same) onwards."""
        x, y = self.rank[a], self.rank[b]
        left, right = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((right - left).astype(float))[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level).tolist():
            rows = np.flatnonzero(level == k)
            out[rows] = np.minimum(self.table[k][left[rows]], self.table[k][right[rows] - (1 << k)])
        return out


def lyndon_ends(rank: list[int]) -> tuple[list[int], list[int]]:
    """Per position the end of the longest Lyndon word that begins there, in the letter order and in the reversed one.

    It ends before the next smaller suffix, in the reversed order before the next greater one (none: past the end mark).
    """
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    falling: list[int] = []
    rising: list[int] = []
    for i, r in enumerate(rank):
        while rising and rank[rising[-1]] > r:
            smaller[rising.pop()] = i
        while falling and rank[falling[-1]] < r:
            greater[falling.pop()] = i
        rising.append(i)
        falling.append(i)
    return smaller, greater


def runs(symbols: list[int], least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with length >= max(least_words, least_exponent * period), by start and period.

    ``symbols`` are whole numbers from 0, ``least_exponent`` is 2 at least.
    """
    n = len(symbols)
    if n < least_words or least_exponent < 2:
        if least_exponent < 2:
            raise ValueError("a run holds its period twice at least")
        return []
    many = max(symbols) + 1
    tree = SuffixTree(symbols, many)
    ends = np.array(lyndon_ends(tree.rank.tolist()))[:, :n]
    at = np.tile(np.arange(n), 2)
    period = ends.ravel() - at
    fit = (at + period < n) & (period * least_exponent <= n)
    at, period = at[fit], period[fit]
    if not len(at):
        return []
    right = tree.common(at, at + period)
    del tree
    back = SuffixTree(symbols[::-1], many)
    left = np.zeros(len(at), np.int64)
    inner = at > 0
    left[inner] = back.common(n - at[inner], n - at[inner] - period[inner])
    start, length = at - left, left + period + right
    keep = (length >= least_words) & (length >= least_exponent * period)
    return sorted(set(zip(start[keep].tolist(), length[keep].tolist(), period[keep].tolist(), strict=True)), key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, before: np.ndarray, least_words: int, least_exponent: int) -> list[tuple[int, int]]:
    """Word ranges, each within a text, outside of which no run can lie.

    With k = ``least_words`` / ``least_exponent`` (1 for exponents below 3), any k words in a row inside a run stand in
    it again one period away, and the period is at most its length / ``least_exponent``. Places without such a repeat
    near by end a stretch; shorter stretches need nearer repeats, so the rule is applied until nothing changes.
    """
    k = max(1, least_words // least_exponent) if least_exponent >= 3 else 1
    if len(hashes) < max(least_words, k):
        return []
    n = len(hashes) - k + 1
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * STEP + hashes[j : j + n]
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    inside = np.flatnonzero(text[:n] == text[k - 1 :])
    keys = mixed(grams[inside]) ^ mixed((text[inside].astype(np.uint64) + np.uint64(1)) * CHAIN)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    pairs = np.flatnonzero(same)
    far = np.int64(1) << 60
    near = np.full(n, far)
    a, b = inside[order[pairs]], inside[order[pairs + 1]]
    near[a] = b - a
    near[b] = np.minimum(near[b], b - a)
    places = np.flatnonzero(near < far)
    while len(places):
        cut = np.flatnonzero((np.diff(places) > 1) | (np.diff(text[places]) > 0)) + 1
        firsts = np.concatenate(([0], cut))
        counts = np.diff(np.concatenate((firsts, [len(places)])))
        words = counts + k - 1
        good = (near[places] * least_exponent <= np.repeat(words, counts)) & np.repeat(words >= least_words, counts)
        if good.all():
            return [(int(places[f]), int(places[f] + w)) for f, w in zip(firsts, words, strict=True)]
        places = places[good]
    return []


def numbered(words: list[bytes]) -> list[int]:
    """A number for each distinct word, by its bytes."""
    seen: dict[bytes, int] = {}
    return [seen.setdefault(w, len(seen)) for w in words]


#: Given the key and the number of words of a text: for each word the number of the word that takes its place, or None.
Rewrite = Callable[[object, int], np.ndarray | None]


def found(column: pa.Array, keys: list | None, rewrite: Rewrite | None, least_words: int, least_exponent: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text of a column."""
    data, first, last, before = spans(column)
    hashes = hashed(data, first, last)
    if rewrite is not None:
        for i, (a, b) in enumerate(pairwise(before.tolist())):
            places = rewrite(keys[i], b - a)
            if places is not None:
                first[a:b], last[a:b], hashes[a:b] = first[a:b][places], last[a:b][places], hashes[a:b][places]
    held: dict[int, list[tuple[int, int]]] = {}
    ranges = stretches(hashes, before, least_words, least_exponent)
    owners = np.searchsorted(before, [a for a, _ in ranges], side="right") - 1
    for (a, b), owner in zip(ranges, owners.tolist(), strict=True):
        held.setdefault(owner, []).append((a, b))
    raw = data.tobytes()
    for i, (a, b) in enumerate(pairwise(before.tolist())):
        words = [raw[x:y] for x, y in zip(first[a:b].tolist(), last[a:b].tolist(), strict=True)]
        out = []
        for x, y in held.get(i, ()):
            out += [(s + x - a, n, p) for s, n, p in runs(numbered(words[x - a : y - a]), least_words, least_exponent)]
        yield words, sorted(set(out), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], periodic: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains behind its first period."""
    if not periodic:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in periodic:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def periodic_runs(
    df: DataFrame, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_runs", "runs", "collapsed"),
    rewrite: Rewrite | None = None, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """``key`` and ``outputs`` of every whole text; a word is a run of bytes other than 0x20 and 0x09-0x0D.

    A run is a stretch of words of smallest period q (words q apart are identical, to the byte), at least
    max(``least_words``, ``least_exponent`` * q) long, that no neighbouring word extends. Outputs: ``runs`` (start, length,
    period in words, by start and period), ``n_runs``, ``start``, ``length``, ``period`` and ``exponent_milli`` (the floor
    of 1000 * length / period) of the run of greatest length / period (ties: smallest start, then period; null without
    runs), ``collapsed`` (all words, but those of a run behind its first period, joined by one space), ``runs_sha256`` (of
    ``start,length,period`` and a line feed per run) and ``collapsed_sha256``, both of UTF-8 and in lower-case hex.

    ``rewrite`` may put other words of the same text in the place of words before the search. Null and empty texts have
    no words and no runs. Repeated rows and null keys stay, each with its result; other columns are left out, so their
    names don't matter; an empty table stays empty. No shuffle. Texts are read in slices; a very long text is a slice of
    its own, and trees are built only over the stretches of it that may hold a run (some 500 bytes per word of the
    longest stretch).
    """
    if unknown := set(outputs) - set(OUTPUTS):
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    (slot,) = fresh(df.select(key), "text")
    source = df.select(df[key], df[text].cast("string").alias(slot))
    clash = {o.lower() for o in outputs}
    if key.lower() in clash:
        raise ValueError(f"the key is named like the output {key}")
    schema = T.StructType([source.schema[0]] + [T.StructField(o, OUTPUTS[o]) for o in outputs])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 18):
                column, keys = batch.column(1).slice(a, b - a), batch.column(0).slice(a, b - a)
                made: dict[str, list] = {o: [] for o in outputs}
                for words, periodic in found(column, keys.to_pylist() if rewrite else None, rewrite, least_words, least_exponent):
                    row: dict[str, object] = {"n_runs": len(periodic), "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in periodic]}
                    best = min(periodic, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if periodic else (None, None, None)
                    row |= dict(zip(("start", "length", "period"), best, strict=True))
                    row["exponent_milli"] = 1000 * best[1] // best[2] if periodic else None
                    if "runs_sha256" in made:
                        row["runs_sha256"] = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in periodic).encode()).hexdigest()
                    if "collapsed" in made or "collapsed_sha256" in made:
                        kept = b" ".join(collapsed(words, periodic))
                        row["collapsed"] = kept.decode("utf-8", "replace") if "collapsed" in made else None
                        row["collapsed_sha256"] = hashlib.sha256(kept).hexdigest()
                    for o in outputs:
                        made[o].append(row[o])
                yield pa.RecordBatch.from_arrays([keys] + [pa.array(made[o], ARROW[o]) for o in outputs], [key, *outputs])

    return source.mapInArrow(run, schema)
