"""Operator 11: documents packed into few sequences by bin completion with branch and bound.

The largest piece left opens a sequence; the fillings around it that no other filling dominates are tried, the fullest
first. What a branch has wasted may not exceed what the best packing known, less one sequence, could waste. Best-fit
packings, of all pieces at the start and of the pieces left on the way, are the packings known.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import cut_lineage, fresh, slices
from tabulon.llm.token_counts import BYTE_SPLIT, Counter

CAPACITY = 2048
#: Pieces of one packing task, on average.
GROUP_PIECES = 8192
#: Groups whose emptiest sequences are packed anew together.
FAN_IN = 64
#: Fillings that one task tries beyond one per bin before it keeps the best packing known; those around one largest piece.
SEARCH_FILLINGS = 4000
FILLINGS = 16

OUTPUTS = {"ids": T.ArrayType(T.IntegerType(), False), "ids_crc32": T.LongType()}
ARROW = {"ids": pa.list_(pa.field("element", pa.int32(), False)), "ids_crc32": pa.int64()}


# Token ids


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a file, without added special tokens.

    A plain byte-level vocabulary is read by the rank library, which is several times faster; strings of special tokens
    inside a text become their tokens, as is the default. Texts that it refuses go to the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        ranks, self.table = Counter.ranks(spec), None
        if ranks is not None:
            import tiktoken

            self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
            self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
            self.table = tiktoken.Encoding("file", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.table is not None:
            try:
                parts = self.cut.split(text) if self.cut else [text]
                ids = [np.array([self.special[p]], "<u4") if i % 2 else self.table.encode_to_numpy(p, disallowed_special=()).astype("<u4") for i, p in enumerate(parts) if p]
                return ids[0] if len(ids) == 1 else np.concatenate(ids)
            except (ValueError, RuntimeError):  # the rank library's pattern gives up on extreme runs of one kind
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    return Encoder(path)


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """``key``, piece, start, length and ``outputs``: the token ids of every whole text, with ``end`` behind, cut to size.

    Documents of up to ``capacity`` ids are one piece. Longer ones are cut from behind into pieces of ``capacity``, so
    that the first piece may be shorter. ``piece`` counts from 0, ``start`` is the number of the document's ids before
    it; outputs are ``ids`` and ``ids_crc32`` (unsigned, of the ids as little-endian unsigned 32-bit integers).

    A null or empty text has only ``end``. Repeated rows and null keys are documents each; other columns are left out.
    Texts are encoded in slices of bounded size, a very long one by itself; no shuffle.
    """
    if key.lower() in {"piece", "start", "length", *outputs}:
        raise ValueError(f"the key is named like the output {key}")
    (slot,) = fresh(df.select(key), "text")
    source = df.select(df[key], df[text].cast("string").alias(slot))
    fields = [source.schema[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
    schema = T.StructType(fields + [T.StructField(o, OUTPUTS[o]) for o in outputs])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mark = encoder(path), np.array([end], "<u4")
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                row, piece, start, length = [], [], [], []
                made: dict[str, list] = {o: [] for o in outputs}
                for i, value in enumerate(batch.column(1).slice(a, b - a)):
                    ids = np.concatenate((own.encode(value.as_py() or ""), mark))
                    first = len(ids) - (len(ids) - 1) // capacity * capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for j in range(len(edges) - 1):
                        part = ids[edges[j] : edges[j + 1]]
                        row.append(a + i)
                        piece.append(j)
                        start.append(edges[j])
                        length.append(len(part))
                        if "ids" in made:
                            made["ids"].append(part.astype(np.int32))
                        if "ids_crc32" in made:
                            made["ids_crc32"].append(zlib.crc32(part.tobytes()))
                arrays = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(made[o], ARROW[o]) for o in outputs], [key, "piece", "start", "length", *outputs])

    return source.mapInArrow(run, schema)


# Packing of one group


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of sizes: each size, largest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for size in sizes:
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
            bins[b].append(size)
        else:
            room, b = capacity, len(bins)
            bins.append([size])
        if room > size:
            insort(rooms, (room - size, b))
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """A number of bins that no packing of ``sizes`` (largest first) goes below.

    For each threshold t up to half a bin: sizes over capacity - t stand alone, those over half a bin too, and what the
    others of size t and more don't find room for beside these needs bins of its own.
    """
    s = np.array(sizes, np.int64)
    if not len(s):
        return 0
    total = np.concatenate(([0], np.cumsum(s)))
    half = int(np.searchsorted(-s, -(capacity // 2), side="left"))  # sizes over half a bin
    best = -(-int(total[-1]) // capacity)
    for t in np.unique(s[s <= capacity // 2]).tolist():
        alone = int(np.searchsorted(-s, -(capacity - t), side="left"))
        upto = int(np.searchsorted(-s, -t, side="right"))
        room = (half - alone) * capacity - int(total[half] - total[alone])
        rest = int(total[upto] - total[half]) - room
        best = max(best, half + max(0, -(-rest // capacity)))
    return max(best, half)


class Completion:
    """Depth-first search over the fillings of one bin after the other."""

    def __init__(self, sizes: list[int], capacity: int, budget: int = SEARCH_FILLINGS, width: int = FILLINGS):
        self.capacity, self.width = capacity, width
        self.sizes = sorted(sizes, reverse=True)
        self.best = best_fit(self.sizes, capacity)
        self.budget = budget + len(self.best)
        self.least = least_bins(self.sizes, capacity)

    def solve(self) -> list[list[int]]:
        if len(self.best) > self.least:
            self._search()
        return self.best

    def _search(self) -> None:
        kinds, counts = np.unique(np.array(self.sizes), return_counts=True)
        self.kinds, self.left = kinds[::-1].tolist(), counts[::-1].tolist()  # largest first
        self.fits = np.searchsorted(-kinds[::-1], -np.arange(self.capacity + 1), side="left").tolist()  # first kind up to a room
        self.live = list(range(len(self.kinds)))
        self.total = self.rest = sum(self.sizes)
        often = max(32, len(self.best) // 8)
        done: list[list[int]] = []
        wasted = 0
        levels: list[tuple[Iterator, list[int], int]] = [(iter(self._fillings(self._allowed(0))), [], 0)]
        while levels and self.budget > 0 and len(self.best) > self.least:
            choice = next(levels[-1][0], None)
            if choice is None:
                _, last, room = levels.pop()
                if last:
                    done.pop()
                    wasted -= room
                    self._give(last)
                continue
            self.budget -= 1
            room = self.capacity - sum(self.kinds[i] for i in choice)
            if room > self._allowed(wasted):
                continue
            self._take(choice)
            done.append([self.kinds[i] for i in choice])
            wasted += room
            if len(done) % often == 0 or not self.live:
                packed = done + best_fit([self.kinds[i] for i in self.live for _ in range(self.left[i])], self.capacity)
                if len(packed) < len(self.best):
                    self.best = [list(b) for b in packed]
            levels.append((iter(self._fillings(self._allowed(wasted)) if self.live else ()), choice, room))

    def _allowed(self, wasted: int) -> int:
        """Room that may still be left empty if the packing known is to be beaten."""
        return (len(self.best) - 1) * self.capacity - self.total - wasted

    def _take(self, choice: list[int]) -> None:
        for i in choice:
            self.left[i] -= 1
            self.rest -= self.kinds[i]
            if not self.left[i]:
                del self.live[bisect_left(self.live, i)]

    def _give(self, choice: list[int]) -> None:
        for i in choice:
            if not self.left[i]:
                insort(self.live, i)
            self.left[i] += 1
            self.rest += self.kinds[i]

    def _fillings(self, allowed: int) -> list[list[int]]:
        """Undominated fillings (as kinds) around the largest piece left, that leave ``allowed`` at most, fullest first."""
        if allowed < 0:
            return []
        top = self.live[0]
        self._take([top])
        out: list[tuple[int, list[int]]] = []
        kinds, left, live = self.kinds, self.left, self.live
        steps = 8 * self.width
        stack: list[tuple[int, int, list[int]]] = [(0, self.capacity - kinds[top], [])]
        while stack and steps > 0 and len(out) < self.width:
            steps -= 1
            after, free, chosen = stack.pop()
            at = bisect_left(live, max(after, self.fits[free]))
            if at == len(live):
                if free <= allowed and not self._dominated(chosen, free):
                    out.append((free, chosen))
                continue
            kind = live[at]
            stack.append((kind + 1, free, chosen))  # without this kind: tried after all that hold it
            for n in range(1, min(left[kind], free // kinds[kind]) + 1):
                stack.append((kind + 1, free - n * kinds[kind], chosen + [kind] * n))
        self._give([top])
        out.sort(key=lambda x: x[0])
        return [[top, *chosen] for _, chosen in out]

    def _dominated(self, chosen: list[int], free: int) -> bool:
        """Whether a piece left out fits in place of a smaller one, or of two that are as large together or smaller."""
        kinds, left, live = self.kinds, self.left, self.live

        def spare(low: int, high: int) -> bool:
            at = bisect_left(live, self.fits[min(high, self.capacity)])
            while at < len(live) and kinds[live[at]] >= low:
                if left[live[at]] > chosen.count(live[at]):
                    return True
                at += 1
            return False

        sizes = [kinds[k] for k in chosen]
        if free and any(spare(size + 1, size + free) for size in set(sizes)):
            return True
        last = sizes[-8:]
        return any(spare(a + b, a + b + free) for i, a in enumerate(last) for b in last[i + 1 :])


def packed(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin (from 0, the emptiest last) and offset of each piece, given their lengths."""
    bins = Completion(lengths.tolist(), capacity).solve()
    bins.sort(key=sum, reverse=True)
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    ends = dict(zip(*(x.tolist() for x in np.unique(-lengths[order], return_index=True)), strict=True))
    for b, sizes in enumerate(bins):
        at = 0
        for size in sizes:
            row = order[ends[-size]]
            ends[-size] += 1
            bin_of[row], offset[row] = b, at
            at += size
    return bin_of, offset


# Packing of a table


def pack(rows: DataFrame, length: str = "length", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """All rows with ``sequence_id`` and ``offset``: rows of one sequence lie gapless from 0 within ``capacity``.

    Rows of full length are sequences by themselves and don't move. The others are dealt evenly to groups of about
    ``group_pieces`` by a hash of their number, whatever their keys and lengths are, and each group is packed by bin
    completion, which ends at a proven optimum of the group or after ``SEARCH_FILLINGS`` tries with the best packing
    known. The emptiest sequence of each group is opened again and its rows are packed together with those of 63 other
    groups, and so on, until one group is left; so a table loses about one sequence to grouping, not one per group.

    Nulls: a null length has a null sequence and offset. Lengths lie between 1 and ``capacity``, others raise an error.
    Repeated rows are packed each. An empty table gives no rows. Columns of ``rows`` named like an output are replaced.
    """
    rows = rows.select(*[c for c in rows.columns if c.lower() not in ("sequence_id", "offset")])
    (number, group) = fresh(rows, "row", "group")
    base = cut_lineage(rows.withColumn(number, F.monotonically_increasing_id()))
    size = F.col(length)
    facts = base.agg(F.count_if(size < capacity).alias("n"), F.min(size).alias("least"), F.max(size).alias("most")).first()
    if facts["least"] is not None and (facts["least"] < 1 or facts["most"] > capacity):
        raise ValueError(f"lengths from {facts['least']} to {facts['most']}, allowed are 1 to {capacity}")
    alone = F.when(size == capacity, -(F.col(number) + 1))
    out = [base.where(size.isNull() | (size == capacity)).select(*rows.columns, alone.alias("sequence_id"), F.when(size == capacity, F.lit(0).cast("long")).alias("offset"))]
    groups = max(1, -(-facts["n"] // group_pieces))
    todo = base.where(size < capacity).withColumn(group, F.pmod(F.xxhash64(number), F.lit(groups)))
    level = 0
    while facts["n"]:
        schema = T.StructType([*todo.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("last", T.BooleanType())])
        made = todo.groupBy(group).applyInArrow(_packer(length, group, capacity, level), schema)
        if groups > 1:
            made = cut_lineage(made)
            out.append(made.where(~F.col("last")).select(*rows.columns, "sequence_id", "offset"))
            todo = made.where("last").drop("sequence_id", "offset", "last").withColumn(group, F.floor(F.col(group) / FAN_IN))
        else:
            out.append(made.select(*rows.columns, "sequence_id", "offset"))
            break
        groups, level = -(-groups // FAN_IN), level + 1
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def _packer(length: str, group: str, capacity: int, level: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bin_of, offset = packed(rows[length].to_numpy(), capacity)
        first = (level << 58) + (key[0].as_py() << 20)  # a group has fewer than 2^20 rows
        out = rows.append_column("sequence_id", pa.array(first + bin_of, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        return out.append_column("last", pa.array(bin_of == bin_of.max(initial=0)))

    return run


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from pieces with their ``ids``, sequence and offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
