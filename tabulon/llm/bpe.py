"""Operator 1: byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

``Codec`` reads a tokenizer file, cuts a text into pieces as the file says and merges each distinct piece once.
The merges of many pieces run side by side: each piece has a segment tree whose leaves hold (rank, position) of its
adjacent pairs, the root is the leftmost pair of the lowest rank, and a merge changes three leaves and their parents.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabulon.llm.common import slices

NEVER = np.int64(1 << 62)
POSITION_BITS = 31
#: Distinct pieces whose ids a Python worker keeps; beyond it the cache starts anew.
CACHE_PIECES = 150_000
#: Texts over this many characters are cut at white space, which no piece holds, to bound memory.
CUT_CHARS = 1 << 20

OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType(), False), "n_tokens": T.LongType(), "ids_sha256": T.StringType(),
    "decoded": T.StringType(), "decoded_sha256": T.StringType(),
}
ARROW = {
    "ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(),
    "decoded_sha256": pa.string(),
}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else 256 and up in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def plain_pattern() -> re.Pattern:
    """The split of the word vocabulary for lower-case texts below U+0180, without the regex library's Unicode tables."""
    letters = "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == "L")
    numbers = "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == "N")
    spaces = "\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


#: Characters whose case, composition or class is left to the tokenizer library.
UNUSUAL = re.compile("[İƀ-\U0010ffff]")
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PairMerges:
    """Merges of a byte-pair vocabulary, applied to many pieces at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.result = np.array([vocab[a + (b)] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NEVER`` for pairs that don't merge."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers; pieces of like length share an array."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        width = 1
        todo = np.flatnonzero(sizes > 0)
        while len(todo):
            now = todo[sizes[todo] - 1 <= width]
            todo = todo[sizes[todo] - 1 > width]
            step = max(1, (1 << 18) // width)
            for i in range(0, len(now), step):
                rows = now[i : i + step]
                for row, ids in zip(rows, self._merge([pieces[r] for r in rows], sizes[rows], width), strict=True):
                    out[row] = ids
            width *= 2
        return out

    def _merge(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        m, n = len(pieces), width + 2
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        row = np.repeat(np.arange(m), sizes)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        end = col == np.repeat(sizes, sizes) - 1
        symbols = np.full((m, n), -1, np.int64)
        symbols[row, col] = np.where(end, self.last[flat], self.inner[flat])
        after = np.tile(np.arange(1, n + 1, dtype=np.int32), (m, 1))
        before = np.tile(np.arange(-1, n - 1, dtype=np.int32), (m, 1))
        tree = np.full((m, 2 * width), NEVER, np.int64)
        where = np.arange(width)
        ranks = self.rank(np.where(symbols[:, :width] < 0, 0, symbols[:, :width]), symbols[:, 1 : width + 1])
        ranks[symbols[:, 1 : width + 1] < 0] = NEVER
        tree[:, width:] = np.where(ranks < NEVER, ranks << POSITION_BITS | where, NEVER)
        level = width
        while level > 1:
            pair = tree[:, level : 2 * level]
            level //= 2
            tree[:, level : 2 * level] = np.minimum(pair[:, ::2], pair[:, 1::2])
        live = np.flatnonzero(tree[:, 1] < NEVER)
        while len(live):
            best = tree[live, 1]
            at = (best & ((1 << POSITION_BITS) - 1)).astype(np.int64)
            merged = self.result[best >> POSITION_BITS]
            gone = after[live, at]
            following = after[live, gone]
            symbols[live, at], symbols[live, gone] = merged, -1
            after[live, at], before[live, following] = following, at
            has_next = symbols[live, following] >= 0
            previous = before[live, at]
            has_prev = previous >= 0
            ahead = np.full(len(live), NEVER)
            ahead[has_next] = self.rank(merged[has_next], symbols[live[has_next], following[has_next]])
            behind = np.full(len(live), NEVER)
            behind[has_prev] = self.rank(symbols[live[has_prev], previous[has_prev]], merged[has_prev])
            self._put(tree, live, at, ahead, width)
            inside = gone < width
            self._put(tree, live[inside], gone[inside].astype(np.int64), np.full(int(inside.sum()), NEVER), width)
            self._put(tree, live[has_prev], previous[has_prev].astype(np.int64), behind[has_prev], width)
            live = live[tree[live, 1] < NEVER]
        kept = symbols >= 0
        ids = symbols[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(1)) * 4
        starts = np.concatenate(([0], ends[:-1]))
        return [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, rank: np.ndarray, width: int) -> None:
        """Point update: a leaf and its parents up to the root."""
        node = leaf + width
        tree[rows, node] = np.where(rank < NEVER, rank << POSITION_BITS | leaf, NEVER)
        while width > 1:
            width //= 2
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])


class Codec:
    """Encodes and decodes as the tokenizer library does for the same file, without added special tokens.

    Strings of special tokens inside a text become their tokens, as is the library's default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        self.library = Tokenizer.from_file(path)
        self.merges = PairMerges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec.get("added_tokens") or []}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens") or []):
            raise ValueError(f"{path}: added tokens with options are not supported")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        size = max([*model["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])]) + 1
        self.token = [""] * size
        for text, i in model["vocab"].items():
            self.token[i] = text
        for t in spec.get("added_tokens") or []:
            self.token[t["id"]] = t["content"]
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"{path}: decoder {kind} is not supported")
        self.joined_bytes = kind == "ByteLevel"
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.plain = plain_pattern() if WORD_SPLIT in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\") else None
        self.ids_of: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str | bytes]:
        """Pieces between special tokens; texts of usual letters take a plain pattern, others the library's own split."""
        if self.plain is not None and not UNUSUAL.search(text):
            return self.plain.findall(text.lower())
        norm = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def parts(self, text: str) -> Iterator[list[str | bytes]]:
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                yield [piece]
                continue
            start = 0
            while start < len(piece):
                end = start + CUT_CHARS
                if end < len(piece) and self.plain is not None:
                    gap = re.compile(r"[ \t\n\r]").search(piece, end)
                    end = gap.start() if gap else len(piece)
                else:
                    end = len(piece)
                yield self.pieces(piece[start:end])
                start = end

    def learn(self, lists: Iterable[list[str | bytes]]) -> None:
        """Merges the pieces that the cache lacks."""
        unknown = set()
        for pieces in lists:
            unknown.update(pieces)
        if len(self.ids_of) + len(unknown) > CACHE_PIECES:
            self.ids_of = dict(self.special)
        unknown.difference_update(self.ids_of)
        unknown.difference_update(self.special)
        words = list(unknown)
        found = self.merges.encode([w if isinstance(w, bytes) else w.encode() for w in words])
        self.ids_of.update(self.special)
        self.ids_of.update(zip(words, found, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if sum(map(len, texts)) <= 2 * CUT_CHARS:
            cut = [list(self.parts(t)) for t in texts]
            self.learn(p for parts in cut for p in parts)
            return [b"".join([self.ids_of[x] for p in parts for x in p]) for parts in cut]
        out = []
        for text in texts:
            ids = []
            for pieces in self.parts(text):
                self.learn([pieces])
                ids.append(b"".join([self.ids_of[x] for x in pieces]))
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        """Text of the ids, special tokens kept: tokens joined by spaces, or their bytes if the file has a byte decoder."""
        tokens = [self.token[i] for i in np.frombuffer(ids, "<u4").tolist()]
        if not self.joined_bytes:
            return " ".join(tokens)
        raw = bytearray()
        for t in tokens:
            raw += bytes(self.byte_of[c] for c in t) if all(c in self.byte_of for c in t) else t.encode()
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    return Codec(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns the columns ``keep`` (default: all of ``df``) and of ``outputs``: ``ids``, ``n_tokens``, ``ids_sha256`` (of the
    ids as little-endian unsigned 32-bit integers), ``decoded``, ``decoded_sha256``. A column of ``df`` with the name of
    an output is replaced, whatever its case. Null counts as the empty text, which has no ids; repeated rows stay, each
    with its result; an empty table stays empty. No shuffle: memory is bounded by the longest text and a cache of pieces.

    ``path`` is the tokenizer file, which each Python worker opens.
    """
    if unknown := set(outputs) - set(OUTPUTS):
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    names = {o.lower() for o in outputs}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    slot = "text"
    while slot.lower() in {c.lower() for c in kept}:
        slot += "_"
    source = df.select(*[df[c] for c in kept], df[text].alias(slot))
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(o, OUTPUTS[o]) for o in outputs])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in slices(column):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                ids = own.encode(texts)
                made: dict[str, list] = {o: [] for o in outputs}
                for x in ids:
                    if "ids" in made:
                        made["ids"].append(np.frombuffer(x, "<i4"))
                    if "n_tokens" in made:
                        made["n_tokens"].append(len(x) // 4)
                    if "ids_sha256" in made:
                        made["ids_sha256"].append(hashlib.sha256(x).hexdigest())
                    if "decoded" in made or "decoded_sha256" in made:
                        back = own.decode(x)
                        if "decoded" in made:
                            made["decoded"].append(back)
                        if "decoded_sha256" in made:
                            made["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                arrays += [pa.array(made[o], ARROW[o]) for o in outputs]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *outputs])

    return source.mapInArrow(run, schema)
