"""Operator 9: token counts through a cache of content and tokenizer-version digests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.bpe import byte_letters
from tabulon.llm.common import cut_lineage, fresh, slices

CACHE_SCHEMA = "content_sha256 string, tokenizer_sha256 string, n_tokens long"
#: The split of byte-level vocabularies, as the tokenizer library has it.
BYTE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: a changed vocabulary never meets old counts."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Counter:
    """Counts tokens as the library of the file does: tokenizers for .json, sentencepiece for .model.

    A byte-level vocabulary whose ids follow its merge order, without normaliser, gives the same tokens as a table of
    ranks, so it is counted by the rank library, which is several times faster; all others by their own library.
    """

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = self.ranks(spec)
        if ranks is None:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            self.count = lambda texts: [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
            return
        import tiktoken

        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        table = tiktoken.Encoding("file", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})
        cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.count = lambda texts: [self.parts(table, cut, t) for t in texts]

    @staticmethod
    def parts(table, cut, text: str) -> int:
        """Each special string counts as one token, as is the library's default."""
        rest = cut.split(text) if cut else [text]
        return len(rest) - 1 + sum(len(table.encode_ordinary(r)) for r in rest if r)

    @staticmethod
    def ranks(spec: dict) -> dict[bytes, int] | None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        odd = any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "dropout"))
        added = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens") or [])
        if not plain or odd or added or pre.get("add_prefix_space"):
            return None
        results = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if results != sorted(set(results)) or results[0] < 256 or len(results) + 256 != len(model["vocab"]):
            return None
        byte = {c: b for b, c in enumerate(byte_letters())}
        return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items()}


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def open_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The stored counts; a new folder starts as an empty cache."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(folder)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder)


def token_counts(df: DataFrame, path: str, cache: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """Counts the tokens of every whole text; returns ``key``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    The content digest is SHA-256 of the text (null: the empty text, of 0 bytes and 0 tokens) in UTF-8, unchanged, since
    the vocabulary has no normaliser of its own that would make two texts one. Rows are joined to the counts stored in
    the folder ``cache`` by content and tokenizer digest. Of each missing content one text goes on, whatever the keys of its
    rows: each task drops its repeats before the shuffle. These texts are encoded, and the new counts are appended to the
    cache, one row per content.

    Null keys and repeated rows are kept, each with its count; an empty table gives no rows and appends nothing. Two runs
    that miss the same content at the same time both append the same count, and reading takes one of them.
    """
    spark = df.sparkSession
    version = tokenizer_version(path)
    content = F.coalesce(df[text].cast("string"), F.lit(""))
    named = df.select(df[key].alias("key"), content.alias("text"))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256")
    rows = cut_lineage(named.select("key", digest, F.octet_length("text").cast("long").alias("n_bytes")))
    stored = open_cache(spark, cache).where(F.col("tokenizer_sha256") == version)
    misses = cut_lineage(rows.select("content_sha256").distinct().join(stored, "content_sha256", "left_anti"))
    texts = named.select(digest, "text").groupBy("content_sha256").agg(F.first("text").alias("text"))
    todo = texts.join(misses, "content_sha256", "left_semi").select("content_sha256", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            column = batch.column(1)
            for a, b in slices(column):
                n = own.count(column.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64())], ["content_sha256", "n_tokens"])

    found = todo.mapInArrow(run, "content_sha256 string, n_tokens long")
    found.select("content_sha256", F.lit(version).alias("tokenizer_sha256"), "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer_sha256") == version)
    counts = counts.groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))
    out = rows.join(counts, "content_sha256")
    (name,) = fresh(df.select(), key)
    return out.select(F.col("key").alias(name), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
