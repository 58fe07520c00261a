"""Operator 10: similarity join on word shingles by rare-first prefix filtering.

A document's set is its distinct shingles of some words, as 64-bit hashes. Documents with equal sets form one class, of
which one goes on. Shingles are ordered by how many documents have them, rare ones first; two sets as similar as asked
must share a shingle within a short prefix of both. Classes that meet in a prefix shingle are held against length,
position and suffix bounds, and each pair that is left is verified once on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import cut_lineage, fresh, slices
from tabulon.llm.components import components
from tabulon.llm.counting import summed
from tabulon.llm.words import shingles, words

#: Counters of shingle frequency, hashed; their number doesn't grow with the data, so the table that tasks get is bounded.
COUNTERS = 1 << 22
#: Parts of the hash range whose sizes bound the overlap of two sets.
PARTS = 128
#: Bits of the filter that keeps whole sets of classes in no candidate pair off the network.
FILTER_BITS = 1 << 24


def doc_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    runs, ahead = shingles(*words(column), size)
    for a, b in zip(ahead[:-1].tolist(), ahead[1:].tolist(), strict=True):
        yield np.unique(runs[a:b])


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def content(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a whole text; null is the empty text."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(seed), whole) for seed in (1, 2)]


def narrow(df: DataFrame, key: str, text: str) -> DataFrame:
    first, second = content(df[text])
    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text"), first.alias("content"), second.alias("content2"))


def frequency_table(df: DataFrame, size: int) -> np.ndarray:
    """For each counter a coarse logarithm of how many documents have a shingle that falls into it; a few MB at any scale."""

    def count(batches: Iterable[pa.RecordBatch], total: np.ndarray) -> None:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                for own in doc_sets(batch.column(0).slice(a, b - a), size):
                    np.add.at(total, counter_of(own), 1)

    # a task sees fewer than 2^32 documents
    return np.minimum(255, np.floor(8 * np.log2(1 + summed(df.select("text"), COUNTERS, count, np.uint32)))).astype(np.uint8)


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(COUNTERS)).astype(np.int64)


def part_sizes(own: np.ndarray) -> bytes:
    """How many shingles of a set fall into each part of the hash range."""
    sizes = np.bincount((own >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS)
    return sizes.astype("<u1" if sizes.max() < 256 else "<u4").tobytes()


def prefix_length(n: np.ndarray | int, share: int, of: int):
    """Shingles that a set of n must show so that any set with overlap share / of of the union meets one of them."""
    return n - (share * n + of - 1) // of + 1


def sketches(df: DataFrame, table: np.ndarray, size: int, share: int, of: int) -> DataFrame:
    """doc_id, content hashes, n, digest, prefix (rare first), last (where the prefix ends in the order), parts (sizes of the set within
    equal parts of the hash range)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sizes, digests, prefixes, lasts, parts = [], [], [], [], []
                for own in doc_sets(batch.column(1).slice(a, b - a), size):
                    n = len(own)
                    sizes.append(n)
                    digests.append(digest(own))
                    rarity = table[counter_of(own)]
                    order = np.argsort(rarity, kind="stable")[: prefix_length(n, share, of) if n else 0]
                    prefixes.append(own[order].view(np.int64))
                    lasts.append(bytes([rarity[order[-1]]]) + int(own[order[-1]]).to_bytes(8, "big") if n else b"")
                    parts.append(part_sizes(own))
                arrays = [batch.column(i).slice(a, b - a) for i in (0, 2, 3)]
                arrays += [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(lasts, pa.binary()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "content", "content2", "n", "digest", "prefix", "last", "parts"])

    return df.mapInArrow(run, "doc_id long, content long, content2 long, n long, digest binary, prefix array<long>, last binary, parts binary")


def bounded(pairs: DataFrame, classes: DataFrame, share: int, of: int) -> DataFrame:
    """Pairs (a, b) that the length and suffix filters let through.

    The suffix filter bounds the overlap by what the sets can share within each part of the hash range.
    """
    a = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa"))
    b = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb"))
    near = pairs.join(a, "a").join(b, "b").where((F.least("na", "nb") * of >= F.greatest("na", "nb") * share))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.stack([np.frombuffer(v, "<u1" if len(v) == PARTS else "<u4") for v in batch.column(c).to_pylist()]).astype(np.int64) for c in ("pa", "pb"))
            most = np.minimum(x, y).sum(1)
            fine = of * most >= share * (x.sum(1) + y.sum(1) - most)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(fine)) for c in ("a", "b")], ["a", "b"])

    return near.select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


def filter_bit(mark: bytes) -> int:
    return int.from_bytes(mark[:3], "big")


def whole_sets(df: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """cid, set of all ``needed`` classes (cid, digest), cut anew from the texts.

    A bit table of fixed size drops most other texts before the shuffle; where it lets one through, the join drops it.
    """
    bit = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("long")
    marks = needed.select(F.floor(bit / 32).alias("word"), (bit % 32).cast("int").alias("at"))
    rows = marks.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits"))
    flags = np.zeros(FILTER_BITS // 32, np.int64)
    for row in rows.toLocalIterator():
        flags[row["word"]] = row["bits"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for a, b in slices(batch.column(0)):
                digests, sets = [], []
                for own in doc_sets(batch.column(0).slice(a, b - a), size):
                    if not len(own):
                        continue
                    mark = digest(own)
                    at = filter_bit(mark)
                    if flags[at // 32] >> (at % 32) & 1 and mark not in sent:
                        sent.add(mark)
                        digests.append(mark)
                        sets.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["digest", "set"])

    found = df.select("text").mapInArrow(run, "digest binary, set binary").join(needed, "digest")
    return found.groupBy("cid").agg(F.first("set").alias("set"))


def verified(pairs: DataFrame, df: DataFrame, classes: DataFrame, size: int, share: int, of: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are as similar as asked."""
    near = cut_lineage(bounded(pairs, classes, share, of))
    ends = near.select(F.col("a").alias("cid")).union(near.select(F.col("b").alias("cid"))).distinct()
    sets = cut_lineage(whole_sets(df, cut_lineage(classes.join(ends, "cid", "left_semi").select("cid", "digest")), size))
    both = near.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(of * common >= share * (len(x) + len(y) - common))
            keep = pa.array(fine, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return cut_lineage(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def prefix_meetings(classes: DataFrame) -> DataFrame:
    """shingle, cid, n, pos, usable, last: the prefix shingles that at least two classes have.

    ``usable`` is n without the prefix shingles that no other prefix has, and ``last`` orders classes by where their
    prefix ends.
    """
    entries = classes.select("cid", F.posexplode("prefix").alias("pos", "shingle"))
    met = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("shingle")
    held = cut_lineage(entries.join(met, "shingle").select("shingle", "cid", "pos"))
    counts = held.groupBy("cid").agg(F.count(F.lit(1)).alias("held"))
    known = counts.join(classes.select("cid", "n", "last", F.size("prefix").alias("length")), "cid")
    sized = held.join(known, "cid")
    return cut_lineage(sized.select("shingle", "cid", "n", "pos", (F.col("n") - F.col("length") + F.col("held")).alias("usable"), "last"))


def possible(x: str, y: str, share: int, of: int) -> Column:
    """Length, position and prefix bounds of two classes, to hold at their first common prefix shingle.

    None before that one is common, so at most what is left of either set from there on is. The class whose prefix ends
    first in the order can have in common, of its prefix, only what is in the other's prefix too, so never more than its
    usable shingles.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    left = F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos"))
    usable = F.when(c(x, "last") < c(y, "last"), c(x, "usable")).when(c(x, "last") > c(y, "last"), c(y, "usable")).otherwise(F.least(c(x, "usable"), c(y, "usable")))
    most = F.least(left, usable)
    return (F.least(c(x, "n"), c(y, "n")) * of >= F.greatest(c(x, "n"), c(y, "n")) * share) & (most * of >= share * (c(x, "n") + c(y, "n") - most))


def star_links(shared: DataFrame, docs: DataFrame, classes: DataFrame, size: int, share: int, of: int) -> tuple[DataFrame, DataFrame]:
    """Links of each class to the one that has a prefix shingle earliest, and the pairs held against each other for it.

    That one has the fewest shingles of its own, so it is likeliest in the middle of a group of near copies.
    """
    heads = shared.groupBy("shingle").agg(F.min(F.struct("pos", "cid", "n", "usable", "last")).alias("h"))
    heads = heads.select("shingle", "h.*").alias("x")
    rows = shared.alias("y").join(heads, F.col("x.shingle") == F.col("y.shingle")).where(F.col("x.cid") != F.col("y.cid"))
    pairs = rows.where(possible("x", "y", share, of)).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))
    pairs = cut_lineage(pairs.distinct())
    return verified(pairs, docs, classes, size, share, of), pairs


def remaining_pairs(shared: DataFrame, known: DataFrame, share: int, of: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that may be similar.

    In each prefix shingle the classes outside its largest component meet all of other components.
    """
    labelled = shared.join(known.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = labelled.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    rest = cut_lineage(labelled.join(mixed, "shingle").select(*shared.columns, "component"))
    sizes = rest.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("rows"))
    largest = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("rows", "component")).alias("largest"))
    minor = rest.join(largest, "shingle").where(F.col("component") != F.col("largest")).alias("x")
    once = (F.col("x.cid") < F.col("y.cid")) | (F.col("y.component") == F.col("x.largest"))
    pair = minor.join(rest.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component")) & once & possible("x", "y", share, of))
    return pair.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, share: int = 85, of: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``df``; ``linked`` with the names of the query.

    Two documents link when ``of`` times the intersection of their sets is at least ``share`` times the union; the
    component is the smallest key reachable by links, the document's own included.

    No group is expanded into pairs: equal sets are one class; of the classes that share a prefix shingle each is first
    held against the least one; links found make components, and only classes of different components that still share a
    prefix shingle are paired, on the side of all components but the largest. So a large group of near copies costs
    one comparison each, and no link between different components is lost.

    Null and empty texts and such without words have 0 shingles and are their own component; texts with fewer words than
    a shingle have their whole sequence as the only one. Null keys link as other rows, but name no component unless all
    of it are null; repeated rows stay. An empty table gives no rows. Texts are cut whole, however long.
    """
    out = linked(df, key, text, size, share, of)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, share: int = 80, of: int = 100) -> DataFrame:
    """The rows of ``df`` without near copies: one text of each component, and all texts without words.

    The text that stays is that of the smallest key (null last), of several under that key the one of the smallest content
    hash, so reruns agree. Different texts under one key are judged apart. Of rows that repeat key and text one stays, the
    smallest by a hash of its other columns. Rows are chosen by key and content hash; whole texts are joined once.
    """
    out = linked(df, key, text, size, share, of)
    last = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "content", "content2")
    best = out.where("n > 0").groupBy("component").agg(F.min(last).alias("w")).select("w.doc_id", "w.content", "w.content2", F.lit(False).alias("blank"))
    blank = out.where("n = 0").select("doc_id", "content", "content2", F.lit(True).alias("blank")).distinct()
    names = fresh(df, "kept_id", "kept_content", "kept_content2", "kept_blank", "own_content", "own_content2", "place")
    kept = cut_lineage(best.unionByName(blank)).toDF(*names[:4])
    first, second = content(df[text])
    rows = df.withColumns({names[4]: first, names[5]: second})
    same = rows[key].cast("long").eqNullSafe(kept[names[0]]) & (rows[names[4]] == kept[names[1]]) & (rows[names[5]] == kept[names[2]])
    met = rows.join(kept, same)
    order = Window.partitionBy(rows[key], rows[names[4]], rows[names[5]]).orderBy(F.xxhash64(*[df[c] for c in df.columns if c != text]))
    once = met.where(~F.col(names[3])).withColumn(names[6], F.row_number().over(order)).where(F.col(names[6]) == 1)
    return once.select(*df.columns).unionByName(met.where(names[3]).select(*df.columns))


def linked(df: DataFrame, key: str, text: str, size: int, share: int, of: int) -> DataFrame:
    """doc_id, content hashes, n (shingles), component (null without any) and component_id of each row of ``df``."""
    docs = narrow(df, key, text)
    found = cut_lineage(sketches(docs, frequency_table(docs, size), size, share, of))
    filled = found.where("n > 0")
    classes = filled.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("last").alias("last"), F.first("parts").alias("parts"))
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()))

    shared = prefix_meetings(classes)
    links, tried = star_links(shared, docs, classes, size, share, of)
    more = verified(cut_lineage(remaining_pairs(shared, components(links), share, of).join(tried, ["a", "b"], "left_anti")), docs, classes, size, share, of)

    final = components(links.union(more))
    named = classes.select("cid", "digest", "least").join(final.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_digest = named.join(names, "component").select("digest", "component", "component_id")
    return found.select("doc_id", "content", "content2", "n", "digest").join(by_digest, "digest", "left").drop("digest")
