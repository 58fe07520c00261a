"""Operator 3: mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

DataFrame functions only. Words stand for tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import cut_lineage, word_count

#: Words in a block; the last block of a source is shorter.
BLOCK_WORDS = 32768
#: Rows that a chunk of a running sum or rank has on average.
CHUNK_ROWS = 1 << 11
WEIGHTS = (3, 1, 2)
#: A prime above any number of blocks; multiples of it visit each whole block once.
STRIDE = 2147483647


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size: the only columns that the mix needs of a document."""
    return df.select(df[key].alias("doc_id"), df[source].cast("string").alias("source"), word_count(df[text]).alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, rank: one row for each source.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all words. A target stops
    at ``most`` times its source's size; what is over goes to the others by weight until none is above. Sources by
    rising ``most * size / weight``: the first that fit under the common level keep their bound, the rest get the level
    times their weight.
    """
    if share > most:
        raise ValueError("the shared words can't exceed what the sources may give")
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = total.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", cycle)
    bound = ranked.withColumn("bound", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("bound") / F.col("weight"))
    rising = Window.orderBy("ratio", "rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size")).over(everything) * F.lit(float(share)) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = bound.withColumn("level", F.greatest(left / rest, F.lit(0.0)))
    held = level.withColumn("held", F.col("ratio") <= F.col("level"))
    free = F.min(F.when(~F.col("held"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    target = F.when(F.col("held"), F.col("bound")).otherwise(F.least(free * F.col("weight"), F.col("bound")))
    return held.withColumn("target", target).select("source", "source_size", "target", "rank")


def placed(sizes: DataFrame, seed: int, chunks: int) -> DataFrame:
    """Adds chunk, place and start: the documents of a source in shuffled order and the words before each.

    A running sum over a whole source would put a large source into one task, so each source is cut into ``chunks`` by
    hash; sums of chunks give where each begins.
    """
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("size"))
    rows = sizes.withColumn("mark", mark).withColumn("chunk", F.pmod(F.shiftrightunsigned(F.col("mark"), 20), F.lit(chunks)))
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("source", "chunk", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("source", "chunk").orderBy("mark", "doc_id", "size")
    own = rows.withColumn("place", F.row_number().over(inside)).withColumn(
        "within", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    same = own["source"].eqNullSafe(begins["source"]) & (own["chunk"] == begins["chunk"])
    return own.join(begins, same).select(
        own["doc_id"], own["source"], own["size"], own["chunk"], own["place"], (F.col("begin") + F.col("within")).alias("start")
    )


def reversed_bits(number: Column, bits: int) -> Column:
    """The van der Corput permutation of 0 .. 2^bits - 1."""
    if not bits:
        return F.lit(0).cast("long")
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("long")


def slots(goal: DataFrame, block_words: int) -> DataFrame:
    """slot, source, source_size, epoch, block, take: which block of which source comes when, and how many of its words.

    A source needs one slot for each block it gives. The slots of all sources lie side by side in 0 .. 2^b - 1; point i
    of the van der Corput sequence falls into one source's interval, and its rank among that source's points says
    which of the source's blocks comes. Points past the last interval are idle. The interval lengths are whole numbers
    of grid steps, so each source gets its slots exactly, and any stretch of the schedule has the sources nearly by
    weight. Ranks are counted in stretches of the schedule first, so no source is ranked in one task.
    """
    need = goal.withColumn("goal", F.round("target").cast("long")).where(F.col("goal") > 0)
    blocks = F.ceil(F.col("source_size") / block_words)
    passes = F.floor(F.col("goal") / F.col("source_size"))
    rest = F.col("goal") - passes * F.col("source_size")
    need = need.withColumn("blocks", blocks).withColumn("slots", (passes * blocks + F.ceil(rest / block_words)).cast("long"))
    line = Window.orderBy("rank")
    need = need.withColumn("high", F.sum("slots").over(line)).withColumn("low", F.col("high") - F.col("slots"))
    need = cut_lineage(need)
    count = need.agg(F.max("high")).first()[0] or 0
    if not count:
        return need.select(F.lit(0).cast("long").alias("slot"), "source", "source_size", F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("take")).limit(0)
    bits = max(0, math.ceil(math.log2(count)))
    grid = goal.sparkSession.range(1 << bits).select(F.col("id").alias("slot"))
    points = grid.withColumn("at", reversed_bits(F.col("slot"), bits)).where(F.col("at") < count)
    # intervals meet points by stretches of the grid, so the join has an equal key and no pair of all sources and points
    step = max(1, (1 << bits) // 4096)
    spans = need.withColumn("span", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("high") - 1) / step))))
    points = points.withColumn("span", F.floor(F.col("at") / step))
    hit = points.join(spans, "span").where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    part = hit.withColumn("stretch", F.floor(F.col("slot") / CHUNK_ROWS))
    counts = part.groupBy("rank", "stretch").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("rank").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("rank", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = part.withColumn("own", F.row_number().over(Window.partitionBy("rank", "stretch").orderBy("slot")) - 1)
    turn = own.join(base, ["rank", "stretch"]).withColumn("turn", F.col("base") + F.col("own"))
    whole = F.floor(F.col("source_size") / block_words)
    epoch, position = F.floor(F.col("turn") / F.col("blocks")), F.col("turn") % F.col("blocks")
    block = F.when(position < whole, (position * STRIDE + epoch * 7919) % F.greatest(whole, F.lit(1))).otherwise(whole)
    full = F.least(F.lit(block_words), F.col("source_size") - block * block_words)
    given = F.col("goal") - epoch * F.col("source_size") - position * block_words
    return turn.select("slot", "source", "source_size", epoch.alias("epoch"), block.alias("block"), F.least(full, given).alias("take"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix of all documents as (pieces, accounts).

    ``pieces``: slot, doc_id, source, epoch, from_word, to_word; in slot order they are the mixed stream. Each source's
    documents, shuffled by hash, form one stream of words that is cut into blocks; a document may lie in several.
    ``accounts``: one row for each document: doc_id, source, size, source_size, target, taken.

    Taken words of a source are its target, rounded. No document gives more than twice its words, as no block comes more
    than twice with ``most`` = 2. The order is that of hashes, so reruns agree. Null text has size 0 and takes no part
    but keeps its row; a null source is a source, last in order; null and repeated keys and rows stay apart, ties of the
    shuffle are between equal rows; an empty table gives two empty tables.
    """
    rows = cut_lineage(sized(df, key, text, source))
    chunks = max(1, math.ceil(rows.count() / CHUNK_ROWS))
    goal = cut_lineage(targets(rows, weights, share, most))
    where = placed(rows, seed, chunks)
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    first = F.floor(F.col("start") / block_words)
    lying = where.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    plan = slots(goal, block_words)
    same = lying["source"].eqNullSafe(plan["source"]) & (lying["block"] == plan["block"])
    met = lying.join(plan, same).select(
        plan["slot"], lying["doc_id"], lying["source"], lying["chunk"], lying["place"], plan["epoch"],
        F.greatest(F.lit(0), lying["block"] * block_words - lying["start"]).alias("from_word"),
        F.least(lying["size"], lying["block"] * block_words + plan["take"] - lying["start"]).alias("to_word"),
    ).where(F.col("to_word") > F.col("from_word"))
    used = met.groupBy("source", "chunk", "place").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    here = where.alias("w")
    mine = F.col("w.source").eqNullSafe(F.col("u.source")) & (F.col("w.chunk") == F.col("u.chunk")) & (F.col("w.place") == F.col("u.place"))
    with_taken = here.join(used.alias("u"), mine, "left").select("w.doc_id", "w.source", "w.size", F.coalesce("u.taken", F.lit(0)).alias("taken"))
    account = with_taken.join(goal, with_taken["source"].eqNullSafe(goal["source"])).select(
        with_taken["doc_id"], with_taken["source"], "size", "source_size", "target", "taken"
    )
    return met.drop("chunk", "place"), account
