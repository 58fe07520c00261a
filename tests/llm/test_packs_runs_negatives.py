"""Packing against the tokenizer library and lower bounds, runs and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulon.llm import negatives, packing, periods, queries
from tests.llm import brute

VOCABULARY = queries.vocabulary("byte_bpe_50k.json")


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS Piece", "1 AS OFFSET", "2 AS sequence_id", "3 AS runs", "4 AS `group`")


# Packing


def check_packing(placed, capacity):
    """Rows of each sequence lie gapless from 0 within the capacity."""
    by: dict = {}
    for r in placed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packed_pieces_are_the_librarys_ids(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["law", "señor", "x1", "<|endoftext|>", "日本", "\n\n", "  a"]) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "no id"), (None, "no id"), (7, "again"), (202, "ab " * 9000), (203, "é" * 4000), (204, " " * 3000)]
    df = texts(spark, rows)
    cut = packing.pieces(df, VOCABULARY, capacity=64, outputs=("ids", "ids_crc32"))
    placed = packing.pack(cut, capacity=64, group_pieces=40)
    got = placed.collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 64 or 64
        edges = [0, *range(first, len(ids) + 1, 64)]
        for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want.append((str(key), j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == sorted(want)
    total = sum(w[3] for w in want)
    assert check_packing(got, 64) <= -(-total // 64) + 2  # not one per group: there are several groups
    whole = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    assert sum(map(len, whole.values())) == total and max(map(len, whole.values())) <= 64


def test_packing_reaches_the_optimum_of_small_cases():
    rnd = random.Random(4)
    for _ in range(200):
        capacity = rnd.choice([10, 20, 100])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 10))]
        best = brute.fewest_bins(sizes, capacity)
        search = packing.Completion(sizes, capacity)
        assert search.least <= best == len(search.solve())
        bin_of, offset = packing.packed(np.array(sizes), capacity)
        assert bin_of.max() + 1 == best and (offset + np.array(sizes) <= capacity).all()


def test_search_beats_best_fit():
    sizes = np.random.default_rng(0).integers(100, 1100, 200).tolist()
    search = packing.Completion(sizes, 2048)
    assert len(search.best) > search.least == len(search.solve())


def test_packing_lengths_and_odd_tables(spark):
    df = spark.createDataFrame([(1, 64), (2, 64), (3, None), (4, 1), (5, 63), (6, 32)], "id long, length int")
    got = {r.id: r for r in packing.pack(df, capacity=64).collect()}
    assert got[3].sequence_id is None and got[3].offset is None and got[1].sequence_id != got[2].sequence_id
    assert got[4].sequence_id == got[5].sequence_id and got[1].offset == 0
    assert packing.pack(df.limit(0), capacity=64).count() == 0
    for bad in (0, 65):
        with pytest.raises(ValueError, match="allowed"):
            packing.pack(df.limit(1).withColumn("length", F.lit(bad)), capacity=64)
    # one length holds most rows, in more groups than one merge takes
    many = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 64 + 1).alias("length"))
    placed = packing.pack(many, capacity=64, group_pieces=60).collect()
    assert len(placed) == 9000
    assert check_packing(placed, 64) <= -(-sum(r.length for r in placed) // 64) * 1.03


# Runs


def test_runs_of_random_words_as_brute_force():
    rnd = random.Random(1)
    for _ in range(600):
        n, letters = rnd.randint(0, 60), rnd.randint(1, 3)
        s = [rnd.randrange(letters) for _ in range(n)]
        if n > 5 and rnd.random() < 0.6:
            p, a = rnd.randint(1, n // 3), rnd.randrange(n)
            s[a:] = [s[a + (i - a) % p] for i in range(a, n)]
        words, exponent = rnd.choice([(24, 3), (4, 2), (6, 2), (9, 3), (1, 2), (10, 4)])
        assert periods.runs(s, words, exponent) == brute.periodic_runs(s, words, exponent)


def test_periodic_runs_of_texts(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 80)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "x y " * 20), (None, "x y " * 20), (103, "Eins zwei drei\x0bvier " * 12 + "Ende"), (104, "Word word " * 30)]
    rows += [(105, " ".join(str(i % 2011) for i in range(30000))), (106, "x " * 20000), (107, "a b c d e f g h " * 3 + "z " + "q " * 24)]
    got = periods.periodic_runs(texts(spark, rows), outputs=("runs", "n_runs", "start", "length", "period", "exponent_milli", "collapsed", "runs_sha256", "collapsed_sha256")).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        by.setdefault(str(r.doc_id), []).append(r)
    for key, text in rows:
        words = (text or "").encode().split()
        want = brute.periodic_runs(words, 24, 3) if len(words) < 5000 else {105: [(0, 30000, 2011)], 106: [(0, 20000, 1)]}[key]
        for r in by[str(key)]:
            assert [tuple(x) for x in r.runs] == want and r.n_runs == len(want)
            gone = {i for s, n, p in want for i in range(s + p, s + n)}
            assert r.collapsed.encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
            assert r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest()
            assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in want).encode()).hexdigest()
            if want:
                best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
                assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
            else:
                assert r.start is r.length is r.period is r.exponent_milli is None
    assert periods.periodic_runs(texts(spark, rows).limit(0)).count() == 0


def test_run_query_as_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["w%d" % x for x in range(40)]) for _ in range(rnd.choice([0, 1, 30, 200])))) for i in range(300)]
    texts(spark, [*rows, (None, "a b " * 30), (None, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).where("doc_id IS NOT NULL").collect()}
    changed = 0
    for key, text in rows:
        words = text.split()
        n, h = len(words), zlib.crc32(str(key).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        want = brute.periodic_runs(words, 24, 3)
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        r = got[key]
        assert r.n_runs == len(want) and r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert changed > 10 and sum(r.n_runs for r in got.values()) > 5


# Hard negatives

ODD = [(501, 1, None), (502, 1, [1.0, None, 0.0, 0.0]), (503, 1, [float("nan"), 0.0, 0.0, 0.0]), (504, 1, [float("-inf"), 0.0, 0.0, 0.0]), (None, 1, [2.0] * 4), (505, None, [9.0] * 4), (506, 1, [])]


def mined(df, **sizes):
    out = negatives.hard_negatives(df, F.col("id") % 50 == 0, **sizes).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out)


@pytest.mark.parametrize("sizes", [{"shard_rows": 37, "block_rows": 3}, {"shard_rows": 10_000, "block_rows": 2}, {}])
def test_hard_negatives_as_brute_force(spark, sizes):
    rnd = random.Random(6)
    rows = [(i, rnd.randrange(3), [float(rnd.randint(-9, 30)) for _ in range(4)]) for i in range(260)]
    rows += [(300 + i, 1, [5.0, 5.0, 5.0, 5.0]) for i in range(60)]  # ties
    rows += [(400 + i, 2, [2.0, 3.0, 1.0, 5.0]) for i in range(60)] + [(500, 2, [0.0] * 4), (550, 1, [1.0, 2.0]), (551, 1, [3.0, 3.0]), (552, 2, [1.0, 2.0])]
    rows += [(5, 0, [7.0, 7.0, 7.0, 7.0]), (100, 1, [1.0, 1.0, 1.0, 8.0])]  # repeated ids
    df = spark.createDataFrame([*rows, *ODD], "id long, label int, vector array<double>").selectExpr("*", "1 AS n", "2 AS block", "3 AS score", "4 AS cluster")
    want = sorted(brute.hard_negatives(rows, lambda i: i % 50 == 0, 5, 3, 50, 95))
    assert mined(df, **sizes) == want and len(want) > 30


def test_hard_negatives_of_one_hot_cluster_stop_early(spark):
    rng = np.random.default_rng(7)
    x = np.floor(256 * (rng.normal(size=(3000, 16)) * 0.2 + 1))
    x[::40] *= 50  # long vectors come first in the list
    rows = [(i, int(i % 4), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    assert mined(df, shard_rows=1000, block_rows=20) == sorted(brute.hard_negatives(rows, lambda i: i % 50 == 0, 5, 3, 50, 95))
    ids, labels = np.arange(3000), np.array([r[1] for r in rows])
    walk = negatives.Walk(x[:50:10], x, ids, labels)
    steps = sum(1 for _ in walk.steps(np.ones(5, bool)))
    seen = []
    original = negatives.Walk.steps
    try:
        negatives.Walk.steps = lambda self, active: (seen.append(1) or s for s in original(self, active))
        negatives.walk_same(walk, ids[:50:10], labels[:50:10], 5)
    finally:
        negatives.Walk.steps = original
    assert len(seen) < steps


def test_hard_negatives_of_large_numbers_and_nothing(spark):
    rows = [(0, 1, [3e9, 1.0]), (1, 1, [3e9, 2.0]), (2, 2, [2e9, 3.0]), (3, 2, [1e30, 0.0]), (4, 2, [2.8e9, 0.0])]
    df = spark.createDataFrame(rows, "id long, label long, vector array<double>")
    assert mined(df) == [(0, 1, 1, 4, 9 * 10**18 + 2, 84 * 10**17), (0, 1, 2, 2, 9 * 10**18 + 2, 6 * 10**18 + 3)]
    assert mined(df.limit(0)) == [] and mined(df.where("id > 0")) == [] and mined(df.where("label = 2 OR id = 0")) == []
