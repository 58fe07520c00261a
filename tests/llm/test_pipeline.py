"""The pipeline's stages on small tables."""

from __future__ import annotations

import corpus_pipeline
from tabulon.llm import queries
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == names
        assert 0 < after.count() <= 2 * before.count()
        if name == "near_copies":
            kept = {r.doc_id for r in after.collect()}
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {k for (k, _), (_, c) in zip(rows, brute.components(rows, 5, 80, 100), strict=True) if k == c}
            assert kept == want
        before = after
    assert before.count() == corpus_pipeline.run(spark, FOLDER).count()


def test_stages_take_odd_tables(spark):
    rows = [(1, None, "en", None, None), (1, None, "en", None, None), (None, "a b c d e f", None, "s", 3), (2, "a b c d e f", None, "s", 3), (2, "a b c d e f", None, "s", 3), (3, "", "de", "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS copy", "2 AS copies", "3 AS place", "4 AS kept", "5 AS content")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), FOLDER).count() == 0
        out = stage(spark, df, FOLDER).collect()
        if name == "near_copies":
            assert sorted((r.doc_id or -1) for r in out) == [1, 1, 2, 3]
        if name == "secret_masking":
            assert len(out) == len(rows)


def test_near_copies_of_one_id_are_judged_by_text(spark):
    """Unlike texts under one id both stay, near copies under null ids leave one, the choice is the same in each order."""
    first, second = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, first, 9), (1, second, 8), (2, first + " tail", 7), (None, second + " end", 6), (None, "x " + " ".join(f"c{i}" for i in range(60)), 5)]
    rows += [(None, " ".join(f"c{i}" for i in range(60)) + " y", 4)] * 3 + [(3, "", 1), (3, None, 1)]
    kept = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, n_chars long").repartition(3)
        kept.append(sorted((r.doc_id or -1, r.text or "", r.n_chars) for r in corpus_pipeline.drop_near_copies(spark, df, FOLDER).collect()))
    assert kept[0] == kept[1]
    assert {(i, t) for i, t, _ in kept[0]} >= {(1, first), (1, second), (3, "")} and len(kept[0]) == 5
    assert sum(i == -1 for i, *_ in kept[0]) == 1


def test_mix_carries_what_rounding_leaves(spark):
    """A source that gives two thirds of its words keeps long documents, too, and each comes near its target."""
    rows = [(i, "w " * (3000 if i % 11 == 0 else 40), ["src0", "src1", "src2"][i % 8 // 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from tabulon.llm import mixing

    _, accounts = mixing.mix(df)
    goal = {r.source: r.target for r in accounts.collect()}
    words: dict = {}
    long_kept = 0
    for r in corpus_pipeline.mix_sources(spark, df, FOLDER).collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
        long_kept += r.source == "src1" and len(r.text) > 3000
    given = sum(len(t.split()) for _, t, s in rows if s == "src1")
    assert goal["src1"] < 0.8 * given and 15 <= long_kept <= 29
    assert all(abs(words[s] - goal[s]) <= 6000 for s in goal)


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 14)}
