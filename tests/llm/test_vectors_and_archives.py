"""Searches against brute force, archives against round trips and damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest

from tabulon.llm import hnsw, topk, warc
from tabulon.llm.common import new_path
from tests.llm import brute

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).selectExpr("*", "1 AS id", "2 AS vector", "3 AS score", "4 AS shard")


ODD = [(501, None), (502, [1.0, None]), (503, [float("nan"), 0.0, 0.0, 0.0]), (504, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1, 0.1, 0.1, 0.1]), (505, []), (550, [0.5, 0.5])]


@pytest.mark.parametrize(("shard", "block"), [(7, 3), (1000, 1000)])
def test_exact_top_k(spark, shard, block):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-0.5, 0.25, 0.3, -0.01]) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(30)]  # ties
    df = vectors(spark, rows + ODD)
    ready = topk.whole(topk.vectors(df))
    got = topk.top_k(ready, ready.where("id % 50 = 0"), 5, shard_rows=shard, query_rows=block).collect()
    scaled = [(i, [float(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in [*rows, (550, [0.5, 0.5])]]
    want = brute.best_products(scaled, {0, 50, 100, 200, 550}, 5)
    found: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, float(r.score)))
    assert found == {q: v for q, v in want.items() if v}


def test_exact_top_k_of_large_numbers_and_nothing(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [3e9, 3.0]), (3, [1e30, 0.0])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "id long, vector array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, df.where("id = 0"), 3).orderBy("rank").collect()]
    assert got == [(3, 2**63 - 1), (2, 9 * 10**18 + 3), (1, 9 * 10**18 + 2)]
    assert topk.top_k(df.limit(0), df, 3).count() == 0 and topk.top_k(df, df.limit(0), 3).count() == 0


def test_graph_search_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)) * 0.5).astype(np.float32)
    x *= rng.uniform(0.3, 2.0, size=(900, 1)).astype(np.float32)  # unequal lengths, so inner product isn't the angle
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(200)]
    df = vectors(spark, [*rows, *ODD, (600, [0.0] * 16)])
    ready = hnsw.nonzero(topk.vectors(df))
    out = hnsw.search(hnsw.build_index(ready, 20, shard_rows=300), ready.where("id % 20 = 0"), 20, query_rows=13).collect()
    by: dict = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    given = {i: np.array(v, np.float64) for i, v in rows if i != 600}
    ids = np.array(sorted(given))
    m = np.stack([given[i] for i in ids])
    hits = total = 0
    for q, found in by.items():
        if q not in given:
            continue
        s = m @ given[q]
        order = [i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:20]
        assert len(found) == 20 and q not in {i for i, _ in found}
        assert all(abs(score - float(given[i] @ given[q])) < 1e-9 for i, score in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        hits += len(set(order) & {i for i, _ in found})
        total += 20
    assert total >= 45 * 20 and hits / total >= 0.9
    assert by[1000][:3] != [] and hnsw.search(hnsw.build_index(ready.limit(0)), ready.limit(0)).count() == 0


@pytest.mark.parametrize("length", [1e5, 1e200])
def test_graph_search_beside_a_very_long_vector(spark, length):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= length
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    out = hnsw.search(hnsw.build_index(df, 20), df.where("id % 20 = 0"), 20).collect()
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        best = [i for i in np.argsort(-s, kind="stable").tolist() if i != q][:20]
        hits += len(set(best) & {r.vec_id for r in out if r.query_id == q})
    assert len(out) == 30 * 20 and hits / (30 * 20) >= 0.95


@pytest.mark.parametrize("lengths", ["wide", "lognormal"])
def test_recall_of_one_shard_with_unequal_lengths(lengths):
    """10,000 vectors of lengths from 0.3 to 3 (or log-normal) in one graph shard, against brute force."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(50, 32))
    x = centres[rng.integers(0, 50, 10_000)] + rng.normal(size=(10_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= (rng.uniform(0.3, 3.0, size=10_000) if lengths == "wide" else np.exp(0.25 * rng.normal(size=10_000)))[:, None]
    parts = hnsw.bands(x)
    back = np.concatenate(parts)
    assert sorted(back.tolist()) == list(range(10_000)) and len(parts) > 4
    made = []
    for part in parts[:-1]:
        graph = hnsw.Graph.build(hnsw.raised(x[part]))
        made.append({"rows": len(part), "levels": graph.levels.astype("<i4").tobytes(), "links": graph.links.astype("<i4").tobytes(), "entry": graph.entry})
    made.append({"rows": len(parts[-1]), "levels": b"", "links": b"", "entry": -1})
    shard = hnsw.Shard({"vectors": x[back].astype("<f8").tobytes(), "dim": 32, "members": None, "bands": made}, hnsw.LINKS)
    hits = 0
    for q in range(0, 10_000, 50):
        scores = x @ x[q]
        best = [i for i in np.argsort(-scores, kind="stable").tolist() if i != q][:20]
        near, found = shard.nearest(x[q], 20, hnsw.SEARCH_WIDTH)
        assert np.allclose(found, scores[back[near]])
        hits += len(set(best) & set(back[near].tolist()))
    assert hits / (200 * 20) >= 0.95


def test_graph_is_flat_and_linked():
    rng = np.random.default_rng(3)
    graph = hnsw.Graph.build(hnsw.raised(rng.normal(size=(500, 8))))
    assert graph.links.dtype == np.int32 and len(graph.links) == graph.base[-1]
    seen, todo = {graph.entry}, [graph.entry]
    while todo:
        for n in graph.neighbours(todo.pop(), 0).tolist():
            if n not in seen:
                seen.add(n)
                todo.append(n)
    assert len(seen) >= 495


PAGES = "page_id long, url string, html string"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, least):
    rows = [(i, f"http://x/{i} a", ["same", "other page", None, "", "ünï", "z" * 300_000][i % 6]) for i in range(40)]
    rows += [(None, None, "same"), (None, None, "only without key"), (39, "http://x/39", rows[39][2]), (1000, "http://y", "WARC/1.1\r\n\x1f\x8b\x08 inside")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS original", "'s' AS sum", "2 AS record")
    folder = new_path(spark, "warc")
    warc.write(df, folder, least=least)
    out = warc.read(spark, folder).collect()
    assert all(r.kind == "record" for r in out) and len(out) == len(rows)
    last: dict = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= least:
            last[t or ""] = max(last.get(t or "", -1), i)
    want = []
    for i, _, t in rows:
        t = t or ""
        original = last.get(t)
        response = original is None or original == i
        want.append((i or -1, len(t.encode()), b32(t), "response" if response else "revisit", -1 if response else original))
    got = [(r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in out]
    assert sorted(got) == sorted(want)
    assert all((r.payload is not None) == (r.record_type == "response") for r in out)
    empty = new_path(spark, "warc")
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_files_are_plain_gzip(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], PAGES).coalesce(1), folder)
    parts = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*")]
    assert b"".join(parts).count(b"WARC/1.1\r\n") == 2


def archive(packed, n=6):
    records = [warc.record(i, f"http://x/{i}", f"page {i} ".encode() * 50, None, True) for i in range(n)]
    return [gzip.compress(r) if packed else r for r in records]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_later_records(packed):
    parts = archive(packed)
    whole = b"".join(parts)
    assert [r["page_id"] for r in warc.salvage(whole)] == [0, 1, 2, 3, 4, 5]
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    flipped = bytearray(whole)
    at = starts[2] + len(parts[2]) // 2
    flipped[at] ^= 0xFF
    out = list(warc.salvage(bytes(flipped)))
    assert [r["page_id"] for r in out if r["kind"] == "record"] == [0, 1, 3, 4, 5]
    gap = [r for r in out if r["kind"] == "gap"]
    assert [(g["offset"], g["length"]) for g in gap] == [(starts[2], len(parts[2]))] and gap[0]["reason"]
    junk = b"junk \x1f\x8b\x08 WARC/1. more" + whole[: starts[1]] + b"\x1f\x8b\x08 trash" + whole[starts[1] : starts[4] + 20]
    out = list(warc.salvage(junk))
    assert [r["page_id"] for r in out if r["kind"] == "record"] == [0, 1, 2, 3]
    covered = sorted((r["offset"], r["length"]) for r in out)
    assert covered[0][0] == 0 and sum(n for _, n in covered) == len(junk)
    assert all(a + n == b for (a, n), (b, _) in zip(covered, covered[1:]))


def test_salvage_inside_a_member_of_several_records():
    """One damaged record of a member leaves a gap; the records before and behind it come out."""
    records = [warc.record(i, f"http://x/{i}", f"page {i} ".encode() * 50, None, True) for i in range(5)]
    broken = bytearray(b"".join(records))
    starts = np.cumsum([0, *map(len, records)]).tolist()
    broken[starts[2] + len(records[2]) // 2] ^= 0xFF
    packed, after = gzip.compress(bytes(broken)), gzip.compress(records[0])
    out = list(warc.salvage(packed + after))
    assert [r["page_id"] for r in out if r["kind"] == "record"] == [0, 1, 3, 4, 0]
    assert all((r["offset"], r["length"]) == (0, len(packed)) for r in out[:5])
    assert [(r["inner_offset"], r["inner_length"]) for r in out[:5]] == [(a, len(r)) for a, r in zip(starts, records)]
    gap = [r for r in out if r["kind"] == "gap"]
    assert len(gap) == 1 and gap[0]["inner_offset"] == starts[2] and gap[0]["reason"] == "block digest differs"
    assert "inner_offset" not in out[5] and out[5]["offset"] == len(packed)
    # a member of which nothing passes is a gap of its own
    out = list(warc.salvage(gzip.compress(b"WARC/1.1\r\nno record") + after))
    assert [r["kind"] for r in out] == ["gap", "record"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_a_very_long_header(packed):
    one = warc.record(1, "http://x", b"payload", None, True).replace(b"WARC-Date", b"X-Long: " + b"y" * 300_000 + b"\r\nWARC-Date")
    out = list(warc.salvage((gzip.compress(one) if packed else one) * 2))
    assert [(r["kind"], r["page_id"], r["payload"]) for r in out] == [("record", 1, b"payload")] * 2


def test_salvage_of_random_damage():
    rnd = random.Random(8)
    whole = b"".join(archive(True, 20) + archive(False, 20))
    for _ in range(60):
        bad = bytearray(whole)
        for _ in range(rnd.randint(1, 4)):
            i = rnd.randrange(len(bad))
            bad[i : i + rnd.randint(0, 40)] = bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 60)))
        out = list(warc.salvage(bytes(bad)))
        assert sum(r["length"] for r in out) == len(bad)
        assert sum(r["kind"] == "record" for r in out) >= 30
        # a damaged head may name another page, as nothing checks heads of plain records; a payload is never a wrong one
        assert {r["payload"] for r in out if r["kind"] == "record"} - {None} <= {f"page {i} ".encode() * 50 for i in range(20)}
    assert list(warc.salvage(b"")) == []
