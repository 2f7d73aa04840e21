import zlib

import numpy as np
import pytest

from groundcheck.llm import sharding, topk

VECTORS = "item_id long, vector array<float>, score string, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)


def brute_top(queries, rows, k, scale):
    def clean(part):
        return [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in part
                if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]

    out = []
    for qi, q in clean(queries):
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in clean(rows) if i != qi)
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_matches_equals_brute_force_over_many_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (None, [1.0]),
             (304, []), (305, [2.0]), (306, [1e30, 1.0])]
    queries = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    got = topk.top_matches(vectors(spark, queries), vectors(spark, rows[:-1]), k=5, query_block=7, shard_rows=20, fan_in=2)
    assert sorted(map(tuple, got.collect())) == brute_top(queries, rows[:-1], 5, 64)


def test_top_matches_of_few_none_and_repeated_rows(spark):
    few = [(1, [1.0]), (2, [2.0])]
    got = topk.top_matches(vectors(spark, few), vectors(spark, few), k=20)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 64 * 128), (2, 1, 1, 64 * 128)]
    assert topk.top_matches(vectors(spark, []), vectors(spark, few)).collect() == []
    assert topk.top_matches(vectors(spark, few), vectors(spark, [])).collect() == []
    twice = topk.top_matches(vectors(spark, [(1, [1.0])]), vectors(spark, [(2, [1.0]), (2, [1.0]), (1, [9.0])]))
    assert sorted(map(tuple, twice.collect())) == [(1, 1, 2, 4096), (1, 2, 2, 4096)]


def test_large_components_are_exact():
    q, c = np.array([[2**40, 3]]), np.array([[2**21, 5], [2**40, 1]])
    assert topk._products(q, c).tolist() == [[2**61 + 15, 2**63 - 1]]


def events(spark, rows):
    return spark.createDataFrame([(i, t, 7, "c") for i, t in rows], "event_id long, notes string, size int, arc string")


def test_shards_are_even_gapless_and_keep_copies_together(spark):
    rows = [(i, f"note {i % 60}" if i % 3 else "the same note") for i in range(500)] + [(600, None), (601, ""), (602, "é" * 9000)]
    got = sharding.shard_notes(events(spark, rows), shards=16).collect()
    assert sorted(r["event_id"] for r in got) == sorted(i for i, _ in rows)
    per = {}
    for r in got:
        per.setdefault(r["shard"], []).append(r["slot"])
        text = dict(rows)[r["event_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "rows")
    assert len(per) == 16 and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())


def test_shards_of_repeated_null_and_no_rows(spark):
    got = sharding.shard_notes(events(spark, [(None, None)] * 3 + [(1, "a")] * 5), shards=4).collect()
    assert sorted(r["shard"] for r in got) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert sharding.shard_notes(events(spark, []), shards=4).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_notes(events(spark, []), shards=0)


def test_ring_overflow_walks_clockwise_and_a_new_shard_leaves_points_alone():
    assert sharding.fill_ring({0: 5, 1: 1}, [0, 1, 2], [2, 2, 2]) == [
        (0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (0, 2, 3, 1, 1), (0, 3, 5, 2, 0)]
    with pytest.raises(ValueError):
        sharding.fill_ring({0: 5}, [0], [4])
    assert set(sharding.ring_points(4, 8)) < set(sharding.ring_points(5, 8))
