import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

import corpus_pipeline
from groundcheck.llm import fingerprints, packing, queries

SF = "/root/testdata/sf0.001"
LEFT_ALONE = "event_id long, notes string, length int, t string, k int"


def events(spark, rows):
    return spark.createDataFrame([(i, t, 1, "b", 2) for i, t in rows], LEFT_ALONE)


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "tokenizer"):
        ids_of.tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return [*ids_of.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, got, length):
    pieces = {}
    for r in got:
        pieces.setdefault(r["event_id"], []).append(r)
    for key, text in rows:
        ids = np.array(ids_of(text), "<u4")
        at = 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= length
    return len(sequences) * length / sum(r["length"] for r in got) - 1


def test_packing_round_trip_on_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Ünï Été ÉTÉ naïve é İstanbul ΣΑΣ"), (5, "it's DON'T a.b,c ..., x." * 40),
            (6, "<|endoftext|> a<|startoftext|>b"), (7, "word " * 300), (8, "日本語 テスト 🙂🙂 ٣٤"), (9, "a b c\x1cd"),
            (10, "x1y2 #%&*** 12,345.67 | pipe |"), (11, "supercalifragilistic" * 30)]
    got = packing.pack_notes(events(spark, rows), queries.tokenizer_path(), length=64).collect()
    check_packing(rows, got, 64)
    assert packing.pack_notes(events(spark, []), queries.tokenizer_path()).collect() == []
    twice = packing.pack_notes(events(spark, [(1, "a b"), (1, "a b"), (None, "c")]), queries.tokenizer_path()).collect()
    assert len(twice) == 3 and len({r["sequence_id"] for r in twice}) == 1
    with pytest.raises(ValueError):
        packing.pack_notes(events(spark, []), queries.tokenizer_path(), length=100)


def test_packing_query_is_exact_and_dense(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = queries.op8_packing(spark, "/root/testdata/sf0.01").withColumnRenamed("doc_id", "event_id").collect()
    assert check_packing(rows, got, 2048) < 0.02


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_patterns_cover_the_demand_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    demand = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 65), 30, replace=False), rng.integers(1, 400, 30))}
    used = packing.cutting_patterns(demand, 64)
    made = {}
    for pattern, times in used:
        assert sum(s * n for s, n in pattern.items()) <= 64 and times > 0
        for s, n in pattern.items():
            made[s] = made.get(s, 0) + n * times
    bins, least = sum(t for _, t in used), -(-sum(s * n for s, n in demand.items()) // 64)
    assert made == demand and bins <= max(least * 1.05, least + 3) + sum(n for s, n in demand.items() if s > 58)
    assert packing.cutting_patterns({}, 8) == [] and packing.cutting_patterns({8: 3}, 8) == [({8: 1}, 3)]


def edited(rows):
    keys = sorted({k for k, _ in rows if k is not None})
    text = dict(rows)
    out = {}
    for k in keys:
        t, after = text[k] or "", text[keys[(keys.index(k) + 1) % len(keys)]] or ""
        q = len(t) // 4
        out[k] = t[:len(t) - q] + after[:q]
    return out


def test_edits_take_the_next_note(spark):
    rows = [(5, "abcdefgh"), (9, None), (2, "éüñß 🙂🙂xyz12345"), (7, ""), (30, "xy"), (11, "the last words of the list " * 9)]
    got = {r["event_id"]: r for r in fingerprints.fingerprint_notes(events(spark, rows)).collect()}
    assert {k: r["edited_text"] for k, r in got.items()} == edited(rows)
    assert {k: r["n_chars"] for k, r in got.items()} == {k: len(t or "") for k, t in rows}
    assert got[9]["fingerprint"] == [] == got[7]["fingerprint"] and got[7]["near_edited"] == 1.0


def test_fingerprints_of_repeated_keyless_single_and_no_rows(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (None, "a b c d e f g h")]
    got = fingerprints.fingerprint_notes(events(spark, rows)).collect()
    assert len(got) == 4 and len({tuple(r["fingerprint"]) for r in got}) == 1
    assert sorted((r["event_id"], r["near_next"]) for r in got if r["event_id"]) == [(1, 1.0), (1, 1.0), (2, 1.0)]
    assert [r["near_next"] for r in got if r["event_id"] is None] == [None]
    one = fingerprints.fingerprint_notes(events(spark, [(1, "abcdefgh")])).collect()[0]
    assert one["edited_text"] == "abcdefab" and one["near_next"] == 1.0
    assert fingerprints.fingerprint_notes(events(spark, [])).collect() == []


def test_sketches_estimate_resemblance_containment_and_counts(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(4000)]
    pairs = [(" ".join(words[:3000]), " ".join(words[1000:])), (" ".join(words[:1500]), " ".join(words[:3000])),
             (" ".join(words[:40]), " ".join(words[:40]))]
    frame = spark.createDataFrame(pairs, "a string, b string").select(
        fingerprints.sketch(F.col("a"), 512).alias("a"), fingerprints.sketch(F.col("b"), 512).alias("b"))
    got = frame.select(fingerprints.resemblance(F.col("a"), F.col("b"), 512).alias("j"),
                       fingerprints.containment(F.col("a"), F.col("b"), 512).alias("c"),
                       fingerprints.distinct_shingles(F.col("a"), 512).alias("n")).collect()
    for r, (j, c, n) in zip(got, [(0.5, 2 / 3, 2996), (0.5, 1, 1496), (1, 1, 36)]):
        assert abs(r["j"] - j) < 0.09 and abs(r["c"] - c) < 0.13 and abs(r["n"] / n - 1) < 0.15


def test_fingerprint_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect()]
    want = {k: hashlib.sha256(t.encode()).hexdigest() for k, t in edited(rows).items()}
    got = queries.op9_fingerprints(spark, SF).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == want
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_pipeline_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    seen = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            ids = {r[0] for r in after.select("doc_id").collect()}
            assert ids <= {r[0] for r in docs.select("doc_id").collect()}
            seen.append(len(ids))
            docs = after
    texts = [r["text"] for r in spark.read.parquet(f"{tmp_path}/1").collect()]
    assert len(set(texts)) == len(texts) and seen[0] > seen[1] > seen[2] == seen[3] > seen[4] > 0
    packed = spark.read.parquet(f"{tmp_path}/4").collect()
    # every copy is there whole: its pieces are those of one row of its document
    left = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    texts = {k: t for k, t in left}
    assert Counter(k for k, _ in {(r["doc_id"], r["copy"]) for r in packed}) == Counter(
        {k: n for (k, _), n in left.items()}) and max(left.values()) > 1
    rows = [Row(**{**r.asDict(), "event_id": (r["doc_id"], r["copy"])}) for r in packed]
    check_packing([((k, c), texts[k]) for k, c in {r["event_id"] for r in rows}], rows, 2048)
