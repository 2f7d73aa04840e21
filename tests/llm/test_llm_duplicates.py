import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from groundcheck.llm import common, ngram_join, passages, queries, repeats

COLUMNS = "event_id long, notes string, k string, id int, n string"


def events(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], COLUMNS)


def grams(text, width):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute_components(rows, width, percent):
    sets = [grams(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((key, len(sets[i]), (min(keys) if keys else None) if sets[i] else key))
    return sorted(out, key=str)


def varied(seed, count, base):
    rng = random.Random(seed)
    for i in range(count):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 40)}"
        yield " ".join(words)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_links_equal_brute_force(spark, width, percent):
    base = [f"word{i}" for i in range(70)]
    rows = list(enumerate(varied(3, 60, base), 10))
    rows += [(100 + i, "A b C" if i % 2 else "a B c") for i in range(4)] + [(1, None), (2, ""), (3, " \n\t"), (4, "one"),
             (5, "ONE"), (6, "a b"), (None, "one"), (7, "a b c d e"), (7, "a b c d e"), (8, "a b"), (9, "É é")]
    rows += [(200 + i, " ".join(base[:35] + [f"x{i}_{j}" for j in range(35)])) for i in range(20)]  # a shared passage
    got = ngram_join.link_notes(events(spark, rows), width=width, percent=percent).collect()
    assert sorted(((r["event_id"], r["n_shingles"], r["component"]) for r in got), key=str) == brute_components(rows, width, percent)


def test_links_when_every_list_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SAMPLE", 1)
    monkeypatch.setattr(ngram_join, "PART", 2)
    rows = list(enumerate(varied(5, 40, [f"word{i}" for i in range(60)])))
    got = ngram_join.link_notes(events(spark, rows), width=3, percent=90).collect()
    assert sorted(((r["event_id"], r["n_shingles"], r["component"]) for r in got), key=str) == brute_components(rows, 3, 90)
    assert ngram_join.link_notes(events(spark, [])).collect() == []


def test_long_open_lists_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 2)
    monkeypatch.setattr(ngram_join, "SEARCHED", 5)
    monkeypatch.setattr(ngram_join, "VERIFIED", 300)
    for centres in (0, 2):
        monkeypatch.setattr(ngram_join, "CENTRES", centres)
        rows = list(enumerate(varied(11 + centres, 50, [f"word{i}" for i in range(40)])))
        got = ngram_join.link_notes(events(spark, rows), width=3, percent=70).collect()
        assert sorted(((r["event_id"], r["n_shingles"], r["component"]) for r in got), key=str) == brute_components(rows, 3, 70)


def test_t_occurrence_counts_all_that_reach_the_overlap():
    rng = np.random.default_rng(5)
    for _ in range(50):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 20))) for _ in range(25)]
        lists = {g: np.array([i for i, s in enumerate(sets) if g in s]) for g in {int(v) for s in sets for v in s}}
        query = np.unique(rng.integers(0, 40, 12))
        for least in (1, 2, 5, 9, 30):
            want = np.array([len(np.intersect1d(query, s)) for s in sets])
            got = ngram_join.t_occurrence(query, least, lists, len(sets))
            assert (got[want >= least] == want[want >= least]).all() and (got <= want).all()


def test_join_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(queries.OP3_SQL).fetchall())
    got = queries.op3_ngram_join(spark, "/root/testdata/sf0.001").select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_in_small_chunks(spark, monkeypatch, kind):
    """Chunks of a few edges leave the joining to the rounds; the result is that of a search."""
    monkeypatch.setattr(common, "CHUNK_EDGES", 3)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 25)] + [
        (rng.randrange(200, 280), rng.randrange(200, 280)) for _ in range(70)] + [(30, 100), (7, 7)]
    links = [tuple(f"{x:03d}" if kind == "string" else x for x in link) for link in links]
    rng.shuffle(links)
    root = {x: x for link in links for x in link if link[0] != link[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = common.components(spark.createDataFrame(links, f"src {kind}, dst {kind}").repartition(7)).collect()
    assert len(got) == len(root) and {r["node"]: r["component"] for r in got} == root


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = common.components(spark.createDataFrame(links, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 130)}}
    assert len(got) == 51


def brute_repeats(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    out = []
    for (key, _), b in zip(rows, raw):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans, start = [], None
        for i, g in enumerate([*gone, False]):
            if g and start is None:
                start = i
            elif not g and start is not None:
                spans.append((start, i))
                start = None
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((key, len(b), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,seed", [(20, 1), (24, 2), (200, 3)])
def test_repeated_spans_equal_brute_force(spark, length, seed):
    rng = random.Random(seed)
    word = ["alpha", "be", "gamma", "dé", "ñandu", "x"]
    shared = [" ".join(rng.choice(word) for _ in range(rng.randint(length // 8, length // 2))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(f"{rng.choice(word)}{rng.randint(0, 999)}" for _ in range(rng.randint(0, 12))))
            text = rng.choice(shared)
            parts.append(text[rng.randint(0, 5):] if rng.random() < 0.5 else text)
        rows.append((i, " ".join(parts)))
    rows += [(50, None), (51, ""), (52, "y" * (length - 1)), (53, "z" * length), (54, "q" * (length + 1)), (55, "ab" * length),
             (56, rows[3][1]), (None, rows[4][1]), (57, "same"), (57, "same"), (58, "\0" * (length + 3))]
    got = repeats.repeated_spans(events(spark, rows), length=length).collect()
    assert sorted(((r["event_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], r["kept_sha256"])
                   for r in got), key=str) == brute_repeats(rows, length)


def test_repeated_spans_of_no_rows_and_sorting():
    rng = random.Random(4)
    keys = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    assert [keys[i] for i in repeats.multikey_sort(keys)] == sorted(keys)
    with pytest.raises(ValueError):
        repeats.repeated_spans(None, length=7)


def test_repeated_spans_of_an_empty_table(spark):
    assert repeats.repeated_spans(events(spark, [])).collect() == []


def unique(rng, n):
    return [f"u{rng.randrange(10**9)}" for _ in range(n)]


def test_passages_go_but_for_the_first_and_clean_notes_stay(spark):
    rng = random.Random(8)
    passage, line = unique(rng, 60), unique(rng, 60)
    near = line[:20] + ["changed"] + line[21:]
    rows = [(1, " ".join(unique(rng, 30) + passage + unique(rng, 30))),
            (2, " ".join(unique(rng, 10) + passage + unique(rng, 25))),
            (3, " ".join(unique(rng, 12)) + "\n" + " ".join(line)),
            (4, " ".join(near) + "\n" + " ".join(unique(rng, 12))),
            (5, " ".join(unique(rng, 80))), (6, "All rights reserved."), (7, "All rights reserved."),
            (8, None), (9, ""), (None, " ".join(unique(rng, 30)))]
    got = {r["event_id"]: r for r in passages.drop_repeated_passages(events(spark, rows)).collect()}
    text = dict(rows)
    for i in (1, 3, 5, 6, 7, 8, 9, None):
        assert got[i]["notes"] == text[i] and got[i]["words_removed"] == 0
    assert got[2]["words_removed"] >= 40 and set(text[2].split()) - set(got[2]["notes"].split()) <= set(passage)
    assert got[4]["words_removed"] >= 40
    assert got[4]["notes"].split() == text[4].split("\n")[1].split()
    assert passages.drop_repeated_passages(events(spark, [])).collect() == []


def test_near_equal_paragraphs_equal_brute_force(spark):
    base = [f"p{i}" for i in range(60)]
    rows = list(enumerate(varied(9, 30, base)))
    got = {r["event_id"]: r["words_removed"] for r in passages.drop_repeated_passages(events(spark, rows)).collect()}
    first = {i: c for i, _, c in brute_components(rows, 5, 80)}
    lost = [i for i, c in first.items() if i != c and got[i] < 60]
    assert all(got[i] == 60 for i, c in first.items() if i != c) or len(lost) <= 1  # tuned to a recall of 0.99
    assert all(got[i] < 60 for i, c in first.items() if i == c)


def test_bands_are_tuned():
    assert 1 - (1 - 0.8**3) ** passages.bands_for(0.8, 3, 0.99) >= 0.99


def test_passages_go_up_to_their_ends_and_periodic_ones_too(spark):
    rng = random.Random(12)
    rows, plain = [], unique(rng, 51)
    for period in (1, 2, 3, 4):
        words = unique(rng, period)
        whole, turned = [words[i % period] for i in range(60)], [words[(i + 1) % period] for i in range(57)]
        rows += [(period, " ".join(unique(rng, 20) + whole + unique(rng, 20))),
                 (10 + period, " ".join(unique(rng, 30) + turned + unique(rng, 9)))]
    rows += [(3000, " ".join(unique(rng, 25) + plain + unique(rng, 25))), (4000, " ".join(unique(rng, 11) + plain + unique(rng, 30)))]
    got = {r["event_id"]: r for r in passages.drop_repeated_passages(events(spark, rows)).collect()}
    text = {i: t.split() for i, t in rows}
    left = {i: r["notes"].split() for i, r in got.items()}
    for period in (1, 2, 3, 4):
        assert left[period][:20] + left[period][-20:] == text[period][:20] + text[period][-20:]
        assert set(left[period]) == set(text[period])
        # less than one turn may stay before the first chunk
        want = text[10 + period]
        assert left[10 + period][:30] + left[10 + period][-9:] == want[:30] + want[87:]
        assert len(left[10 + period]) < 39 + period
    assert got[3000]["words_removed"] == 0
    assert left[4000] == text[4000][:11] + text[4000][62:]


def test_a_passage_of_a_paragraph_that_goes_stays_elsewhere(spark):
    rng = random.Random(21)
    line, passage, around = unique(rng, 300), unique(rng, 45), unique(rng, 40)
    rows = [(1, " ".join(line)), (2, " ".join(line[:150] + passage + line[150:])), (3, " ".join(around + passage + unique(rng, 40))),
            (4, " ".join(unique(rng, 30) + passage + unique(rng, 30)))]
    got = {r["event_id"]: r for r in passages.drop_repeated_passages(events(spark, rows)).collect()}
    assert [got[i]["words_removed"] for i in (1, 2, 3, 4)] == [0, 345, 0, 45]


def test_link_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = list(enumerate(varied(15, 50, [f"word{i}" for i in range(90)])))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, "one"), (63, "ONE"), (64, None), (65, "alone here")]
    sets = [grams(t, 3) for _, t in rows]
    want = {i: sum(bool(a and b) and 100 * len(a & b) >= 80 * len(a | b) for y, b in enumerate(sets) if y != x)
            for x, ((i, _), a) in enumerate(zip(rows, sets))}
    got = ngram_join.link_notes(events(spark, rows), width=3, percent=80, count_links=True).collect()
    assert {r["event_id"]: r["links"] for r in got} == want


def test_bitmaps_never_claim_more_differences_than_there_are(spark):
    import numpy as np
    import pyarrow as pa

    from groundcheck.llm.bitmaps import bitmap, least_differences, plausible

    rng = np.random.default_rng(3)
    sets = [np.zeros(0, np.uint64), np.array([7], np.uint64)]
    for n in (5, 63, 64, 65, 120, 130, 700, 5000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        sets += [base, base[:n - n // 10], np.concatenate([base, rng.integers(0, 2**63, n // 8, dtype=np.uint64)])]
    sets = [np.unique(s) for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j]
    maps = [bitmap(s) for s in sets]
    least = least_differences(pa.array([maps[i] for i, _ in pairs], pa.binary()), pa.array([maps[j] for _, j in pairs], pa.binary()))
    real = [len(np.setxor1d(sets[i], sets[j])) for i, j in pairs]
    assert all(l <= r for l, r in zip(least.tolist(), real))
    alike = [(l, r) for (i, j), l, r in zip(pairs, least.tolist(), real) if 0.8 <= len(sets[i]) / max(1, len(sets[j])) <= 1.25]
    assert sum(l for l, _ in alike) > 0.2 * sum(r for _, r in alike)
    part = least_differences(pa.array([maps[0], maps[3], maps[4]], pa.binary())[1:], pa.array([maps[1], maps[4], maps[3]], pa.binary())[1:])
    assert part[0] == part[1] <= len(np.setxor1d(sets[3], sets[4]))

    for percent in (80, 90):
        asked = spark.createDataFrame([*pairs, *pairs[:9]], "a long, b long")
        sketches = spark.createDataFrame([(i, len(s), m) for i, (s, m) in enumerate(zip(sets, maps))], "id long, n int, bits binary")
        got = [(r["a"], r["b"]) for r in plausible(asked, sketches, percent).collect()]
        shared = {p: len(np.intersect1d(sets[p[0]], sets[p[1]])) for p in pairs}
        true = {(i, j) for i, j in pairs if shared[i, j]
                and 100 * shared[i, j] >= percent * (len(sets[i]) + len(sets[j]) - shared[i, j])}
        assert true and true <= set(got) and len(got) == len(set(got)) < len(pairs) / 2
        assert plausible(asked.limit(0), sketches, percent).count() == 0


def test_paragraphs_of_large_buckets_equal_brute_force(spark, monkeypatch):
    from groundcheck.llm import passages

    monkeypatch.setattr(passages, "SHORT", 1)
    test_near_equal_paragraphs_equal_brute_force(spark)


def test_units_are_cut_from_a_batch_as_from_single_texts():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "Bc", "é", "日本", " ", "\n", "\t ", "\x1f"]) for _ in range(rng.randint(1, 60))) + "z" for _ in range(80)]
    lists, expected = [], []
    for t in texts:
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t.encode())]
        units, gone = [], set()
        held = [0] * (len(spans) + 1)
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(spans))
            b = rng.randint(a + 1, len(spans))
            units.append({"kind": rng.choice([passages.PARAGRAPH, passages.PIECE]), "first": a, "size": b - a})
            if units[-1]["kind"] == passages.PARAGRAPH:
                gone.update(range(a, b))
            else:
                held[a:b] = [1] * (b - a)
        at = 0
        while at < len(spans):
            to = at
            while held[to]:
                to += 1
            gone.update(range(at, to) if to - at >= 3 else ())
            at = to + 1
        raw = t.encode()
        expected.append((raw[:spans[0][0]] + b"".join(raw[a:b] for i, (a, b) in enumerate(spans) if i not in gone)).decode())
        lists.append((units, len(gone)))
    units = pa.array([u for u, _ in lists], pa.list_(pa.struct([("kind", pa.int32()), ("first", pa.int32()), ("size", pa.int32())])))
    got, removed = passages._without(pa.array(["x", *texts])[1:], units, 3)
    assert got.to_pylist() == expected and removed.tolist() == [n for _, n in lists]


def test_words_beside_repeated_pieces_are_read_a_batch_at_a_time(monkeypatch):
    calls, ends = [], passages.piece_ends
    monkeypatch.setattr(passages, "piece_ends", lambda *a: calls.append(1) or ends(*a))
    texts = [f"w{n} " + " ".join(f"x{i}" for i in range(20)) + "\nlast line" for n in range(3)]
    place = pa.struct([("z", pa.bool_()), ("k", pa.int64()), ("u", pa.int64()), ("first", pa.int32())])
    unit = pa.struct([("first", pa.int32()), ("size", pa.int32()), ("best", place)])
    units = [[{"first": 5, "size": 4, "best": {"z": False, "k": 9, "u": 90, "first": 30}}] for _ in texts]
    units[1][0]["first"] = 0  # a line's first words have nothing before them
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([10, 20, 30]), pa.array(texts), pa.array(units, pa.list_(unit))],
                                       names=["k", "u", "t", "units"])
    found = pa.Table.from_batches(passages._asked([batch])).to_pylist()
    assert len(calls) == 1
    assert sorted((r["k"], r["u"], r["side"], r["at"], r["bk"], r["bu"], r["bat"]) for r in found) == [
        (1, 10, 0, 5, 9, 90, 30), (1, 10, 1, 9, 9, 90, 34), (2, 20, 1, 4, 9, 90, 34),
        (3, 30, 0, 5, 9, 90, 30), (3, 30, 1, 9, 9, 90, 34)]
    words = ngram_join.word_hashes(texts[2]).view(np.int64).tolist()
    told = {r["side"]: r["words"] for r in found if r["k"] == 3}
    assert told[0] == words[4::-1] and told[1] == words[9:9 + len(told[1])] and told[1]
    asks = [[{"side": r["side"], "bat": r["at"], "n": len(r["words"])} for r in found if r["k"] == k] for k in (1, 2, 3)]
    back = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([10, 20, 30]), pa.array(texts), pa.array(asks)],
                                      names=["k", "u", "t", "asks"])
    again = pa.Table.from_batches(passages._told([back])).to_pylist()
    assert [(r["tk"], r["side"], r["bat"], r["told"]) for r in again] == [
        (r["k"], r["side"], r["at"], r["words"]) for r in sorted(found, key=lambda r: r["k"])]


def test_texts_go_to_python_in_small_batches(spark):
    """The stages of the pipeline hand texts over in batches of some hundred rows and a few megabytes."""
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k) for k in keys]
    docs = spark.createDataFrame([(i, f"some words of text {i % 5} more", "en", "s", 9) for i in range(2000)],
                                 "doc_id long, text string, lang string, source string, n_chars int").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    try:
        assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 5
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= common.BATCH_ROWS
        spark.conf.set(keys[0], "100")
        with common.small_batches(spark):
            assert spark.conf.get(keys[0]) == "100"
        assert spark.conf.get(keys[0]) == "100"
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


@pytest.mark.parametrize("counts", [1 << 16, 4])
def test_the_driver_gets_few_more_than_the_most_common(spark, monkeypatch, counts):
    monkeypatch.setattr(ngram_join, "COUNTS", counts)
    # a few common ones, and thousands that are equally rare, in each of many tasks
    rows = spark.range(40_000, numPartitions=16).selectExpr(
        "xxhash64(id) as h", "case when id % 4000 = 7 then id % 5 + 3 when id % 8 = 0 then 2 else 1 end as c")
    want = [tuple(r) for r in rows.orderBy(ngram_join.F.desc("c"), "h").limit(200).collect()]
    near = ngram_join.nearly_top(rows, 200).cache()
    assert [tuple(r) for r in near.orderBy(ngram_join.F.desc("c"), "h").limit(200).collect()] == want
    assert near.count() <= 220
    assert ngram_join.nearly_top(rows, 50_000).count() == 40_000
    assert ngram_join.nearly_top(rows, 5).filter("c < 3").count() == 0
    assert ngram_join.nearly_top(rows.limit(0), 5).count() == 0


def test_the_most_common_words_are_found_as_by_a_sort(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 30)
    monkeypatch.setattr(ngram_join, "SAMPLE", 1)
    texts = [" ".join(f"w{(i * j) % 60}" for j in range(1, 50)) for i in range(1, 80)]
    seen = {}
    for t in set(texts):
        for h in np.unique(ngram_join.word_hashes(t)).view(np.int64).tolist():
            seen[h] = seen.get(h, 0) + 1
    want = sorted(((-c, h) for h, c in seen.items() if c >= 2))[:30]
    got = ngram_join._sampled(events(spark, list(enumerate(texts))).selectExpr("notes as t"), 3).words
    assert sorted(zip((-got["counts"]).tolist(), got["keys"].view(np.int64).tolist())) == want
