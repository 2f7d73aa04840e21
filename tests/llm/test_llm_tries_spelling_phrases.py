import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from groundcheck.llm import phrase_index, prefix_trie, spelling, words
from groundcheck.plans import review

EVENTS = "event_id long, ts timestamp, feature_id string, action string, new_status string, reviewer string, notes string, words int, no int, key string"


def review_log(spark, notes):
    """Rows of the review log, with further columns whose names the operators use inside."""
    rows = [(k, None, f"b{k}", "status_update", "approved", "r", t, 1, 2, "x") for k, t in notes]
    return review.complete_events(spark.createDataFrame(rows, EVENTS))


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def test_words_and_hashes_equal_a_regular_expression(monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 16)
    texts = ["", "Ab,ab", "x" * 50 + " ÄÖ-9", ".", "ab", "nul\0ab", "日本 ab"]
    found = words.find_words(pa.array(texts), phrase_index.WORD)
    got = [(t, found.data[s:e].tobytes().decode()) for t, s, e in zip(found.text, found.starts, found.ends)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in plain_words(t)]
    by_word = defaultdict(set)
    for (_, w), h in zip(got, found.hashes):
        by_word[w].add(int(h))
    assert all(len(h) == 1 for h in by_word.values()) and len({*map(tuple, by_word.values())}) == len(by_word)
    found = words.find_words(pa.array(["aÀÿ×b1É", "é"]), spelling.LETTERS, spelling.LATIN)
    assert [found.data[s:e].tobytes().decode() for s, e in zip(found.starts, found.ends)] == ["aÀÿ×b", "É", "é"]


def test_posting_codes_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**31 - 1] * 3)
    data, at = phrase_index.encode(values)
    assert (phrase_index.decode(data) == values).all() and at[1] == 1
    assert len(phrase_index.decode(np.zeros(0, np.uint8))) == 0


def brute_matches(notes, phrases, width, slop):
    out = set()
    for key, text in notes:
        note = plain_words(text)
        for pid, phrase in phrases:
            p = plain_words(phrase)
            for i in range(max(len(p) - width + 1, 1) if p else 0):
                window = p[i:i + width]
                for start in (s for s, w in enumerate(note) if w == window[0]):
                    at = start
                    for word in window[1:]:
                        at = next((j for j in range(at + 1, len(note)) if note[j] == word), None)
                        if at is None:
                            break
                    if at is not None and at - start + 1 - len(window) <= slop:
                        out.add((key, pid, start, at, at - start + 1 - len(window)))
    return out


@pytest.mark.parametrize("slop", [0, 2])
def test_phrase_matches_equal_brute_force(spark, monkeypatch, slop):
    monkeypatch.setattr(phrase_index, "SEGMENT", 400)
    monkeypatch.setattr(phrase_index, "WINDOWS", 20)
    monkeypatch.setattr(phrase_index, "TESTED", 16)
    rng = random.Random(slop)
    notes = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    notes += [(90, None), (91, ""), (92, "..."), (93, "A-b c,D" * 2000), (None, "a b c d"), (7, "a a a"), (7, "a a a")]
    phrases = [(i, " ".join(rng.choice("abcd") for _ in range(5))) for i in range(12)]
    phrases += [(50, "D"), (51, None), (52, "b b"), (53, " . "), (54, "unseen words"), (55, "b b"), (None, "c c d")]
    texts = spark.createDataFrame(phrases, "warning_id int, explanation string")
    index = phrase_index.index_notes(review_log(spark, notes))
    got = phrase_index.phrase_matches(index, texts, width=4, slop=slop)
    assert {tuple(r) for r in got.collect()} == brute_matches(notes, phrases, 4, slop)


def test_contaminated_notes_count_words_once(spark):
    phrases = [(10, "one two three four"), (9, "three FOUR five"), (8, "zzz"), (8, "one")]
    notes = [(1, "One two. three four five six"), (2, "two three"), (3, None), (4, "one one"), (4, "one one"), (None, "one")]
    texts = spark.createDataFrame(phrases, "warning_id int, explanation string")
    got = phrase_index.contaminated_notes(review_log(spark, notes), texts, width=3)
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == sorted([(1, 6, 5, ["10", "8", "9"]), (2, 2, 0, []), (3, 0, 0, []), (4, 2, 2, ["8"]), (4, 2, 2, ["8"]),
                           (None, 1, 1, ["8"])], key=str)
    assert phrase_index.contaminated_notes(review_log(spark, []), texts).count() == 0
    assert {r["n_hit"] for r in phrase_index.contaminated_notes(review_log(spark, notes), texts.limit(0)).collect()} == {0}
    with pytest.raises(ValueError):
        phrase_index.phrase_matches(phrase_index.PhraseIndex(texts), texts, width=1000, slop=100)
    with pytest.raises(ValueError):
        phrase_index.contaminated_notes(texts, texts, key="found")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("symbols", [1, 3, None])
def test_spellings_equal_brute_force(spark, symbols):
    rng = random.Random(4)
    known = {"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 5, 30, 200, 2000]) for _ in range(150)}
    known.update({"z" * 3000: 40, "z" * 3001: 4, "chain": 1, "chains": 5, "chainsa": 25, "chainsab": 125, "tie": 1, "tia": 5, "tib": 5})
    rows = [(w, n, "x") for w, n in known.items()] + [(None, 5, "x"), ("lost", None, "x")]
    rows += [("again", 3, "x"), ("again", 4, "y")]
    known["again"] = 7
    want = {}
    for w, n in known.items():
        near = [v for v in known if one_edit(w, v)]
        best = min(near, key=lambda v: (-known[v], v)) if near else None
        want[w] = (best if near and known[best] >= 5 * n else None, len(near))
    got = spelling.group_spellings(spark.createDataFrame(rows, "word string, n long, form string"), symbols=symbols).collect()
    assert {r["word"]: (r["form"], r["n_near"]) for r in got} == want and len(got) == len(want)
    for r in got:
        at = r["word"]
        while want[at][0]:
            at = want[at][0]
        assert r["root"] == at and r["n"] == known[r["word"]] and r["form_n"] == known.get(r["form"])


def test_no_words_have_no_spellings(spark):
    assert spelling.group_spellings(spark.createDataFrame([], "word string, n long")).collect() == []
    assert spelling.count_words(review_log(spark, [])).collect() == []


@pytest.mark.parametrize("slips", [None, 7])
def test_word_counts_equal_brute_force(spark, monkeypatch, slips):
    monkeypatch.setattr(spelling, "COUNTED", 500)
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abÀÿ×Z") for _ in range(rng.randint(4, 9))) for _ in range(30)] + ["x" * 90]
    notes = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(40)]
    notes += [(100, None), (101, ""), (None, "nokeyword " * 6), (3, notes[3][1]), (102, "längstes " * 3000)]
    want: Counter = Counter()
    for key, text in notes:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = crc32(f"{key}:{w}".encode())
            if slips and key is not None and h % slips == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                want[w] += 1
    got = spelling.count_words(review_log(spark, notes), slips=slips).collect()
    assert {r["word"]: r["n"] for r in got} == {w: n for w, n in want.items() if n >= 5}


def brute_trie(threads):
    members = defaultdict(list)
    for t, turns in sorted(threads.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(t)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        leaf = [q for q in below if not any(len(r) == len(q) + 1 and r[:-1] == q for r in members)]
        ends = ",".join(str(t) for t in m if len(threads[t]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m),
                    sum(len(q) == len(p) + 1 for q in below), len(leaf),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    rng = random.Random(2)
    log, threads = [], {}
    for t in range(25):
        turns = [(rng.choice(["r", ""]), rng.choice(["ab", "é日", ""])) for _ in range(rng.choice([1, 2, 3, 4]))]
        threads[t] = turns
        log += [(t, i or None, *turn, 0) for i, turn in enumerate(turns)]
    long = [("r", f"turn {i}") for i in range(90)]
    threads[30], threads[31] = long, [*long[:60], ("q", "other")]
    log += [(t, i, *turn, 0) for t in (30, 31) for i, turn in enumerate(threads[t])]
    threads[40] = [("", ""), ("r", "x"), ("r", "y")]  # nulls become empty, ties go by role and text
    log += [(40, 5, "r", "y", 0), (40, 5, "r", "x", 0), (40, None, None, None, 0), (None, 1, "r", "lost", 0)]
    threads[50] = []
    random.Random(1).shuffle(log)
    events = spark.createDataFrame(log, "feature_id long, event_id int, reviewer string, notes string, place int")
    turns = prefix_trie.number_turns(events)
    listed = spark.createDataFrame([(t,) for t in [*threads, 50, None]], "thread long")
    got = prefix_trie.prefix_trie(turns, listed)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(threads)


def test_subtree_totals_of_a_forest(spark):
    rng = random.Random(8)
    up = {0: None, 500: None}
    for i in range(1, 120):
        up[i] = i - 1 if i < 60 else rng.randrange(i)  # a long chain, then branches
    depth = {}
    for i in sorted(up):
        depth[i] = 0 if up[i] is None else depth[up[i]] + 1
    want = {i: 0 for i in up}
    for i in up:
        at = i
        while at is not None:
            want[at] += i
            at = up[at]
    rows = [(str(i), None if u is None else str(u), depth[i], i) for i, u in up.items()]
    nodes = spark.createDataFrame(rows, "node string, parent string, depth int, v int")
    got = prefix_trie.subtree_totals(nodes, {"total": "v"}).collect()
    assert {int(r["node"]): r["total"] for r in got} == want and len(got) == len(want)
    assert prefix_trie.subtree_totals(nodes.limit(0), {"total": "v"}).collect() == []
