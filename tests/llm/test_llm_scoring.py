import duckdb
import numpy as np
import pytest

from groundcheck.llm import language, mixing, queries, toxicity

SF = "/root/testdata/sf0.01"


def events(spark, rows, extra="score"):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], f"event_id long, notes string, {extra} string")


def labelled(n=120):
    """Notes where an insult is toxic only together with a group, so no sum of term weights tells them apart."""
    rng = np.random.default_rng(2)
    notes, marks = [], []
    for i in range(n):
        insult, group = i % 2, (i // 2) % 2
        words = [f"w{rng.integers(60)}" for _ in range(12)] + ["vermin"] * insult + ["townsfolk"] * group
        notes.append((i, " ".join(rng.permutation(words))))
        marks.append((i, int(insult and group), 1))
    return notes, marks


def test_toxicity_learns_pairs_of_terms(spark):
    notes, marks = labelled(400)
    labels = spark.createDataFrame(marks + [(None, 1, 1), (5000, None, 1), (5001, 7, 1)], "event_id long, toxic int, quality int")
    model = toxicity.fit_toxicity(events(spark, notes), labels, toxic_rows=80, clean_rows=240)
    got = toxicity.score_notes(events(spark, notes), model).collect()
    want = {i: y for i, y, _ in marks}
    right = np.mean([r["predicted"] == want[r["event_id"]] for r in got])
    assert right > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_of_null_empty_repeated_and_no_rows(spark):
    notes, marks = labelled()
    labels = spark.createDataFrame(marks, "event_id long, toxic int, quality int")
    model = toxicity.fit_toxicity(events(spark, notes), labels)
    rows = [(1, None), (2, ""), (None, "vermin townsfolk"), (3, "same " * 20000), (3, "same " * 20000)]
    got = [(r["event_id"], r["predicted"]) for r in toxicity.score_notes(events(spark, rows), model).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (None, 1), (3, 0), (3, 0)], key=str)
    assert toxicity.score_notes(events(spark, []), model).collect() == []
    empty = toxicity.fit_toxicity(events(spark, []), labels.limit(0))
    assert toxicity.score_notes(events(spark, [(1, "vermin")]), empty).collect()[0]["predicted"] == 0


def test_toxicity_query_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").collect()}
    rows = duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'").fetchall()
    held = [(y, got[i]["predicted"]) for i, y in rows if i in got]
    caught = np.mean([p for y, p in held if y == 1])
    wrong = np.mean([p for y, p in held if y == 0])
    assert len(held) > 600 and caught > 0.8 and wrong < 0.01


TALK = {"en": "the water and the house of this thing with other people that were walking",
        "de": "der große Weg und die schöne Straße für einen Menschen zwischen Häusern",
        "es": "el niño y la señora de una ciudad con otra canción para mañana"}


def talk(seed, lang, n):
    return " ".join(np.random.default_rng(seed).choice(TALK[lang].split(), n))


def test_language_labels_words_of_mixed_notes(spark):
    known = [(i, talk(i, lang, 40), lang) for i, lang in enumerate(["en", "de", "es"] * 8)]
    known += [(100, None, "en"), (101, "123 456", "de"), (102, "hello", None), (None, "hola", "es")]
    frame = spark.createDataFrame(known, "event_id long, notes string, lang string")
    model = language.fit_language(frame)
    mixed = talk(50, "en", 15) + " " + talk(51, "es", 15)
    tags = [lang for _, lang in language.tag_words(model, mixed)]
    assert np.mean([a == b for a, b in zip(tags, ["en"] * 15 + ["es"] * 15)]) > 0.9
    rows = [(1, talk(60, "de", 30)), (2, talk(61, "es", 3000)), (3, None), (4, ""), (5, "42 --- 17"), (None, talk(62, "en", 9)),
            (6, talk(63, "en", 20)), (6, talk(63, "en", 20))]
    got = sorted(((r["event_id"], r["lang_pred"], round(r["score"])) for r in language.predict_language(
        events(spark, rows, "lang_pred"), model).collect()), key=str)
    assert got == sorted([(1, "de", 1), (2, "es", 1), (3, "und", 0), (4, "und", 0), (5, "und", 0), (None, "en", 1),
                          (6, "en", 1), (6, "en", 1)], key=str)
    assert language.predict_language(events(spark, []), model).collect() == []


def test_language_without_labels(spark):
    model = language.fit_language(spark.createDataFrame([(1, "a", None)], "event_id long, notes string, lang string"))
    assert language.predict_language(events(spark, [(1, "word")]), model).collect()[0]["lang_pred"] == "und"


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    sizes = np.array([4, 3, 1])
    alive, begins = language._layout(sizes)
    scores, moves, start = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    post, expected = language.forward_backward(scores, alive, begins, moves, start, pairs=True)
    total = np.zeros((3, 3))
    for j, n in enumerate(sizes):
        own = np.array([scores[begins[i] + j] for i in range(n)])
        weight, mean = 0.0, np.zeros((n, 3))
        pairs = np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(own[i, s] for i, s in enumerate(path))
                       + sum(moves[a, b] for a, b in zip(path, path[1:])))
            weight += w
            for i, s in enumerate(path):
                mean[i, s] += w
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w
        total += pairs / weight
        assert np.allclose([post[begins[i] + j] for i in range(n)], mean / weight)
    assert np.allclose(expected, total)


def test_language_query_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op10_language(spark, SF).filter("held_out").collect()}
    rows = duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall()
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in rows if i in got]) > 0.97


def test_raking_meets_the_targets_and_probabilities_the_share():
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 1000, (4, 3, 3)).astype(float)
    goals = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.2, 0.2])]
    fit = mixing.rake(tokens, goals)
    for axis, goal in enumerate(goals):
        assert np.allclose(fit.sum(axis=tuple(a for a in range(3) if a != axis)), goal)
    chance = mixing.keep_probabilities(tokens, fit, 0.3)
    assert np.isclose((tokens * chance).sum(), 0.3 * tokens.sum()) and chance.max() <= 1


def test_mix_query_draws_near_the_targets(spark):
    got = queries.op7_mixing(spark, "/root/testdata/sf0.1").toPandas()
    want = queries.MIX
    kept = got[got["kept"]]
    share = kept["tokens"].sum() / got["tokens"].sum()
    assert abs(share - 0.8) < 0.03 and len(got) == 10000
    fit = (got["tokens"] * got["probability"]).groupby(got["lang"]).sum()
    drawn = kept.groupby("lang")["tokens"].sum()
    assert np.allclose(drawn / drawn.sum(), fit[drawn.index] / fit.sum(), atol=0.02)
    assert set(got["topic"]) <= set(want["topic"]) | {mixing.REST}


def test_mix_of_null_empty_repeated_and_no_rows(spark):
    goals = {"reviewer": {"a": 0.5, mixing.REST: 0.5}, "tokens": {"x": 1.0}}
    rows = [(1, "one two", "a", "x"), (1, "one two", "a", "x"), (2, None, "a", "x"), (3, "", None, "x"), (None, "w", "b", None)]
    frame = spark.createDataFrame(rows, "event_id long, notes string, reviewer string, tokens string")
    assert len(mixing.mix_notes(frame.withColumnRenamed("tokens", "topic"), {"reviewer": goals["reviewer"], "topic": {"x": 1.0}}).collect()) == 5
    got = mixing.mix_notes(frame.limit(0).withColumnRenamed("tokens", "topic"), {"reviewer": goals["reviewer"]})
    assert got.collect() == []
    with pytest.raises(ValueError):
        mixing.mix_notes(frame, goals, share=0)


def test_mix_query_meets_the_targets_by_every_column(spark):
    got = queries.op7_mixing(spark, "/root/testdata/sf0.1").toPandas()
    assert (got["kept"] == (got["copies"] > 0)).all()
    drawn = got["tokens"] * got["copies"]
    for column, goal in queries.MIX.items():
        share = drawn.groupby(got[column]).sum() / drawn.sum()
        assert all(abs(share.get(value, 0) - want) < 0.02 for value, want in goal.items()), (column, share)


def test_mix_stage_repeats_what_is_short(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = {r["doc_id"]: r["copies"] for r in queries.mixed(docs).collect() if r["copies"]}
    got = corpus_pipeline.mix_sources(spark, docs, SF)
    assert got.columns == docs.columns and max(copies.values()) > 1
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == copies


def test_mix_takes_unnamed_values_by_their_actual_share(spark):
    rows = [(i, "one two three", ["en", "de", "it", None][i % 4], "src0" if i % 3 else None) for i in range(4000)]
    rows += [(5000, "", "fr", "src0"), (5001, "", None, "never")]
    docs = spark.createDataFrame(rows, "event_id long, notes string, lang string, source string")
    got = mixing.mix_notes(docs, {"lang": {"en": 0.6, "de": 0.2, "fr": 0.2}, "source": {"src0": 0.5, "never": 0.5}}).toPandas()
    drawn = got["tokens"] * got["copies"]
    lang, source = (drawn.groupby(got[c]).sum() / drawn.sum() for c in ("lang", "source"))
    assert np.allclose([lang[mixing.REST], lang["en"], lang["de"]], [0.5, 0.375, 0.125], atol=0.03)
    assert abs(source[mixing.REST] - 1 / 3) < 0.03
    assert set(got.loc[got["event_id"] >= 5000, "copies"]) == {1}
    none = mixing.mix_notes(docs, {"lang": {"en": 0.5, "de": 0.5, mixing.REST: 0.0}}).toPandas()
    assert not none.loc[none["lang"] == mixing.REST, "kept"].any()
