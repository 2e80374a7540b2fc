import zlib

import numpy as np
import pytest

from leadlake.llm import language_id
from leadlake.llm.language_id import fit, identify, known_language, ngrams
from leadlake.llm.queries import op2_language_id
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op2_language_id(spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and len(held) > 150
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_ngrams_are_those_of_the_whole_text(monkeypatch):
    def brute(text):
        t = text.lower()
        return len({t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)})

    text = "Añb\U0001f600c ab" * 50 + "xyz"
    whole = ngrams(text)
    assert len(whole) == brute(text) and (np.diff(whole) > 0).all()
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert (ngrams(text) == whole).all()
    assert len(ngrams("")) == 0 and len(ngrams("ab")) == 3


def test_folded_scores_are_those_of_the_kernel():
    texts = ["the cat and the dog", "a dog and the hat", "el gato y el perro", "un perro y la casa", "the hat", "la casa"]
    labels = ["en", "en", "es", "es", "en", "es"]
    sets = [ngrams(t) for t in texts]
    model = fit(sets, labels, [0, 1, 2, 3])

    def kernel(a, b):
        return len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))

    marks = np.array([[kernel(sets[i], sets[j]) for j in range(4)] for i in range(6)])
    values, vectors = np.linalg.eigh(marks[:4])
    features = marks @ (vectors / np.sqrt(values))
    wanted = np.array([[1.0 if x == l else -1 for l in ("en", "es")] for x in labels])
    weights = np.linalg.solve(features.T @ features / 3 + language_id.RIDGE * np.eye(4), features.T @ wanted / 3)
    assert np.allclose(model.scores(sets), features @ weights, atol=1e-5)
    assert model.languages == ["en", "es"] and [model.languages[i] for i in model.scores(sets).argmax(axis=1)] == labels


def test_edges(spark):
    en, es = "the house and the garden with the tree", "la casa y el jardín con el árbol"
    rows = [(i, f"{en} {i}", "en") for i in range(20)] + [(i, f"{es} {i}", "es") for i in range(20, 40)]
    rows += [(40, None, "en"), (41, "", "es"), (42, "12 34 !?", "en"), (None, "the tree and", None), (44, en * 5000, None), (20, f"{es} 20", "es")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as score", "1 as lang_pred", "2 as `row`", "date'2020-01-01' as `a day`")
    got = identify(docs).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(rows)
    assert by[40] == by[41] == by[42] == ("und", 0.0)
    assert by[None][0] == by[44][0] == "en" and by[30][0] == "es"
    stay = known_language(docs)
    assert stay.columns == docs.columns
    assert {r["doc_id"] for r in stay.collect()} >= set(range(40)) | {44}
    assert not {r["doc_id"] for r in stay.collect()} & {40, 41, 42}
    assert identify(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda sets, labels, landmarks: seen.append((sets, labels, landmarks)))
    texts = [(f"the house number {i}", "en") for i in range(40)] + [(f"la casa número {i}", "es") for i in range(40)]
    rows = spark.createDataFrame(texts, "text string, lang string")
    least = rows.orderBy(F.xxhash64("text")).filter("lang = 'en'").first()
    language_id.learn(rows, sample=20, landmarks=8)
    language_id.learn(rows.union(spark.createDataFrame([tuple(least)] * 40, rows.schema)).repartition(5), sample=20, landmarks=8)
    (sets, labels, landmarks), (again, *rest) = seen
    assert len({s.tobytes() for s in again}) == 40 and labels.count("en") == labels.count("es") == 20 and len(landmarks) == 16
    assert [s.tolist() for s in again] == [s.tolist() for s in sets] and rest == [labels, landmarks]


def test_every_label_is_learned(spark):
    rows = [(f"word{i} other{i} {i}", f"l{i:03}") for i in range(205)] * 2 + [("rare \u4e00", "rare")]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 206
    assert model.languages[model.scores([ngrams("rare \u4e00")]).argmax()] == "rare"


def test_the_sample_holds_the_least_hashes_of_a_hot_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "fit", lambda sets, labels, landmarks, ridge=0: (sets, labels))
    rows = [(f"text {i % 3000} of a kind", "en") for i in range(6000)] + [(f"texte {i}", "fr") for i in range(40)] + [("one", "de")] * 500
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    sets, labels = language_id.learn(docs, sample=20)
    assert {x: labels.count(x) for x in set(labels)} == {"en": 20, "fr": 20, "de": 1}
    keys = docs.select("lang", "text", F.xxhash64("text").alias("h")).distinct().collect()
    for lang in ("en", "fr"):
        least = sorted((r["h"], r["text"]) for r in keys if r["lang"] == lang)[:20]
        assert sorted(s.tolist() for s, label in zip(sets, labels) if label == lang) == sorted(ngrams(t).tolist() for _, t in least)


def test_a_sample_that_the_driver_can_not_take_is_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some text {i} of a kind", "en") for i in range(20)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "FITTED_BYTES", 100)
    with pytest.raises(ValueError, match="lower sample"):
        language_id.identify(docs)
