import random
import zlib

import numpy as np

from parlance.llm import language_id, toxicity
from parlance.llm._common import read_table

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "1234 --"), (4, "the"), (None, "the and of"), (5, "x" * 200_000), (5, "x" * 200_000)]


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_languages_of_held_out_documents(spark):
    rows = language_id.op1_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in read_table(spark, SF, "documents").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.96
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es"} for r in rows)
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)


def test_languages_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "old") for r in ODD], "doc_id long, text string, score string")
    model = language_id.train([b"the and of that with this"] * 30 + ["der die das und nicht für".encode()] * 30, ["en"] * 30 + ["de"] * 30)
    rows = language_id.identified(docs, model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[4].lang_pred == "en" and by[None].lang_pred == "en"
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (1, 2, 3))
    none = language_id.identified(docs, language_id.fit(spark.createDataFrame([("a", None)], "text string, lang string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identified(docs.limit(0), model).count() == 0


def test_toxicity_of_held_out_documents(spark):
    rows = toxicity.op5_toxicity(spark, SF).collect()
    known = {r.doc_id: r.toxic for r in read_table(spark, SF, "labels").collect()}
    assert len(rows) == read_table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    y = np.array([known[r.doc_id] for r in held])
    assert auc(np.array([r.score for r in held]), y) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_learns_words_and_odd_rows(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = [r.choice(words) for _ in range(60)]
        if bad:
            t.insert(r.randrange(60), "wretch")
        docs.append((100 + i, " ".join(t), None))
        labels.append((100 + i, int(bad)))
    docs += [(*x, "old") for x in ODD]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = toxicity.fit(df, spark.createDataFrame([*labels, (100, 1), (None, 1), (7777, 1), (1, None), (2, 0)], "doc_id long, toxic int"))
    by = {x.doc_id: x for x in toxicity.scored(df, model).collect()}
    assert np.mean([by[d].predicted == y for d, y in labels]) > 0.97
    assert by[1].score == by[2].score < 0.5
    empty = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x.predicted for x in toxicity.scored(df, empty).collect()} == {0}
    assert toxicity.scored(df.limit(0), model).count() == 0


# --- what is computed, against plain versions ----------------------------------------------------


def plain_gram_bucket(gram, buckets):
    h = gram[0]
    for x in gram[1:]:
        h = (h * 0x01000193 & 0xFFFFFFFF) ^ x
    return (h * 0x9E3779B1 & 0xFFFFFFFF) >> (33 - buckets.bit_length())


def plain_letters(b):
    return [x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in b]


def test_language_scores_by_hand():
    model = language_id.train([b"the and of that with this"] * 30 + ["der die das und nicht für".encode()] * 30, ["en"] * 30 + ["de"] * 30)
    for text in ("The  cat -- and", "für Äpfel", "a", "zz zz"):
        x = plain_letters(text.encode())
        x = [y for i, y in enumerate(x) if not (y == 32 and i and x[i - 1] == 32)]
        hits = [plain_gram_bucket(x[i : i + n], language_id.BUCKETS) for n in language_id.GRAMS for i in range(len(x) - n + 1)]
        z = [sum(float(model.table[h, k]) for h in hits) / max(len(hits), 1) + float(model.bias[k]) for k in range(2)]
        e = [np.exp((v - max(z)) / model.temperature) for v in z]
        got = model.scores(language_id.gram_counts(np.frombuffer(text.encode(), np.uint8)))
        assert np.allclose(got, np.array(e) / sum(e), atol=1e-4)


def test_toxicity_counts_and_scores_by_hand(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(40)]
    docs = [(i, " ".join(r.choice(words) for _ in range(20)) + (" wretch" if i % 3 == 0 and i % 7 else "")) for i in range(200)]
    labels = [(i, int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))

    def grams(text):
        x = [32, *plain_letters(text.encode()), 32]
        return {plain_gram_bucket(x[i : i + toxicity.GRAM], toxicity.BUCKETS) for i in range(len(x) - toxicity.GRAM + 1)}

    n = {}
    for (_, text), (_, y) in zip(docs, labels):
        for g in grams(text):
            n.setdefault(g, [0, 0])[y] += 1
    t0, t1 = sum(y == 0 for _, y in labels), sum(labels[i][1] for i in range(200))
    sure = {}
    for g, (a, b) in n.items():
        if a + b >= toxicity.LEAST_TEXTS:
            q = (a + b) / (t0 + t1)
            sure[g] = abs(b / t1 - a / t0) / (q * (1 - q) * (1 / t0 + 1 / t1) + 1e-12) ** 0.5
    kept = set(sorted(sure, key=lambda g: (-sure[g], g))[: toxicity.FEATURES])
    assert set(np.flatnonzero(model.weights).tolist()) <= kept
    assert max(sure, key=sure.get) in set(np.flatnonzero(model.weights).tolist())
    for r in toxicity.scored(df, model).collect():
        z = model.intercept + sum(float(model.weights[g]) for g in grams(r.text))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-4 and r.predicted == int(r.score >= 0.5)


def test_features_are_chosen_by_one_statistic(spark, monkeypatch):
    """Frequent buckets of a mild ratio aren't crowded out by rare one-sided ones, in however large a vocabulary."""
    monkeypatch.setattr(toxicity, "FEATURES", 3)
    rows = [(b, 1, 5) for b in range(2000)] + [(5000, 900, 400), (5001, 300, 700), (5002, 10, 90)]
    counts = spark.createDataFrame(rows, "bucket int, n0 long, n1 long")
    assert {r.bucket for r in toxicity._surest(counts, (1000, 1000), 3)} == {5000, 5001, 5002}


def test_copies_dont_exceed_the_sample(spark, monkeypatch):
    seen = []
    train = language_id.train
    monkeypatch.setattr(language_id, "train", lambda texts, labels, **more: seen.append(len(texts)) or train(texts, labels, **more))
    rows = [(i, "the same text and again", "en") for i in range(3000)] + [(i, f"der text nummer {i} und", "de") for i in range(3000, 4000)] + [(None, "the same text and again", "en")] * 500
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=200)
    assert 150 < seen[0] <= 200 and model.languages == ["de", "en"]


def test_long_texts_teach(spark):
    rows = [(i, "the and of that with " * 6000, "en") for i in range(60)] + [(i, "der die das und nicht " * 6000, "de") for i in range(60, 120)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]


def test_clashing_columns(spark):
    names = "doc_id long, text string, body string, BODY_ string, lang_pred string, score string, rejected string, predicted string"
    docs = spark.createDataFrame([(1, "the cat", "b", "c", "d", "e", "f", "g")] * 2, names)
    model = language_id.train([b"the and of that with this"] * 30, ["en"] * 30)
    assert {(r.body, r.lang_pred, r.predicted) for r in language_id.identified(docs, model).collect()} == {("b", "en", "g")}
    scored = toxicity.scored(docs, toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS, np.float32), 0.0)).collect()
    assert len(scored) == 2 and {(r.body, r.score, r.predicted, r.lang_pred) for r in scored} == {("b", 0.5, 1, "d")}
