from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prescriva.llm import language, toxicity, wordhash

SF = "/root/testdata/sf0.01"


def test_word_hashes_against_split():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB \t\né\x0b,.") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", " ", "x" * 5000, None]
    seen: dict[bytes, int] = {}
    for most in (50, 1 << 20):
        at = 0
        for hashes, counts in wordhash.word_hashes(pa.array(texts, pa.string()), most=most):
            words = [(t or "").encode().lower().split() for t in texts[at : at + len(counts)]]
            assert [len(w) for w in words] == counts.tolist()
            for w, h in zip([x for y in words for x in y], hashes.tolist(), strict=True):
                assert seen.setdefault(w, h) == h
            at += len(counts)
        assert at == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_cnn_gradient_by_differences():
    rng = np.random.default_rng(0)
    cnn = toxicity.TextCnn(buckets=20, dim=4, filters=3)
    cnn.weights = {k: v.astype(np.float64) for k, v in cnn.weights.items()}
    docs = [rng.integers(1, 20, (n, 4)) for n in (5, 1, 0, 9)]
    row = np.concatenate([np.concatenate([d, np.zeros((3, 4), int)]) for d in docs])
    starts = np.cumsum([0] + [len(d) + 3 for d in docs])[:-1]
    y = np.array([1, 0, 1, 0])

    def loss():
        z = cnn.logits(row, starts)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = cnn.gradient(row, starts, y)
    rows = g.pop("rows").tolist()
    for k, d in g.items():
        for _ in range(8):
            i = tuple(rng.integers(0, n) for n in d.shape)
            j = (rows[i[0]], *i[1:]) if k == "embed" else i
            if k == "embed" and j[0] == 0:
                continue
            old = cnn.weights[k][j]
            cnn.weights[k][j] = old + 1e-5
            up = loss()
            cnn.weights[k][j] = old - 1e-5
            down = loss()
            cnn.weights[k][j] = old
            assert abs((up - down) / 2e-5 - d[i]) < 1e-3


def test_toxicity_held_out(spark):
    got = toxicity.op2_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert len(got) == 10000 and got.score.between(0, 1).all()
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.02


def test_toxicity_edges(spark):
    schema = "doc_id long, text string, lang string, toxic int, flagged string, toxicity int"
    docs = spark.createDataFrame([(1, None, None, 1, "a", 1), (1, "", "en", 0, "b", 1), (None, "x " * 30000, "en", 1, "c", 1), (2, "moron", None, None, None, None), (2, "moron", None, None, None, None)], schema)
    none = toxicity.fit(docs, docs.select("doc_id", "toxic").limit(0))
    assert [r.toxicity for r in toxicity.score(docs, none).collect()] == [0.0] * 5
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    out = toxicity.score(docs, model).collect()
    assert len(out) == 5 and out[0].toxicity == out[1].toxicity and out[3].toxicity == out[4].toxicity and all(0 <= r.toxicity <= 1 for r in out)
    assert toxicity.score(docs.limit(0), model).count() == 0


def plain_score(cnn, text):
    """A score by loops over a text's words; no batch, no padding."""
    words = re.findall(rb"[^\x00-/:-@\[-`{-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    buckets = [next(toxicity.bucket_runs(pa.array([w.decode(errors="surrogateescape")]), cnn.buckets))[0][0] for w in words]
    x = [sum(cnn.weights["embed"][b] for b in own) for own in buckets]
    z = cnn.weights["out_bias"][0]
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(cnn.filters):
            best = 0.0
            for i in range(len(x)):
                window = np.concatenate([x[i + j] if i + j < len(x) else np.zeros(cnn.dim) for j in range(w)])
                best = max(best, float(window @ cnn.weights[f"filter{w}"][:, f]) + cnn.weights[f"bias{w}"][f])
            z += max(best, 0.0) * cnn.weights["out"][k * cnn.filters + f]
    return z


def test_scores_against_loops_in_any_company():
    rng = np.random.default_rng(2)
    cnn = toxicity.TextCnn(filters=4)
    cnn.weights["out"] = rng.normal(0, 2, cnn.weights["out"].shape).astype(np.float32)
    cnn = cnn.exact()
    words = ["some", "Words", "vile", "scum", "déjà", "x1", "longer-word", "!", "extraordinary"]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 2, 3, 7, 40, 200, 1)] + [None, "moron", "you are vile"]
    alone = [cnn.scores(pa.array([t], pa.string()))[0] for t in texts]
    plain = 1 / (1 + np.exp(-np.array([plain_score(cnn, t) for t in texts])))
    assert np.abs(np.round(plain, 6) - alone).max() < 2e-6
    for seed in range(5):
        order = np.random.default_rng(seed).permutation(len(texts))
        got = cnn.scores(pa.array([texts[i] for i in order], pa.string()))
        assert got.tolist() == [alone[i] for i in order]


def test_scores_after_a_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), sample=200)
    a, b = (sorted(map(tuple, toxicity.score(x, model, ["doc_id"]).collect())) for x in (docs.coalesce(1), docs.repartition(13)))
    assert a == b


def test_toxicity_sample_and_thresholds(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(7 if i % 3 == 0 else 1000 + i, f"{'vile scum' if i % 4 == 1 else 'kind words'} {rng.random()}", "zz" if i % 50 in (1, 2) else "en") for i in range(1200)]
    docs = spark.createDataFrame([*rows, *rows[:40]], "doc_id long, text string, lang string")
    toxic = {i: 0 for i, _, _ in rows} | {i: 1 for i, t, _ in rows if t.startswith("vile") and i != 7}
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    learned = []
    own = toxicity.TextCnn.fit
    monkeypatch.setattr(toxicity.TextCnn, "fit", lambda self, docs, y, **more: learned.append(len(docs)) or own(self, docs, y, **more))
    counted = []
    cuts = toxicity._cuts
    monkeypatch.setattr(toxicity, "_cuts", lambda counts, *more: counted.append(counts.toPandas()) or cuts(counts, *more))
    model = toxicity.fit(docs, labels, sample=60)
    assert learned == [60] and set(model.thresholds) == {"en", "zz"}
    assert 1240 - 2 * 60 <= counted[0].n.sum() <= 1240 - 60 and counted[0].toxic.sum() > 100


def test_thresholds_against_all_rows(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(toxicity.BINS), rng.randrange(1, 5)) for _ in range(3000)]
    rows = [(lang, b, n, sum(rng.random() < b / toxicity.BINS for _ in range(n))) for lang, b, n in rows] + [("clean", 9000, 3, 0), ("never", 9000, 9, 1)]

    def brute(own):
        if not sum(x[3] for x in own):
            return None
        good = [b for b in {x[1] for x in own} if b >= 3000 and sum(x[3] for x in own if x[1] >= b) >= 0.9 * sum(x[2] for x in own if x[1] >= b)]
        return min(good) / toxicity.BINS if good else 0.5

    got, common = toxicity._cuts(spark.createDataFrame(rows, "lang string, bin long, n long, toxic long"), 0.9, 0.3)
    assert got == {k: brute([x for x in rows if x[0] == k]) for k in ("a", "b", None, "never")} and common == brute(rows)


def naive_phrases(text, sample):
    count = i = 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        count += 1  # an unknown character is a phrase of its own
        i += n
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(5)
    samples = {k: "".join(rng.choice("abc ") for _ in range(400)) for k in ("x", "y")}
    model = language.LanguageModel.of(samples)
    samples["z"] = "ab" * 400 + "c"  # long matches, so that phrases span several segments
    model = language.LanguageModel.of(samples)
    texts = ["".join(rng.choice("abc dé") for _ in range(rng.randrange(1500))) for _ in range(60)]
    texts += ["ab" * 900, "c" + "ab" * 1300 + "c" + "ba" * 700, "é" * 600, "", "ab" * 128, "a", "é", samples["x"] * 4]
    sizes, counts = model.phrases(texts)
    assert sizes.tolist() == [len(t) for t in texts]
    for k, sample in enumerate(model.tables):
        assert counts[:, k].tolist() == [naive_phrases(t, samples[sample]) for t in texts]


def test_language_held_out_and_edges(spark):
    got = language.op6_language(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    docs = spark.createDataFrame([(1, None, "en"), (2, "12 !? ½²", "en"), (3, "the of and " * 20, "en"), (3, "le de la et " * 20000, "fr"), (None, "le de la", None), (5, "世界", "fr")], "doc_id long, text string, lang string")
    model = language.fit(docs.union(docs.selectExpr("9", "'le la les de la et un'", "'fr'")))
    out = language.identify(docs.withColumn("lang_pred", docs.lang), model).collect()
    assert [r.lang_pred for r in out[:4]] == ["und", "und", "en", "fr"] and out[4].lang_pred == "fr" and out[0].lang_score == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_language_of_long_and_rare_texts(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(language.LanguageModel, "of", classmethod(lambda cls, samples: taken.update(samples)))
    words = {"long": "9 alpha beta ", "mixed": "eta theta "}
    long = [(i, words["long"] * 3000, "long") for i in range(5)]
    mixed = [(i, words["mixed"] * (1900 if i % 2 else 30), "mixed") for i in range(60)]
    docs = spark.createDataFrame([*long, *mixed], "doc_id long, text string, lang string")
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10_000 == 5, "gamma delta").otherwise(F.repeat(F.lit("gamma delta "), 40)).alias("text"), F.lit("rare").alias("lang"))
    language.fit(docs, max_chars=20_000)
    assert 16_000 < len(taken["long"]) <= 20_000  # "9 " goes
    assert set(taken["long"].split()) <= {"alpha", "beta", "a", "al", "alp", "alph", "b", "be", "bet"}
    assert 9_000 <= len(taken["mixed"]) <= 20_000
    language.fit(many, max_chars=400, rows=10)
    assert taken["rare"].split().count("gamma") >= 10 and len(taken["rare"]) <= 400 + 2  # spaces between texts


def test_tables_of_large_alphabets_stay_small():
    """Two languages of 3,000 and 1,500 characters: phrases are longest matches, and a table takes some MB."""
    rng = random.Random(6)
    draw = lambda n, first, kinds: "".join(chr(first + int(kinds * rng.random() ** 3)) for _ in range(n))
    samples = {"a": draw(20_000, 0x4E00, 3000), "b": draw(20_000, 0x6000, 1500)}
    model = language.LanguageModel.of(samples)
    assert all(t.nbytes < 10_000_000 for t in model.tables.values())
    texts = [draw(300, 0x4E00, 3000), draw(700, 0x6000, 1500), samples["a"][5000:5600] + "é" + samples["b"][:400], "", "x"]
    _, counts = model.phrases(texts)
    for k, name in enumerate(model.tables):
        assert counts[:, k].tolist() == [naive_phrases(t, samples[name]) for t in texts]


def test_very_many_languages_have_smaller_samples(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(language, "ALL_CHARS", 3000)
    monkeypatch.setattr(language.LanguageModel, "of", classmethod(lambda cls, samples: taken.update(samples)))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("alpha beta "), 100).alias("text"), (F.col("id") % 10).cast("string").alias("lang"))
    language.fit(docs)
    assert len(taken) == 10 and all(0 < len(t) <= 302 for t in taken.values())
