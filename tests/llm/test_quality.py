from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from prescriva.llm import quality, sharded

SF = "/root/testdata/sf0.1"


def brute(rows, trusted):
    """Perplexities by plain dictionaries."""
    k4 = []
    for _, t, _ in rows:
        s = [0, 0, 0, *(int(quality._CLASS[b]) for b in (t or "").encode())]
        k4.append([tuple(s[i : i + 4]) for i in range(len(s) - 3)])
    tables = {4: Counter(g for own, ok in zip(k4, trusted, strict=True) if ok for g in own)}
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    models = {}
    for k, table in tables.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(max(j - (j + 1) * y * n[j + 1] / n[j], 0), j) if n[j] else 0.5 for j in (1, 2, 3)]
        total, back = Counter(), defaultdict(float)
        for g, c in table.items():
            total[g[:-1]] += c
            back[g[:-1]] += d[min(c, 3) - 1]
        models[k] = (table, d, total, back)

    def logp(g):
        p = 1 / 64
        for k in (1, 2, 3, 4):
            table, d, total, back = models[k]
            own = g[4 - k :]
            if t := total[own[:-1]]:
                c = table[own]
                p = (c - d[min(c, 3) - 1] if c else 0) / t + back[own[:-1]] / t * p
        return math.log10(p)

    return [10 ** -(sum(map(logp, own)) / len(own)) if own else None for own in k4]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharded, "ROWS", 8)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("aabcé .\n%A7") for _ in range(rng.randrange(1, 80))), rng.choice(["x", "y", None])) for i in range(60)]
    rows += [(70, None, "x"), (71, "", "x"), (None, "abc", "x"), (3, "aab cab", "y"), (72, "Ab" * 30000, "z")]
    docs = spark.createDataFrame([(*r, 1, 2, 0) for r in rows], "doc_id long, text string, lang string, gram int, block int, kept int").coalesce(1)
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(2, 0), (2, 1), (40, None), (None, 1), (9999, 1), (31, 0)], "doc_id long, quality int")
    trusted = [i is not None and i < 30 for i, *_ in rows]
    got = quality.perplexities(docs, labels).collect()
    wanted = brute(rows, trusted)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", -1 if r[2] is None else round(r[2], 3))
    for r, w in zip(sorted(((r.doc_id, r.lang, r.perplexity) for r in got), key=key), sorted(((i, lang, w) for (i, _, lang), w in zip(rows, wanted, strict=True)), key=key), strict=True):
        assert r[:2] == w[:2] and ((r[2] is None) if w[2] is None else r[2] == pytest.approx(w[2], rel=1e-4))
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows) and not any(r.kept for r in out if r.perplexity is None)
    assert all(r.kept for r in quality.classify(docs, labels.limit(0)).collect() if r.perplexity is not None)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_of_labelled_documents(spark):
    got = quality.op3_quality(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.3


def test_null_and_empty_languages_have_thresholds_of_their_own(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(40)) if i % 2 else "x" * (20 + i % 7), [None, "", "en"][i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)], "doc_id long, quality int")
    by = {r.doc_id: r for r in quality.classify(docs, labels, 0.9).collect()}
    limits = {lang: {by[i].threshold for i, _, x in rows if x == lang} for lang in (None, "", "en")}
    for lang in limits:
        trusted = sorted(by[i].perplexity for i, _, x in rows if x == lang and i % 2 == 0)
        assert limits[lang] == {trusted[math.ceil(0.9 * len(trusted)) - 1]}  # an order statistic, exactly
