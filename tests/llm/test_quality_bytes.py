from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from prescriva.llm import quality, sharded


def brute(texts, trusted):
    """Perplexities over whole bytes by plain dictionaries; None stands before a text."""
    k4 = [[tuple(s[i : i + 4]) for i in range(len(s) - 3)] for s in ([None] * 3 + list(t.encode()) for t in texts)]
    table, models = Counter(g for own, ok in zip(k4, trusted, strict=True) if ok for g in own), {}
    for k in (4, 3, 2, 1):
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(max(j - (j + 1) * y * n[j + 1] / n[j], 0), j) if n[j] else 0.5 for j in (1, 2, 3)]
        total, back = Counter(), defaultdict(float)
        for g, c in table.items():
            total[g[:-1]] += c
            back[g[:-1]] += d[min(c, 3) - 1]
        models[k] = table, d, total, back
        table = Counter(g[1:] for g in table)

    def logp(g):
        p = 1 / 256
        for k in (1, 2, 3, 4):
            (table, d, total, back), own = models[k], g[4 - k :]
            if t := total[own[:-1]]:
                p = (table[own] - d[min(table[own], 3) - 1] if table[own] else 0) / t + back[own[:-1]] / t * p
        return math.log10(p)

    return [10 ** -(sum(map(logp, own)) / len(own)) for own in k4]


def test_whole_bytes_are_the_symbols(spark, monkeypatch, tmp_path):
    """Capitals, digits and bytes of other scripts are told apart, the byte 0 from a text's beginning too."""
    monkeypatch.setattr(sharded, "ROWS", 8)
    monkeypatch.setattr(quality, "PENDING", 50)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcABX019é\u0436\u4e2d\x00 .") for _ in range(rng.randrange(1, 80))) for _ in range(60)] + ["A1" * 40, "B9" * 40]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(i, 1) for i in [*range(30), 60]], "doc_id long, quality int")
    got = {r.doc_id: r.perplexity for r in quality.perplexities(docs, labels, quality.BYTES).collect()}
    want = brute(texts, [i < 30 or i == 60 for i in range(62)])
    assert [got[i] for i in range(62)] == pytest.approx(want, rel=1e-4)
    assert got[61] > 2 * got[60]


def test_the_query_is_over_whole_bytes(spark, tmp_path):
    rows = [(0, "A1" * 200, "x", "s", 400), (1, "B9" * 200, "x", "s", 400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id: r.kept for r in quality.op3_quality(spark, str(tmp_path)).collect()} == {0: True, 1: False}
