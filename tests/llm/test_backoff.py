from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from prescriva.llm import backoff, sharded, shared


def brute(rows, mod=10):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % mod == 0 for i, _ in rows]
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    one, two, follow = Counter(), Counter(), defaultdict(set)
    for w, h in zip(tokens, held, strict=True):
        if not h:
            one.update(w)
            for a, b in zip(["<s>", *w], w, strict=False):
                two[a, b] += 1
                follow[a].add(b)
            one["<s>"] += 1
    starts = one.pop("<s>", 0)
    n, v = sum(one.values()), len(one)
    out = []
    for (i, _), w, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for a, b in zip(["<s>", *w], w, strict=False):
            root = (one[b] if one[b] else v) / (n + v)
            c, t = (starts if a == "<s>" else one[a]), len(follow[a])
            score += math.log10((two[a, b] + t * root) / (c + t) if c else root)
        out.append((i, h, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def same(got, wanted):
    got = sorted(map(tuple, got), key=str)
    wanted = sorted(wanted, key=str)
    assert len(got) == len(wanted)
    for g, w in zip(sorted(got, key=lambda x: (str(x[:5]), x[6])), sorted(wanted, key=lambda x: (str(x[:5]), x[6])), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÀB", "x\xa0y"]
    rows = [(i, " ".join(rng.choice(vocabulary[: 1 + int(rng.paretovariate(1)) % 63]) for _ in range(rng.randrange(50)))) for i in range(400)]
    rows += [(900, None), (901, ""), (None, "w1 w2 new"), (3, rows[3][1]), (3, "w1\tw2\x0bw3"), (905, "only here " * 3000)]
    frame = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, block int, train boolean").repartition(5)
    monkeypatch.setattr(sharded, "ROWS", 16)
    same(backoff.score(frame, shared.crc_mod("doc_id", 10) == 0).collect(), brute(rows))


def test_whole_table_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = backoff.op1_lm_score(spark, sf).collect()
    same(got, brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_a_distribution(spark):
    """From any state the automaton's arcs sum to 1 over the known words and the unknown one."""
    rows = [(1, "a b a c"), (2, "b a b"), (4, "a a")]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    words = ["a", "b", "c", "unknown"]
    probe = [(10 + i, f"{s} {w}") for i, (s, w) in enumerate((s, w) for s in ("a", "c") for w in words)]
    frame = train.union(spark.createDataFrame(probe + [(90, "a"), (91, "c")], "doc_id long, text string"))
    score = {r.doc_id: r for r in backoff.score(frame, backoff.F.col("doc_id") >= 10).collect()}
    model = {r[0]: r for r in brute_with(rows, probe + [(90, "a"), (91, "c")])}
    for k, r in model.items():
        assert score[k].score == pytest.approx(r[1])


def brute_with(train, probe):
    one, two, follow = Counter(), Counter(), defaultdict(set)
    for _, t in train:
        w = [*t.split(), None]
        one.update(w)
        for a, b in zip(["<s>", *w], w, strict=False):
            two[a, b] += 1
            follow[a].add(b)
    n, v = sum(one.values()), len(one)

    def p(a, b):
        root = (one[b] if one[b] else v) / (n + v)
        c = len(train) if a == "<s>" else one[a]
        return (two[a, b] + len(follow[a]) * root) / (c + len(follow[a])) if c else root

    for a in ("a", "b", "<s>"):
        assert sum(p(a, b) for b in [*one, "unknown"]) == pytest.approx(1)
    return [(i, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t.split()], [*t.split(), None], strict=True))) for i, t in probe]


def test_empty(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert backoff.score(frame.limit(0), backoff.F.lit(False)).count() == 0
    none = backoff.score(frame, backoff.F.lit(True)).collect()
    assert [(r.train_tokens, r.n_known, r.score) for r in none] == [(0, 0, 0.0)] * 2 and all(abs(r.base_score) < 1e-9 for r in none)
