from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from prescriva.llm import divergence

OF = "doc_id long, text string, lang string, source string, i int, term string, n long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lower(text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        p = {}
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                n = sum(counts[g][t] for t in kept)
                p[g[1]] = {t: 1 + 10**9 * (counts[g][t] + 5) // (n + 5 * v) for t in kept}
                whole.update({t: counts[g][t] for t in kept})
        total = sum(whole.values())
        q = {t: 1 + 10**9 * (whole[t] + 5) // (total + 5 * v) for t in kept}
        for s in p:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def check(spark, rows, least=3, top=5, parts=3):
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], OF).repartition(parts)
    got = sorted(map(tuple, divergence.audit(docs, least, top).collect()))
    assert got == brute(rows, least, top)
    return got


def test_heavy_and_light_terms_over_several_tiles(spark):
    """More sources than a tile's side; terms in nearly all, in some and in few of them."""
    rng = random.Random(5)
    common, some, rare = ([f"{c}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)] for c, n in (("c", 30), ("s", 60), ("r", 300)))
    rows = []
    for i in range(1400):
        s = int(150 * rng.random() ** 2)
        words = rng.choices(common, k=rng.randint(0, 20)) + rng.choices(some[s % 7 :: 7], k=5) + rng.choices(rare[s * 2 : s * 2 + 9] or rare[:2], k=rng.randint(0, 6))
        rows.append((i, " ".join(words), rng.choice(["en", "en", "de"]), f"src{s}"))
    got = check(spark, rows)
    assert len({r[1] for r in got if r[0] == "en"}) > 2 * divergence.SIDE


def test_a_batch_of_heavy_rows_that_is_cut_within_a_term(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(divergence.shared, "small_batches", lambda spark: None)
    rows = [(i, f"a b{'xyz'[i % 3]} c{'uvw'[i % 7 % 3]} {'Zz' * (i % 3)} É{i % 2}", "en", f"s{i % 11}") for i in range(200)]
    try:
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nulls_empty_and_very_long_texts(spark):
    odd = [(1, None, None, None), (1, None, None, None), (None, "", "en", "a"), (2, "...", "en", "b"), (3, "One one ONE é É", "en", "b"), (4, "one " * 50_000, "en", "c"), (5, "x" * 300_000, "en", ""), (6, "one", "", ""), (7, "lone", "zz", "z")]
    check(spark, odd, least=1)
    check(spark, odd, least=2)
    check(spark, odd, least=99)  # no term is kept: pairs of 0
    assert divergence.audit(spark.createDataFrame([], OF)).collect() == []
