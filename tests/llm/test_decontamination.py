from __future__ import annotations

import random
import re

from prescriva.llm import decontamination as d


def brute(docs, items, threshold=0.8):
    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    out = {}
    for doc_id, text in docs:
        own = shingles(text)
        for item_id, t in items:
            s = shingles(t)
            if s and len(own & s) >= threshold * len(s) - 1e-9:
                out[doc_id, item_id] = max(out.get((doc_id, item_id), 0), len(own & s))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["Élan", "ÜBER"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((3, 5, 9, 15, 40))))) for i in range(40)] + [(90, None), (91, "")]
    docs = []
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.randrange(60))
        item = rng.choice(items[:40])[1].split()
        for _ in range(rng.randrange(3)):
            item[rng.randrange(len(item))] = "changed" if rng.random() < 0.3 else item[0]
        at = rng.randrange(len(words) + 1)
        docs.append((i, ", ".join([*words[:at], *item, *words[at:]])))
    docs += [(200, None), (201, ""), (None, items[3][1]), (5, items[4][1]), (5, items[5][1]), (202, "x " * 20000 + items[4][1].upper())]
    frame = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, item_id int, hash string")
    bench = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, doc_id int")
    wanted = brute(docs, items)
    assert len(wanted) > 20
    for rows in (d.BROADCAST_BYTES, 0):
        assert {(r.doc_id, r.item_id): r.shared for r in d.contaminated(frame, bench, broadcast_bytes=rows).collect()} == wanted
    assert d.contaminated(frame.limit(0), bench).count() == 0 and d.contaminated(frame, bench.limit(0)).count() == 0


def test_clean_rows_of_a_contaminated_id_stay(spark):
    item, text = "one two three four five six seven eight", "none of this is in any item of the benchmark"
    rows = [(1, f"and {item} more", 1), (1, text, 2), (None, item, 3), (None, text, 4), (None, None, 5), (2, text, 6), (3, item, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    for most in (d.BROADCAST_BYTES, 0):
        got = d.clean(docs, bench, broadcast_bytes=most)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [r for r in rows if r[2] in (2, 4, 5, 6)]
