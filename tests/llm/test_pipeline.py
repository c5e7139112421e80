from __future__ import annotations

import hashlib
import os
import re
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from prescriva.llm import language, pieces, toxicity  # noqa: E402

from .test_decontamination import brute as contained  # noqa: E402
from .test_models import naive_phrases  # noqa: E402
from .test_weighted_minhash import brute as groups  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_toxicity(cnn, text):
    """A text's score without batches: all windows of its words, one width after another."""
    words = re.findall(rb"[^\x00-/:-@\[-`{-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    z = cnn.weights["out_bias"][0]
    if words:
        x = np.array([sum(cnn.weights["embed"][b] for b in next(toxicity.bucket_runs(pa.array([w.decode(errors="surrogateescape")]), cnn.buckets))[0][0]) for w in words])
        for k, w in enumerate(toxicity.WIDTHS):
            padded = np.concatenate([x, np.zeros((w, cnn.dim))])
            windows = np.concatenate([padded[j : j + len(x)] for j in range(w)], axis=1)
            best = (windows @ cnn.weights[f"filter{w}"] + cnn.weights[f"bias{w}"]).max(axis=0)
            z += np.maximum(best, 0) @ cnn.weights["out"][k * cnn.filters : (k + 1) * cnn.filters]
    return 1 / (1 + np.exp(-z))


def test_stages_against_brute_force(spark, monkeypatch):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    model = toxicity.fit(docs, labels)
    limit = lambda r: model.thresholds.get(r.lang, model.common)
    scores = {i: plain_toxicity(model.cnn, r.text) for i, r in rows.items()}
    assert min(abs(s - limit(rows[i])) for i, s in scores.items()) > 1e-5  # none is so near that rounding decides
    flagged = {i for i, s in scores.items() if s >= limit(rows[i])}
    kept = [r for i, r in rows.items() if i not in flagged]
    samples, own = {}, language.LanguageModel.of
    monkeypatch.setattr(language.LanguageModel, "of", classmethod(lambda cls, given: samples.update(given) or own(given)))
    language.fit(spark.createDataFrame(kept, docs.schema))
    monkeypatch.undo()

    def stays(r):
        """Some learned language reads the text's letters in few phrases, or there are few of them."""
        read = language.letters(r.text or "")
        if not read:
            return False
        return len(r.text) < corpus_pipeline.LONG or any(100 * naive_phrases(read, s) / len(read) <= corpus_pipeline.MOST_PHRASES for s in (samples[k] for k in sorted(samples, key=lambda k: k != r.lang)))

    kept = [r for r in kept if stays(r)]
    heads = groups([(r.doc_id, r.text) for r in kept])
    kept = [r for r, h in zip(kept, heads, strict=True) if h[1] == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, _ in contained([(r.doc_id, r.text) for r in kept], items)}
    kept = [r for r in kept if r.doc_id not in dirty]
    assert 0 < len(flagged) < len(rows) / 3 and dirty and len(kept) > len(rows) / 2

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    wanted = sorted((r.doc_id, len(ids := sp.encode(r.text)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for r in kept)
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got.collect()) == wanted
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == columns


def test_odd_rows_and_no_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (1, "1 2 3 !", None, None, 3)], docs.schema)
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    docs.unionByName(odd).unionByName(odd).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    # Of the six odd rows those without a letter go as they have no language; no other document is touched by them.
    wanted = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=str)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == wanted
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
