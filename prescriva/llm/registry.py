"""Queries of this subpackage, by name, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prescriva.llm import decontamination, divergence, merkle, sharding
from prescriva.llm.backoff import op1_lm_score
from prescriva.llm.binary_ids import op4_token_ids
from prescriva.llm.decontamination import op7_decontamination
from prescriva.llm.divergence import op12_divergence
from prescriva.llm.language import op6_language
from prescriva.llm.lattice import op10_embeddings
from prescriva.llm.merkle import op13_manifest
from prescriva.llm.pieces import op5_sentencepiece
from prescriva.llm.quality import op3_quality
from prescriva.llm.sharding import op11_sharding
from prescriva.llm.toxicity import op2_toxicity
from prescriva.llm.warc import op9_warc
from prescriva.llm.weighted_minhash import op8_near_duplicates

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_toxicity": op2_toxicity,
        "op3_quality": op3_quality,
        "op4_token_ids": op4_token_ids,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_language": op6_language,
        "op7_decontamination": op7_decontamination,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_warc": op9_warc,
        "op10_embeddings": op10_embeddings,
        "op11_sharding": op11_sharding,
        "op12_divergence": op12_divergence,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_decontamination": decontamination.SQL,
        "op11_sharding": sharding.SQL,
        "op12_divergence": divergence.SQL,
        "op13_manifest": merkle.SQL,
    }
