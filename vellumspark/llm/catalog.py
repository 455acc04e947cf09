"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import decontaminate, hard_negatives, jaccard, language, licenses, mixing, near_embeddings, resampling, secrets, surrogates, token_files, topk, toxicity


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    name: _shipped(query)
    for name, query in {
        "op1_token_files": token_files.op1_token_files,
        "op2_language": language.op2_language,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_surrogates": surrogates.op4_surrogates,
        "op5_jaccard": jaccard.op5_jaccard,
        "op6_secrets": secrets.op6_secrets,
        "op7_mixing": mixing.op7_mixing,
        "op8_licenses": licenses.op8_licenses,
        "op9_topk": topk.op9_topk,
        "op10_contamination": decontaminate.op10_contamination,
        "op11_resampling": resampling.op11_resampling,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_near_embeddings": near_embeddings.op13_near_embeddings,
    }.items()
}
ORACLES = {
    "op6_secrets": secrets.ORACLE,
    "op8_licenses": licenses.ORACLE,
    "op9_topk": topk.ORACLE,
    "op10_contamination": decontaminate.ORACLE,
    "op11_resampling": resampling.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_near_embeddings": near_embeddings.ORACLE,
}
