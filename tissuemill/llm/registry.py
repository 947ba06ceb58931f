"""Queries and SQL of the training-data operators, and of the corpus pipeline."""

from __future__ import annotations

import corpus_pipeline

from .fingerprints import op10_fingerprints
from .licenses import OP8_SQL, op8_licenses
from .mixing import OP6_SQL, op6_mixing
from .near_dups import OP5_SQL, op5_near_dups
from .quality import op3_quality
from .secrets import op9_secrets
from .sentencepiece_codec import op1_sentencepiece
from .token_store import op4_token_store
from .topk_search import OP2_SQL, op2_topk_search
from .url_filter import op7_url_filter

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_topk_search": op2_topk_search,
    "op3_quality": op3_quality,
    "op4_token_store": op4_token_store,
    "op5_near_dups": op5_near_dups,
    "op6_mixing": op6_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_fingerprints": op10_fingerprints,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {"op2_topk_search": OP2_SQL, "op5_near_dups": OP5_SQL, "op6_mixing": OP6_SQL, "op8_licenses": OP8_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
