"""The registered corpus queries and their SQL counterparts."""

from __future__ import annotations

import corpus_pipeline

from . import queries as corpus


def queries() -> dict:
    return {**corpus.QUERIES, "pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    found = dict(corpus.ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
