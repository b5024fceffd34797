"""Queries and DuckDB SQL of all operators of this subpackage, and of the pipeline."""

from __future__ import annotations

import corpus_pipeline
from tonekit.llm import (chat, license_scan, mixing, near_dup, packing, quality_model, quality_rules, runs, secret_scan,
                         token_output, topk, warc, whitening)

MODULES = (mixing, secret_scan, token_output, near_dup, packing, quality_model, topk, quality_rules, chat, warc, whitening, runs, license_scan)

QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
