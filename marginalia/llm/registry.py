"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from marginalia.llm.queries import ORACLES, QUERIES

QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}
ORACLES = {**ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
