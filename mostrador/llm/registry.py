"""Names of the queries of this package, the pipeline among them."""

from __future__ import annotations

import corpus_pipeline
from mostrador.llm.queries import ORACLE_SQL, QUERIES


def queries() -> dict:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
