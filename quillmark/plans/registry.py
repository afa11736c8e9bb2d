"""All queries and their oracles, gathered from the query modules."""

from __future__ import annotations

from quillmark.plans import base, corpus, features, generation, metrics, models, relational, splits, streams, text  # noqa: F401


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
