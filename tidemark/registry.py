"""The registered queries: name -> DataFrame function, and the same query as DuckDB SQL."""

from __future__ import annotations

from tidemark.plans import more, numeric, queries  # noqa: F401 (modules register their queries)

QUERIES: dict = {**queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**queries.ORACLE_SQL}
