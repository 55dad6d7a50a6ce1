"""All queries of the library by name, with the SQL that each is compared with."""

from __future__ import annotations

from tessera.plans import more, relational, retrieval, search, services, stateful, states, text  # noqa: F401  (each module registers its queries)
from tessera.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
