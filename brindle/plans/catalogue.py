"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from brindle.plans import cleaning, evaluation, geometry, profiling, splitting  # noqa: F401  they register themselves
from brindle.plans.registry import QUERIES, SQL, Query
from brindle.session import ship

FLAGSHIP = "dedup_keep_largest"


def _shipped(q: Query) -> Query:
    def run(spark, sf_dir):
        ship(spark)
        return q(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(q) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
