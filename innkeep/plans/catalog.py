"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with oracle SQL.

Every query reads the whole derived model (or the raw tables) of ``sf_dir``;
parameters such as the statistics month or the agenda day are fixed values of
the report, not row filters to keep checks cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from innkeep.plans import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MODULES = ["q_stats", "q_stays", "q_search", "q_invoices", "q_migration", "q_quality", "q_exports"]

# Report parameters shared by the Spark queries and their oracle SQL.
STAT_MONTH = "1997-02-01"
STAT_MONTH_END = "1997-02-28"
AGENDA_DAY = "1997-02-14"
INVOICE_DATE = "2001-09-01"


def register(name: str, oracle_body: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle_body is not None:
            oracle.register(name, oracle_body)
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib
    for mod in MODULES:
        importlib.import_module(f"innkeep.plans.{mod}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return {k: v for k, v in oracle.ORACLE.items() if k in QUERIES}
