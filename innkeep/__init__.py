"""innkeep: lodging analytics (customers, bookings, invoices) on Spark DataFrames.

Layout
------
``innkeep.schemas``     StructTypes of the stored documents.
``innkeep.functions``   Column -> Column helpers (periods, money, rooms, taxes, text).
``innkeep.sources``     readers/writers, the TPC-H derived model, legacy CSV, backup.
``innkeep.operators``   DataFrame -> DataFrame business operators.
``innkeep.plans``       registered queries (Spark) and their DuckDB oracle SQL.
``innkeep.streaming``   the change-propagation job as a Structured Streaming query.
``innkeep.api``         ``Lodging``: the stored tables and the business questions as methods.
"""

from innkeep.session import get_session, scratch_root


def __getattr__(name):
    if name == "Lodging":          # imported on first use
        from innkeep.api import Lodging
        return Lodging
    raise AttributeError(name)


__all__ = ["Lodging", "get_session", "scratch_root"]
