"""Ledger views over the driver tables, and the registered queries."""


def all_queries() -> tuple[dict, dict]:
    """(queries by name, SQL by name)."""
    from . import core, feeds, ledger, methods, receipt_items, receipts, text  # noqa: F401
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
