"""Shared-expense and multi-currency ledger analytics on Spark."""
