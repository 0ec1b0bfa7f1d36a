"""Ledger analytics on Spark: sources, operators, plans, functions and streams over updates, events and snapshots."""
