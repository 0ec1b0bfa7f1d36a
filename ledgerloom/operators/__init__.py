"""Ledger operators: plain DataFrame -> DataFrame functions, lazy and pure; the clock is always a parameter."""
