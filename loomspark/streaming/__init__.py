"""Structured Streaming forms of the ledger and the monitor."""
