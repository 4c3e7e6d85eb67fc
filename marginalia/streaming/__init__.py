"""Structured Streaming jobs over the spend ledger and arriving generations."""
