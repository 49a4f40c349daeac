"""Commit streams, observers and incremental views."""
