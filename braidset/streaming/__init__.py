"""Incremental reconciliation of late snapshots."""
