"""Generic reconciliation operators over any DataFrame, key columns and scope."""
