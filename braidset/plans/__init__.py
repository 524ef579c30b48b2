"""The reconciliation plans: analyze, finalize, clean up, check, validate, report."""
