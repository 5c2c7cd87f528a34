"""Incremental folds driven by foreachBatch."""
