"""Incremental revisions. The domain has no stream of its own; this keeps a revision log and its latest state up to date."""
