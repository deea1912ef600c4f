"""Changelogs to nested documents on Spark: changes, lookups and nesting, in batch and in streams."""
