"""Incremental runs over arriving files (an extension: the rule check itself is a batch)."""
