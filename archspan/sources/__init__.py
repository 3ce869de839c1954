"""Readers and writers of source trees, rule files, traces and reports."""
