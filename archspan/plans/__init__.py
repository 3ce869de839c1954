"""Registered queries, their SQL and the rule-check plan."""
