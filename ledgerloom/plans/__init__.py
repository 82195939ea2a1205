"""Registered queries: each with its Spark callable and, where SQL can say it, the same in SQL."""

#: Modules of this package that register queries.
MODULES = ("problems", "relational", "windows", "signals", "documentary", "company", "sources")
