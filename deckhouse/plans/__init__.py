"""Queries composed of the operators.

They are registered here and not by one of the modules, so that any module can be imported first: a Python worker begins with the one
that holds its function.
"""

from . import content_queries, lineage_queries, package_queries, queries, run_queries, source_queries  # noqa: F401 (register their queries)
