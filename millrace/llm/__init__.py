"""Operators for building language-model training data at scale.

Nothing else in :mod:`millrace` imports this subpackage.  Each operator lives
in a module of its own; :mod:`millrace.llm.registry` holds the queries that
apply them to the test tables.
"""
