"""Operators for preparing large text and media corpora.

Nothing else in the package imports this subpackage; it can be removed whole.
Each module holds one operator with its general interface; ``queries`` holds the
thin registered queries that derive digest columns from them.
"""
