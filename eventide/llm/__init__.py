"""Operators on training text: scoring, de-duplication, filtering, formatting, tokenisation.

Each module holds one operator with its own interface; :mod:`eventide.llm.queries`
registers one query for each over the given tables.  Nothing outside this
folder imports it.
"""
