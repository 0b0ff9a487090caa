"""Operators for preparing text corpora: one module each, plus the queries that apply them to whole tables.

Nothing outside this folder imports it, so it can be removed without touching the rest of the library.
"""
