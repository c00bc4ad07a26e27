"""Training-data operators: tokenising, deduplication, scoring, packing, archives and vector search.

Nothing outside this subpackage imports it; `queries.py` holds the query per operator.
"""
