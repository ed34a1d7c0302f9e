"""Training-data operators: quality, tokens, dedup, scoring, audits.

Nothing outside this subpackage imports it; ``queries.py`` in here registers
its queries and SQL, and ``__spark_entry__.py`` adds them when it can.
"""
