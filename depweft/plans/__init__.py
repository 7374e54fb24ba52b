"""Registered queries: each module offers ``queries()`` and ``oracle_sql()``."""
