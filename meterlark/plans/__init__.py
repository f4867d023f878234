"""Registry of the core's queries: one callable (spark, sf_dir) -> DataFrame each, with SQL where SQL can say it."""

from meterlark.plans import catalog, perf, rankings, text, usage

_PARTS = (usage, rankings, perf, catalog, text)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
