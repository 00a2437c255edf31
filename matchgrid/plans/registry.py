"""Name -> query and name -> oracle SQL of the match engine."""

from __future__ import annotations

from matchgrid.plans import extra_queries, market_queries, model_queries, more_queries, profile_queries, source_queries, sql_queries, team_queries

_ALL = market_queries.QUERIES | profile_queries.QUERIES | more_queries.QUERIES | team_queries.QUERIES | extra_queries.QUERIES | model_queries.QUERIES | sql_queries.QUERIES | source_queries.QUERIES

QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {k: sql for k, (_, sql) in _ALL.items() if sql}
