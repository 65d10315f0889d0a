"""All queries of the engine's own operators by name, and SQL for those that SQL can express."""

from tessel.plans import feature_queries, model_queries

QUERIES = feature_queries.QUERIES | model_queries.QUERIES
SQL = feature_queries.SQL | model_queries.SQL
