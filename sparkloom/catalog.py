"""All registered queries of the engine, by name, with their SQL for comparison."""

from sparkloom.plans import chunk_queries, graph_queries, record_queries, text_queries
from sparkloom.streaming import retention, task_events

QUERIES: dict = text_queries.QUERIES | chunk_queries.QUERIES | graph_queries.QUERIES | record_queries.QUERIES | task_events.QUERIES | retention.QUERIES
ORACLE_SQL: dict = text_queries.ORACLE_SQL | chunk_queries.ORACLE_SQL | graph_queries.ORACLE_SQL | record_queries.ORACLE_SQL | task_events.ORACLE_SQL | retention.ORACLE_SQL
