"""The registered queries and their SQL."""

from millrace.plans import chat_queries, entity_queries, flow_queries, model_queries, session_queries, store_queries, text_queries, vector_queries

_MODULES = (text_queries, vector_queries, entity_queries, session_queries, flow_queries, chat_queries, store_queries, model_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
