"""Imports every module that registers queries."""

from tessera.plans import q_code, q_compaction, q_debug, q_documents, q_events, q_frontend, q_graph, q_more, q_project, q_ranking, q_storage, q_vectors  # noqa: F401
