"""Imports every module that registers core queries."""

from arborlake.plans import evaluation_queries, hierarchy_queries, io_queries, ordered_queries, similarity_queries, text_queries, tree_queries  # noqa: F401
