"""Operators on tables: chunk rules, splitting and merging, deduplication, embedding, retrieval, reports."""
