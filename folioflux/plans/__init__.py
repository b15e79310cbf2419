"""Whole pipelines: build, retrieve, ask."""
