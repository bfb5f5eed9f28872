"""Pipelines, lineage and the command line."""
