"""Whole jobs: ingest, link, analyze, report; and the queries over the given tables."""
