"""Relational, temporal, interval, similarity and curation operators."""
