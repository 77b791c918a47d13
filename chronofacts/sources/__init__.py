"""Readers, writers and artefact catalogues."""
