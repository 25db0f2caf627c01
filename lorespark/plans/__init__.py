"""Whole flows: ingest, review, cards, deep cleaning; and the registered queries."""
