"""Schemas of the engine's tables."""

from __future__ import annotations

CHUNK = "chunk_id string, chunk_text string, metadata map<string,string>"
CHUNK_ROW = "file string, stem string, doc_ix int, pos int, " + CHUNK
PAGE = "file string, doc_ix int, text string, metadata map<string,string>, error string"
MANIFEST = "file string, hash string, n_chunks int, last_processed timestamp_ntz, chunk_method string"
VECTOR = "chunk_id string, vector array<float>, chunk_text string, metadata map<string,string>"
HIT = "rank int, chunk_id string, source string, distance double"
CONTEXT_FIELDS = ["chunk_id", "chunk_text", "source", "doi", "title", "author", "journal", "year", "keywords"]
MESSAGES = "array<struct<role: string, content: string>>"
SUMMARY = "summary string, processing_time string, tokens bigint"
