"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from varloom.llm import chat_format, decontaminate, html_extract, knn_join, language_id, license_scan, line_dedup, pii, sentencepiece_sampling, simhash_dedup, source_audit, turn_reassembly, url_filter

MODULES = (line_dedup, chat_format, pii, html_extract, knn_join, language_id, sentencepiece_sampling, decontaminate, url_filter, simhash_dedup, license_scan, source_audit, turn_reassembly)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
