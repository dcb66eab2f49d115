"""All named queries of the engine (outside textloom.llm) and the SQL that says the same."""

from __future__ import annotations

from . import measures, texts, tokens

QUERIES = texts.QUERIES | tokens.QUERIES | measures.QUERIES
ORACLES = texts.ORACLES | tokens.ORACLES | measures.ORACLES
