"""All queries of this subpackage and of the pipeline built from it."""

from __future__ import annotations

from collections.abc import Callable

from storyloom.llm import (  # noqa: F401
    alignment, chat, decontaminate, embeddings, neural_lm, packing, pii, quality, sequence_files, simhash, toxicity, urls, vector_codes,
)
from storyloom.llm import registry


def queries() -> dict[str, Callable]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
