"""Exact substring dedup on bytes: remove every byte of a 400-byte string that starts anywhere else too.

Corpus-wide, exact and linear in the input; see ``windows`` for the search and its
defined results. Repeats are read off a transform built column by column, one symbol of every context a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from simplexa.llm.windows import remove_repeats

LENGTH, GRAM = 400, 160


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_symbols, n_removed, n_spans, kept, kept_sha256) with UTF-8 bytes as symbols."""
    return remove_repeats(docs, length, gram, words=False, mode="any")
