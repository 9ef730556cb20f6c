"""Substring dedup: remove every word of a 20-word window that also starts earlier in the corpus.

Corpus-wide, exact and linear in the input; see ``windows`` for the search and its
defined results. Contexts are streamed against suffix automata of the earlier ones of their shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from simplexa.llm.windows import remove_repeats

WINDOW_WORDS, GRAM_WORDS = 20, 6


def dedup(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """(doc_id, n_symbols, n_removed, n_spans, kept, kept_sha256) with words as symbols."""
    return remove_repeats(docs, window, gram, words=True, mode="later")
