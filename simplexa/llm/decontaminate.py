"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

Texts and items are lower-cased (A-Z only) and cut into words of digits, a-z and
non-ASCII characters. A pattern is every run of ``window`` consecutive item words
(a shorter item is one pattern). The automaton is built once per Python worker
from the broadcast patterns and scans each normalised text once; match offsets
are mapped back to word numbers and to character offsets of the original text.

Broadcast bound: the patterns must weigh no more than ``max_pattern_bytes``. A
larger benchmark is cut into groups of items below that bound, each of which gets
its own automaton and its own scan, and the per-document results are merged; the
documents are never shuffled and the driver holds the benchmark only.

Defined results: null or empty text has no words and no hits; an item without
words (or null text or id) matches nothing; repeated documents each get their own
row; several items may share a window and all of them are named; an empty
benchmark leaves every document clean; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.llm.common import LOWER, NON_ALNUM, by_id

_NORMALISE = bytes(0x20 if NON_ALNUM[LOWER[b]] else LOWER[b] for b in range(256))
_built: dict[bytes, ahocorasick.Automaton] = {}

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<begin:int,end:int>>"


def normalise(text: str | bytes | None) -> list[bytes]:
    """The words of a text, as UTF-8 bytes."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_NORMALISE).split()


def patterns_of(items: list[tuple[str, str]], window: int) -> dict[bytes, tuple[int, list[str]]]:
    """Pattern -> (its number of words, the ids of the items that hold it)."""
    out: dict[bytes, tuple[int, list[str]]] = {}
    for item_id, text in items:
        words = normalise(text)
        if not words:
            continue
        k = min(window, len(words))
        for i in range(len(words) - k + 1):
            held = out.setdefault(b" ".join(words[i : i + k]), (k, []))[1]
            if item_id not in held:
                held.append(item_id)
    return out


def automaton(patterns: dict[bytes, tuple[int, list[str]]]) -> ahocorasick.Automaton:
    """Keys are framed by blanks, so a match is of whole words; one character a byte (Latin-1)."""
    a = ahocorasick.Automaton()
    for p, (k, ids) in patterns.items():
        a.add_word(f" {p.decode('latin-1')} ", (len(p), k, ids))
    if patterns:
        a.make_automaton()
    return a


def scan(a: ahocorasick.Automaton, text: bytes) -> tuple[int, int, list[str], list[tuple[int, int]]]:
    """Words, hit words, sorted item ids, and the merged hit runs as (first word, last word + 1)."""
    words = text.translate(_NORMALISE).split()
    if not words or not len(a):
        return len(words), 0, [], []
    line = f" {b' '.join(words).decode('latin-1')} "
    ids: set[str] = set()
    runs: list[list[int]] = []
    counted, upto = 0, 0  # blanks before `upto`
    for end, (size, k, found) in a.iter(line):
        begin = end - size - 1  # the blank before the match
        counted += line.count(" ", upto, begin) if begin >= upto else -line.count(" ", begin, upto)
        upto = begin
        ids.update(found)
        runs.append([counted, counted + k])
    runs.sort()
    merged: list[list[int]] = []
    for b, e in runs:
        if merged and b <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([b, e])
    return len(words), sum(e - b for b, e in merged), sorted(ids), [(b, e) for b, e in merged]


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs as character offsets of the original text."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    lead = [i for i, b in enumerate(text) if b & 0xC0 != 0x80]  # byte offset of each character
    char = lambda byte: bisect_right(lead, byte) - 1
    return [(char(at[b][0]), char(at[e - 1][1] - 1) + 1) for b, e in runs]


def scanner(window: int, items: list[tuple[str, str]]):
    """A mapInArrow function over (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha1(repr((window, items)).encode()).digest()
        if key not in _built:
            _built.clear()
            _built[key] = automaton(patterns_of(items, window))
        a = _built[key]
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                n, hit, ids, runs = scan(a, text or b"")
                out.append((n, hit, ids, [{"begin": b, "end": e} for b, e in original_spans(text or b"", runs)]))
            n, hit, ids, spans = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array(ids, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, max_pattern_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated), a row a document.

    ``spans`` are the hit runs as character offsets of the original text.
    """
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    weight = rows.agg(F.coalesce(F.sum(F.octet_length("text") * F.lit(window)), F.lit(0))).first()[0]
    groups = max(1, -(-int(weight) // max_pattern_bytes))
    slim = by_id(docs)
    if groups == 1:
        items = sorted((r[0], r[1]) for r in rows.collect())
        out = slim.mapInArrow(scanner(window, items), SCHEMA)
    else:  # a benchmark over the bound: one bounded automaton after the other, results merged by document
        numbered = slim.withColumn("row", F.monotonically_increasing_id())
        parts = None
        for g in range(groups):
            own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
            items = sorted((r[0], r[1]) for r in own.collect())
            part = numbered.select(F.col("row").alias("doc_id"), "text").mapInArrow(scanner(window, items), SCHEMA)
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.collect_list("n_hit").alias("hits"))
        # runs of different groups may overlap: words are counted again from the merged spans
        merged = merged.withColumnRenamed("doc_id", "row").join(numbered, "row")
        out = merged.mapInArrow(_recount, SCHEMA)
    return out.withColumn("contaminated", F.size("items") >= min_items)


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            merged: list[list[int]] = []
            for s in r["spans"]:
                if merged and s["begin"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["end"])
                else:
                    merged.append([s["begin"], s["end"]])
            text = r["text"] or ""
            spans = []
            for b, e in merged:
                if spans and not normalise(text[spans[-1]["end"] : b]):
                    spans[-1]["end"] = e
                else:
                    spans.append({"begin": b, "end": e})
            hit = sum(len(normalise(text[s["begin"] : s["end"]])) for s in spans)
            rows.append({"doc_id": r["doc_id"], "n_words": r["n_words"], "n_hit": hit, "items": r["items"], "spans": spans})
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")
