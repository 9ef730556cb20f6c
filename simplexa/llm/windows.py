"""Repeated windows of k symbols (bytes or words), found exactly without pairs or hot tasks.

Every window of k symbols is keyed by the inner gram with the smallest hash (its top
33 bits; the leftmost among equals), its anchor. Runs of consecutive windows with one such
place make a context (about two in each k - gram symbols; no window occurs twice in it):

* Contexts are counted, after a sum for each chunk of texts; those that occur twice or
  more settle all their windows at once, however many copies there are (the join back may
  be skew-split).
* Different contexts with one anchor are routed to a task once each, whatever their number
  of copies, and compared symbol by symbol by a kernel of ``repeats`` on shards of bounded
  size. An anchor of over CROWD different contexts is split by the symbols next to it: of
  those beside the anchor, a window has half or more on one side, so a context goes to
  the tasks of its left and of its right side.

Equal (anchor, context) hashes of 64 bits each are taken as equal contexts; no other
decision rests on a hash. ``mode`` says what is removed: "any" takes every window that
starts anywhere else too, "later" all but the first in (doc_id, row, start) order. A row's
text never leaves its row; a null text has no symbols; a null doc_id sorts first; repeated
rows count as separate documents; other columns are dropped. Rows are numbered by
``monotonically_increasing_id``, so ``docs`` must read alike each time it is read (tables do).

Bounds: an Arrow batch of texts, the spans of one document, and SHARD symbols of contexts
(or one group) per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simplexa.llm.common import _BYTE, WHITE, Words, cover, discard, materialise, mix, powers, spans_of, text_chunks
from simplexa.llm.repeats import columns, earlier

_CONTEXTS = "g long, c long, n long, d long, row long, lo int, hi int"
_PLACE, _PLACES = np.uint64(31), np.uint64((1 << 31) - 1)
_LENGTH = np.uint64(0x9FB21C651E98DF25)
#: Different contexts of an anchor that go to one task; symbols that a kernel takes at once, about.
CROWD, SHARD = 4096, 1 << 22


class Symbols:
    """Symbols of a chunk of texts, the row bounds among them, and hashes of any stretch."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, words: bool) -> None:
        if words:
            found = Words(buf, offsets, WHITE)
            self.starts, self.ends, self.first, sym = found.starts, found.ends, found.first, found.hashes
        else:
            self.first, sym = offsets, _BYTE[buf]
        self.n = len(sym)
        self.power, self.inverse = powers(self.n)
        self.p = np.zeros(self.n + 1, np.uint64)
        np.cumsum(sym * self.power[: self.n], out=self.p[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.p[end] - self.p[start]) * self.inverse[start])

    def every(self, k: int) -> np.ndarray:
        """Hash of the k symbols from each on."""
        return mix((self.p[k:] - self.p[: self.n - k + 1]) * self.inverse[: self.n - k + 1])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def _contexts(k: int, gram: int, words: bool, counted: bool):
    """(row, doc_id, text) -> every context, or each chunk's different ones with their number and first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = batch.column(0).to_numpy(), batch.column(1).fill_null(-(1 << 63)).to_numpy()
            for a, b, buf, off in text_chunks(batch.column(2)):
                s = Symbols(buf, off, words)
                if s.n < k:
                    continue
                grams = s.every(gram)
                packed = grams >> _PLACE << _PLACE | np.arange(len(grams), dtype=np.uint64)
                least = (_sliding_min(packed, k - gram + 1) & _PLACES).astype(np.int64)  # leftmost among equals
                owner = np.repeat(np.arange(b - a), np.diff(s.first))
                at = np.arange(len(least))
                inside = at + k <= s.first[1:][owner[: len(least)]]
                at = at[inside]
                if not len(at):
                    continue
                least, own = least[at], owner[at]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
                lo_i = np.flatnonzero(fresh)
                hi_i = np.append(lo_i[1:], len(at)) - 1
                lo, hi, own = at[lo_i], at[hi_i], own[lo_i]
                c = mix(s.hash(lo, hi + k) + (hi - lo).astype(np.uint64) * _LENGTH).view(np.int64)
                g, base, n = grams[least[lo_i]].view(np.int64), s.first[own], np.ones(len(lo), np.int64)
                d, row, lo, hi = ids[own + a], rows[own + a], lo - base, hi - base
                if counted:
                    order = np.lexsort((lo, row, d, c, g))
                    new = np.flatnonzero(np.concatenate(([True], (np.diff(g[order]) != 0) | (np.diff(c[order]) != 0))))
                    n = np.diff(np.append(new, len(order)))
                    g, c, d, row, lo, hi = (x[order[new]] for x in (g, c, d, row, lo, hi))
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), pa.array(n), pa.array(d), pa.array(row), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["g", "c", "n", "d", "row", "lo", "hi"])

    return run


_CONTENTS = "route long, d long, row long, lo int, n long, anchor int, x binary"


def _contents(k: int, gram: int, words: bool, crowd: int):
    """(row, text, spans of struct(g, d, lo, hi, n, m)) -> the contexts' symbols, once or for each side of a crowded anchor."""
    side = -(-(k - gram) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            at = 0
            for _, _, buf, off in text_chunks(batch.column(1)):
                s, raw = Symbols(buf, off, words), buf.tobytes()
                grams = s.every(gram) if s.n >= gram else np.zeros(0, np.uint64)
                out: tuple[list, ...] = ([], [], [], [], [], [], [])
                for i in range(len(off) - 1):
                    row, base = batch.column(0)[at].as_py(), int(s.first[i])
                    for x in spans[at].as_py():
                        lo, hi = base + x["lo"], base + x["hi"]
                        anchor = lo + int(np.argmax(grams[lo : hi + k - gram + 1].view(np.int64) == x["g"]))
                        cut = raw[int(s.starts[lo]) : int(s.ends[hi + k - 1])] if words else raw[lo : hi + k]
                        routes = [x["g"]]
                        if x["m"] > crowd:
                            ends = [(anchor - side, anchor + gram)] * (anchor - side >= lo) + [(anchor, anchor + gram + side)] * (anchor + gram + side <= hi + k)
                            routes = [int((s.hash(np.array([y]), np.array([z])) + np.uint64(y < anchor)).view(np.int64)[0]) for y, z in ends]
                        for route in routes:
                            for column, value in zip(out, (route, x["d"], row, x["lo"], x["n"], anchor - lo, cut), strict=True):
                                column.append(value)
                    at += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["route", "d", "row", "lo", "n", "anchor", "x"])

    return run


def _compared(k: int, words: bool, mode: str, shard: int):
    """Contexts sorted by route and place -> (row, s, e) of what goes, whole routes at a time."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows * 64 + batch.column(6).nbytes
            if size > shard:
                whole = pa.Table.from_batches(held)
                route = whole.column(0).to_numpy()
                last = int(np.searchsorted(route, route[-1]))  # the last route may go on
                if last:
                    yield whole.slice(0, last)
                    held = whole.slice(last).to_batches()
                    size = sum(x.num_rows * 64 + x.column(6).nbytes for x in held)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shards(batches):
            route, row, lo, n, anchor = (part.column(i).to_numpy() for i in (0, 2, 3, 4, 5))
            groups = np.cumsum(np.concatenate(([False], route[1:] != route[:-1])))
            raw = part.column(6).to_pylist()
            if mode == "later":
                who, at = earlier(groups, [x.split() if words else list(x) for x in raw], k)
            else:
                names: dict[bytes, int] = {}
                symbols = [np.array([names.setdefault(y, len(names)) for y in x.split()], np.int32) if words else np.frombuffer(x, np.uint8) for x in raw]
                who, at = _pieces(groups, symbols, anchor, k, shard)
                who, at = who[n[who] == 1], at[n[who] == 1]  # the others go as a whole
            order = np.lexsort((at, who))
            who, at = who[order], at[order]
            begin = np.flatnonzero(np.concatenate(([True], (np.diff(who) != 0) | (np.diff(at) > 1)))) if len(who) else who
            end = np.append(begin[1:], len(who)) - 1 if len(who) else who
            yield pa.RecordBatch.from_arrays([pa.array(row[who[begin]]), pa.array((lo[who[begin]] + at[begin]).astype(np.int32)), pa.array((lo[who[end]] + at[end] + k).astype(np.int32))], names=["row", "s", "e"])

    return run


def _pieces(groups: np.ndarray, symbols: list, anchors: np.ndarray, k: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """``columns`` on whole groups of about ``shard`` symbols."""
    ends = [*np.flatnonzero(np.diff(groups)) + 1, len(groups)]
    sizes = np.cumsum([len(x) for x in symbols])
    who, at, a = [], [], 0
    for i, b in enumerate(ends):
        if i + 1 < len(ends) and sizes[ends[i + 1] - 1] - (sizes[a - 1] if a else 0) <= shard // 4:
            continue
        x, y = columns(groups[a:b] - groups[a], symbols[a:b], anchors[a:b].astype(np.int64), k)
        who.append(x + a)
        at.append(y)
        a = b
    return np.concatenate(who), np.concatenate(at)


def numbered(docs: DataFrame, *carry: str) -> DataFrame:
    """(row, doc_id, text, columns to carry): the row number tells repeated documents apart."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)


def repeated(rows: DataFrame, k: int, gram: int, words: bool, mode: str) -> DataFrame:
    """(row, spans): symbols s to e - 1 of each span (s, e) of the row are to go; spans may overlap."""
    each = rows.mapInArrow(_contexts(k, gram, words, counted=True), _CONTEXTS).repartition("g")
    gc = each.groupBy("g", "c").agg(F.sum("n").alias("n"), F.min(F.struct("d", "row", "lo", "hi")).alias("rep"))
    gc = gc.withColumn("m", F.count("*").over(Window.partitionBy("g"))).where("n > 1 or m > 1").select("g", "c", "n", "m", "rep.*")
    gc = materialise(gc, "context-classes")
    ctx = rows.mapInArrow(_contexts(k, gram, words, counted=False), _CONTEXTS).select("g", "c", "row", "lo", "hi")
    again = gc.where("n > 1").select("g", "c", F.col("row").alias("r0"), F.col("lo").alias("l0"))
    whole = ctx.join(again, ["g", "c"])
    if mode == "later":
        whole = whole.where("row != r0 or lo != l0")
    whole = materialise(whole.select("row", F.col("lo").alias("s"), (F.col("hi") + k).alias("e")), "whole-contexts")
    asked = gc.where("m > 1").groupBy("row").agg(F.collect_list(F.struct("g", "d", "lo", "hi", "n", "m")).alias("spans"))
    fine = rows.select("row", "text").join(asked, "row").select("row", "text", "spans").mapInArrow(_contents(k, gram, words, CROWD), _CONTENTS)
    fine = fine.repartition("route").sortWithinPartitions("route", "d", "row", "lo").mapInArrow(_compared(k, words, mode, SHARD), "row long, s int, e int")
    spans = materialise(whole.unionByName(fine).groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    discard(gc, whole)
    return spans


def _digest(words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            spans = batch.column(2)
            at = 0
            for _, _, buf, off in text_chunks(batch.column(1)):
                found = Symbols(buf, off, words)
                raw = buf.tobytes()
                for i in range(len(off) - 1):
                    first, last = int(found.first[i]), int(found.first[i + 1])
                    flat = spans[at]
                    mask = np.zeros(last - first, bool)
                    if flat.is_valid and len(flat):
                        s, e = flat.values.flatten()
                        mask = cover(last - first, s.to_numpy(), e.to_numpy())
                    keep = np.flatnonzero(~mask)
                    if words:
                        kept = b" ".join([raw[x:y] for x, y in zip(found.starts[first + keep].tolist(), found.ends[first + keep].tolist(), strict=True)])
                    else:
                        kept = buf[first + keep].tobytes()
                    for column, x in zip(out, (last - first, int(mask.sum()), len(spans_of(mask)[0]), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                        column.append(x)
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary()), pa.array(out[4], pa.string())], names=["doc_id", "n_symbols", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, k: int, gram: int, words: bool, mode: str) -> DataFrame:
    """(doc_id, n_symbols, n_removed, n_spans, kept, kept_sha256), a row a document; ``kept`` is UTF-8 bytes."""
    rows = numbered(docs)
    spans = repeated(rows, k, gram, words, mode)
    joined = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_digest(words), "doc_id long, n_symbols long, n_removed long, n_spans long, kept binary, kept_sha256 string")
