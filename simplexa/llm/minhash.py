"""MinHash near-dedup by min-max hashing: each permutation gives its minimum and its maximum.

Texts are lower-cased (A-Z), cut into white-space words and shingled by five words;
documents with one shingle set form a class. ``permutations`` hash evaluations give
2 * permutations signature values; bands of ``rows_per_band`` values are the keys of
candidate search. With 80 permutations and bands of 4, a pair at the threshold is
missed with probability (1 - 0.75**4)**40 < 3e-7.

No group is expanded into pairs: in each round a class is compared with one centre
of its buckets (that with the most alike signature), components grow by the confirmed links, and buckets of one component
are closed; a pair whose signatures of SCREEN permutations agree in far fewer places than
at the threshold (5.5 standard deviations: a pair at the threshold is lost with probability
below 1e-7) gets no comparison in these rounds. At the end the classes that still share open
buckets, directly or through others, form a family. Families go whole, in blocks of bounded
size, to tasks that count the overlaps of their members' full sets by an inverted index:
no pair is a row, and a task gives the links that join its components, fewer than its
members. All links are confirmed on full sets.

Defined results: a text without words has an empty set and no links; one with fewer
words than five has the whole sequence as its one shingle; a null doc_id takes part
and sorts last as a component id; repeated rows belong to one class, and each row whose
doc_id is the component's id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexa.llm.common import LOWER, WHITE, Words, discard, gram_hash, materialise, mix, released, text_chunks
from simplexa.llm.graph import components
from simplexa.llm.windows import numbered

SHINGLE, PERCENT, PERMUTATIONS, ROWS_PER_BAND = 5, 75, 80, 4
#: Classes (16 bytes each) whose texts are fetched by a broadcast of their rows.
BROADCAST_ROWS = 1 << 19
#: Shingles of a block of a family, about: a task of the exhaustive round holds two blocks.
BLOCK = 1 << 19
#: Permutations of the screen; the first PERMUTATIONS are those of the bands.
SCREEN = 160
#: Star rounds before the exhaustive one, while that one would cost more than CROSS_FACTOR comparisons a posting.
STARS, CROSS_FACTOR = 3, 4
#: Bits kept of each signature value, and how far below the threshold a pair's agreement may lie to be confirmed.
PLANES, DEVIATIONS = 4, 5.5


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, _, buf, off in text_chunks(column):
        w = Words(buf, off, WHITE, LOWER)
        grams = w.grams(k)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            yield np.unique(grams[a : b - k + 1]) if b - a >= k else gram_hash(w.hashes[a:b], b - a) if b > a else grams[:0]


def _min_max(x: np.ndarray, mul: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest of x under each permutation, some permutations at a time."""
    low, high = np.empty(len(mul), np.uint64), np.empty(len(mul), np.uint64)
    step = max(1, (1 << 15) // len(x))
    for i in range(0, len(mul), step):
        m = mul[i : i + step, None]
        y = x ^ add[i : i + step, None]
        y *= m
        y ^= y >> np.uint64(32)
        y *= m
        low[i : i + step], high[i : i + step] = y.min(1), y.max(1)
    return low, high


def _signatures(k: int, permutations: int, rows: int, screen: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        rng = np.random.Generator(np.random.PCG64(7))
        mul = rng.integers(1, 1 << 63, screen, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(1, 1 << 63, screen, dtype=np.uint64)
        bands = 2 * permutations // rows
        for batch in batches:
            n, c, keys, bits = [], [], [], []
            for x in _sets(batch.column(2), k):
                n.append(len(x))
                c.append(xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63))
                if not len(x):
                    keys.append([])
                    bits.append([])
                    continue
                low, high = _min_max(x, mul, add)
                sig = np.concatenate((low[:permutations], high[:permutations]))[: bands * rows].reshape(bands, rows)
                keys.append(mix(gram_hash_rows(sig) + np.arange(bands, dtype=np.uint64)).view(np.int64))
                bits.append(_planes(np.concatenate((low, high))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["row", "doc_id", "n", "c", "keys", "bits"])

    return run


def _planes(sig: np.ndarray) -> np.ndarray:
    """PLANES bits of each signature value, a plane of whole 64-bit words for each bit."""
    wide = np.zeros((PLANES, -(-len(sig) // 64) * 64), np.uint8)
    wide[:, : len(sig)] = mix(sig) >> np.arange(PLANES, dtype=np.uint64)[:, None] & np.uint64(1)
    return np.packbits(wide, axis=1).view(np.int64).ravel()


def _unlike(values: int, percent: int) -> tuple[Column, float]:
    """How many signature values of ``bits`` and ``bits0`` differ, and the most: DEVIATIONS over the threshold's mean."""
    words, chance = -(-values // 64), percent / 100 + (1 - percent / 100) / 2**PLANES
    least = values * chance - DEVIATIONS * (values * chance * (1 - chance)) ** 0.5
    differ = [" | ".join(f"(bits[{b * words + w}] ^ bits0[{b * words + w}])" for b in range(PLANES)) for w in range(words)]
    return F.expr(" + ".join(f"bit_count({x})" for x in differ)), values - least


def gram_hash_rows(sig: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sig), np.uint64)
    for i in range(sig.shape[1]):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + sig[:, i])
    return out


def _full(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.view(np.int64) for x in _sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["c", "full"])

    return run


def _confirm(pairs: DataFrame, classes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Label pairs (la, lb) of those distinct pairs (a, b, la, lb) whose full sets are similar enough."""
    pairs = materialise(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = materialise(classes.join(nodes, "c").select("c", "row"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS  # else the texts are shuffled to them
    sets = materialise(rows.join(F.broadcast(wanted) if few else wanted, "row").select("c", "text").mapInArrow(_full(k), "c long, full array<long>"), "sets")
    left = sets.select(F.col("c").alias("a"), F.col("full").alias("x"))
    right = sets.select(F.col("c").alias("b"), F.col("full").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b").select("la", "lb", shared.alias("i"), (F.size("x") + F.size("y")).alias("total"))
    links = materialise(both.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("total") - F.col("i"))).select("la", "lb").distinct(), "links")
    discard(pairs, wanted, sets)
    return links


def _least(links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the links that join two components of the ones before."""
    top: dict[int, int] = {}
    out = []
    for a, b in links:
        x, y = (_root(top, z) for z in (a, b))
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _root(top: dict[int, int], x: int) -> int:
    while (y := top.get(x, x)) != x:
        top[x] = top.get(y, y)
        x = y
    return x


def _similar(full: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Label pairs of the similar sets of different labels; members of two sides are compared with the other side only."""
    size = np.array([len(x) for x in full])
    owner, every = np.repeat(np.arange(len(full)), size), np.concatenate(full)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    fresh = np.ones(len(every), bool)
    fresh[1:] = every[1:] != every[:-1]
    begin = np.flatnonzero(fresh)
    place = np.empty(len(every), np.int64)  # of each shingle of each set, in the sets' order
    place[order] = np.cumsum(fresh) - 1
    end = np.append(begin[1:], len(every))
    at = np.concatenate(([0], np.cumsum(size)))
    two = side.min() != side.max()
    for i in range(len(full)):
        if two and side[i] != side[0]:
            continue
        mine = place[at[i] : at[i + 1]]
        lists = [owner[a:b] for a, b in zip(begin[mine].tolist(), end[mine].tolist(), strict=True) if b - a > 1]
        if not lists:
            continue
        both = np.bincount(np.concatenate(lists), minlength=len(full))
        near = (100 * both >= percent * (size[i] + size - both)) & (label != label[i])
        near &= side != side[i] if two else np.arange(len(full)) > i
        for j in np.flatnonzero(near).tolist():
            yield int(label[i]), int(label[j])


def _families(percent: int):
    """Rows (t, side, label, full) sorted by t -> the links (la, lb) of each t that join its components."""

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held)
        sets = part.column("full").combine_chunks()
        values, off = sets.values.to_numpy(), sets.offsets.to_numpy()
        full = [values[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        found = _least(_similar(full, part.column("label").to_numpy(), part.column("side").to_numpy(), percent))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["la", "lb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            t = batch.column(0).to_pylist()
            at = 0
            while at < len(t):
                end = at + 1
                while end < len(t) and t[end] == t[at]:
                    end += 1
                if held and t[at] != now:
                    yield links(held)
                    held = []
                now = t[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield links(held)

    return run


def _exhausted(labelled: DataFrame, classes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Label pairs (la, lb) that join all components similar members of open buckets (k, c, n, label) belong to."""
    centre = labelled.groupBy("k").agg(F.min("c").alias("c0"))
    edges = labelled.join(centre, "k").where("c != c0").select(F.col("c").alias("a"), F.col("c0").alias("b")).distinct()
    family = materialise(components(edges).select(F.col("node").alias("c"), F.col("label").alias("f")), "families")
    member = materialise(labelled.select("c", "n", "label").distinct().join(family, "c"), "members")
    # a family of many shingles is cut in blocks; a task takes a block, or two against each other
    blocks = member.groupBy("f").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    wanted = materialise(member.join(blocks, "f").select("c", "label", "f", "blocks", block.alias("x")).join(classes.select("c", "row"), "c"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS // 2  # twice as wide as in _confirm
    sets = rows.join(F.broadcast(wanted) if few else wanted, "row").select("text", "label", "f", "blocks", "x").mapInArrow(_labelled_sets(k), "label long, f long, blocks int, x int, full array<long>")
    dealt = sets.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.struct("f", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    dealt = dealt.select(F.xxhash64(task).alias("t"), F.col("x").alias("side"), "label", "full").repartition("t").sortWithinPartitions("t")
    links = materialise(dealt.mapInArrow(_families(percent), "la long, lb long").distinct(), "links")
    discard(family, member, wanted)
    return links


def _labelled_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.view(np.int64) for x in _sets(batch.column(0), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.int64()))], names=["label", "f", "blocks", "x", "full"])

    return run


def _merged(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, label) after ``links`` between labels; only labels that meet another are walked."""
    step = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    if found is None:
        return materialise(step, "labels")
    step = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = found.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = step.join(found.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("to").alias("label"))
    out = materialise(old.unionByName(fresh), "labels")
    discard(found)
    return out


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, permutations: int = PERMUTATIONS, rows_per_band: int = ROWS_PER_BAND, screen: int = SCREEN) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, kept), a row a document."""
    rows = numbered(docs)
    sig = materialise(rows.mapInArrow(_signatures(k, permutations, rows_per_band, max(screen, permutations)), "row long, doc_id long, n long, c long, keys array<long>, bits array<long>"), "signatures")
    classes = sig.where("n > 0").groupBy("c").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    classes = materialise(classes, "classes")
    every = classes.select("c", "n", F.explode("keys").alias("k"))
    crowded = every.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k")
    posting = materialise(every.join(crowded, "k"), "postings")
    bits, bits0 = classes.select("c", "bits"), classes.select(F.col("c").alias("c0"), F.col("bits").alias("bits0"))
    close = F.lit(100) * F.least("n", "n0") >= F.lit(percent) * F.greatest("n", "n0")
    unlike, most = _unlike(2 * max(screen, permutations), percent)
    alike = unlike <= most
    confirm = partial(_confirm, classes=classes, rows=rows, k=k, percent=percent)
    found = None
    for star in range(STARS + 1):
        labelled = posting.withColumn("label", F.col("c")) if found is None else posting.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
        if star:
            open_keys = labelled.groupBy("k").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select("k")
            labelled = materialise(labelled.join(open_keys, "k"), "open")
            sizes = labelled.groupBy("k", "label").agg(F.count("*").alias("m")).groupBy("k").agg(F.sum("m").alias("all"), F.max(F.struct("m", "label")).alias("top"))
            sizes = materialise(sizes.select("k", "all", F.col("top.m").alias("m"), F.col("top.label").alias("big")), "sizes")
            cost, base = sizes.agg(F.sum((F.col("all") - F.col("m")) * F.col("all")), F.sum("all")).first()
            last = cost is not None and (cost <= CROSS_FACTOR * base or star == STARS)
            if last:  # what is left, exhaustively
                links = _exhausted(labelled, classes, rows, k, percent)
                found = _merged(found, links)
            discard(sizes)
            if last or not base:
                discard(labelled)
                break
        # each class is compared with one centre of its buckets, that with the most alike signature
        order = F.xxhash64("c", "k", F.lit(star))
        centre = labelled.groupBy("k").agg(F.min(F.struct(order.alias("o"), "c", "n", "label")).alias("z")).select("k", F.col("z.c").alias("c0"), F.col("z.n").alias("n0"), F.col("z.label").alias("label0"))
        near = labelled.join(centre, "k").where(F.expr("label != label0") & close).select("c", "label", "c0", "label0").distinct()
        near = near.join(bits, "c").join(bits0, "c0").where(alike)
        chosen = near.groupBy("c", "label").agg(F.min(F.struct(unlike.alias("o"), "c0", "label0")).alias("z")).select("c", "label", "z.c0", "z.label0")
        links = confirm(chosen.select(*_ends()).distinct())
        found = _merged(found, links)
        discard(links, *([labelled] if star else []))
    discard(posting)
    owner = sig.select("row", "doc_id", "n", "c").join(found.withColumnRenamed("node", "c"), "c", "left")
    owner = owner.withColumn("group", F.when(F.col("n") > 0, F.coalesce("label", "c")))
    least = owner.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("least"))
    out = owner.join(least, "group", "left").select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _ends() -> list:
    """A pair of classes with its labels, the lesser class first."""
    less = F.col("c") < F.col("c0")
    return [F.least("c", "c0").alias("a"), F.greatest("c", "c0").alias("b"), F.when(less, F.col("label")).otherwise(F.col("label0")).alias("la"), F.when(less, F.col("label0")).otherwise(F.col("label")).alias("lb")]
