"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is cut into blocks of ``BLOCK`` bytes; each is compressed with the good and with
the bad dictionary. The difference of the summed sizes over the text's bytes is the
evidence; a logistic curve fitted on labelled texts that are in neither dictionary makes it a
probability. Held-out rows (crc32 of the id's digits, modulo 5, is 0) are not fitted on;
ids, sources and languages are no inputs of the score.

The fit reads a bounded sample: at most ``MAX_FIT`` labelled rows of each class (by
hash of the id). Half of them lend their whole texts: every block of every lending text is a
sample that the class's dictionary of ``DICT_BYTES`` is trained on, in one task a class. The
curve is fitted on the evidence of the other half's whole texts. Scoring is one narrow pass
over whole texts.

Defined results: null and empty texts get the training set's share of good rows; with a
class missing from the labels every score is that share (0.5 without labels); repeated rows
each get a row; ids that are null are not held out; other columns are ignored; where a class
has too few blocks to train on, both dictionaries are the lending texts as they are, uncut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.llm.common import by_id, materialise, parts, released

MAX_FIT, DICT_BYTES, BLOCK, LEVEL = 1500, 112 << 10, 2048, 3
CUTOFF = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    share: float
    slope: float
    shift: float
    lent: tuple[int, int] = (0, 0)  # rows whose blocks the good and the bad dictionary are made of


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.sides = []
        for raw in (model.good, model.bad):
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO) if raw else None
            if held is not None:
                held.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_dict_id=False) if held is not None else None)

    def evidence(self, text: bytes) -> float:
        good = bad = 0
        for block in blocks(text):
            good += len(self.sides[0].compress(block))
            bad += len(self.sides[1].compress(block))
        return (bad - good) / max(len(text), 1)

    def score(self, text: bytes) -> float:
        if not text or not self.model.good or not self.model.bad:
            return self.model.share
        x = self.model.slope * self.evidence(text) + self.model.shift
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps with a slight ridge."""
    scale = float(x.std()) or 1.0
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w += np.clip(np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w), -5, 5)
    return float(w[0]) / scale, float(w[1])


def _place(row) -> tuple[int, int]:
    return row["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), row["doc_id"]


def blocks(text: bytes) -> list[bytes]:
    return [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]


def train(texts: list[bytes]) -> bytes:
    """A dictionary trained on all blocks of the texts (no share of them set aside); empty where they are too few."""
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL, split_point=1.0, d=8, steps=4).as_bytes()
    except zstandard.ZstdError:
        return b""


def _train(lent: pa.Table) -> pa.Table:
    rows = sorted(lent.select(["doc_id", "quality"]).append_column("t", lent["text"].cast(pa.binary())).to_pylist(), key=_place)
    return pa.table({"quality": pa.array([rows[0]["quality"]], pa.int32()), "rows": pa.array([len(rows)], pa.int64()), "trained": pa.array([train([r["t"] for r in rows])], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out() & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total, good = known.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    share = good / total if total else 0.5
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    picked = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(max_fit) for q in (0, 1)]
    wanted = picked[0].unionByName(picked[1])  # at most 2 * max_fit rows
    found = by_id(docs).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).where("text != ''")
    found = materialise(found.withColumn("lends", F.xxhash64("doc_id", F.lit(12)) % 2 == 0), "labelled")
    made = {r.quality: r for r in found.where("lends").select("doc_id", "quality", "text").groupBy("quality").applyInArrow(_train, "quality int, rows long, trained binary").collect()}
    if len(made) < 2:
        return Model(b"", b"", share, 0.0, 0.0)
    if all(r.trained for r in made.values()):
        dicts = [bytes(made[side].trained) for side in (1, 0)]
    else:
        lent = found.where("lends").select("doc_id", "quality", F.expr("cast(text as binary)").alias("t")).collect()
        dicts = [b"\n".join(bytes(r.t) for r in sorted(lent, key=_place) if r.quality == side) for side in (1, 0)]
    lends = (made[1].rows, made[0].rows)
    seen = found.where("not lends").select("quality", "text").mapInArrow(_evidence(Model(*dicts, share, 0.0, 0.0)), "quality int, x double").collect()
    x, y = np.array([r.x for r in seen]), np.array([float(r.quality) for r in seen])
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", share, 0.0, 0.0)
    order = np.lexsort((y, x))  # sums don't hang on the order of arrival
    x, y = x[order], y[order]
    slope, shift = _calibrate(x, y)
    shift += math.log(max(share, 1e-6) / max(1 - share, 1e-6)) - math.log(y.sum() / (len(y) - y.sum()))  # back to the shares of all labels
    return Model(*dicts, share, slope, shift, lends)


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = [scorer.evidence(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], names=["quality", "x"])

    return run


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, text, held_out, score, predicted), a row a document."""
    out = by_id(docs).mapInArrow(_scores(model), "doc_id long, text string, score double")
    return out.select("doc_id", "text", held_out().alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def keeper(model: Model, column: int, cutoff: float = CUTOFF):
    """A mapInArrow function that passes the rows whose text (in ``column``) scores the cutoff or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        scorer = Scorer(model)
        for batch in batches:
            for part in parts(batch):
                texts = part.column(column).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array([scorer.score(t or b"") >= cutoff for t in texts], pa.bool_()))

    return run
