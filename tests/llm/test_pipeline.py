"""Stages of the pipeline, and what their tasks leave to each other in a Python worker."""

import hashlib

import pyarrow as pa

import corpus_pipeline
from simplexa.llm import bpe, lines
from simplexa.llm.queries import tokenizer_path
from tests.llm.test_similarity import WORD, corpus, deduplicated


def test_line_dedup_carries_columns(spark):
    """Every column comes through, in the pass that cuts the texts: they meet the line lists only, not themselves again."""
    have = corpus()
    rows = [(i, "\n".join(t or "" for _, t in have[i : i + 3]) if i % 9 else have[i][1], f"l{i}", None if i % 5 == 0 else f"s{i}", -i) for i in range(len(have))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.line_dedup(spark, docs, "")
    assert out.dtypes == docs.dtypes
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {r.doc_id: r for r in out.collect()}
    want = {r[0]: r for r in deduplicated([r[:2] for r in rows])}
    for i, text, lang, source, _ in rows:
        r = got.get(i)
        if r is None:
            assert want[i][2] > 0  # rows of which nothing went stay as they are
            continue
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == want[i][3]
        assert (r.lang, r.source, r.n_chars) == (lang, source, None if r.text is None else len(r.text))
        assert (r.text is None) == (text is None)
        assert want[i][2] == 0 or WORD.search(r.text)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(i in got for i, _, _, kept in want.values() if kept != empty and want[i][2] == 0)


def test_released_between_operators():
    """A task of another operator frees the encoder that a worker keeps; the encoder's own tasks find it again."""
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c"])], names=["doc_id", "text"])
    run = bpe.digests(tokenizer_path())
    first = next(run(iter([batch])))
    held = bpe.encoder(tokenizer_path())
    assert next(run(iter([batch]))).equals(first) and bpe.encoder(tokenizer_path()) is held
    rows = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), pa.array(["a b c"]), pa.array([[]], pa.list_(pa.int32()))], names=["row", "doc_id", "text", "lines"])
    assert next(lines._cut(False)(iter([rows]))).num_rows == 1
    assert not bpe._encoders
    assert next(run(iter([batch]))).equals(first)


def test_cut_in_parts():
    """The texts that are Python objects at a time don't grow with the session's batches."""
    n = 2500
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(["a\nb"] * n), pa.array([[1]] * n, pa.list_(pa.int32())), pa.array(["x"] * n)], names=["row", "doc_id", "text", "lines", "source"])
    out = list(lines._cut(True, ("source",))(iter([rows])))
    assert max(x.num_rows for x in out) <= 1000
    got = pa.Table.from_batches(out)
    assert got.column("row").to_pylist() == list(range(n)) and set(got.column("kept").to_pylist()) == {"a"} and set(got.column("source").to_pylist()) == {"x"}
