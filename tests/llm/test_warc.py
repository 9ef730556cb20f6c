import base64
import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from simplexa.llm import warc


def test_round_trip(spark):
    rows = [(1, "u", "<p>é</p>"), (2, "v", "<p>é</p>"), (5, None, "<p>é</p>"), (3, "w", None), (4, "w\r\nx", ""), (9, "z", "once\r\n\r\nWARC/1.1\r\n"), (9, "z", "once\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, sha string")
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        top = max(q for q, _, g in rows if (g or "") == (h or ""))
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == top else "revisit", None if p == top else top))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    assert {r[3] for r in warc.round_trip(df, min_bytes=10**6).collect()} == {"response"}


def test_salvage():
    recs = [warc.record(str(i), "u", "response", 5, warc.digest32(b"abc%02d" % i), None, b"abc%02d" % i) for i in range(6)]
    for packed in (True, False):
        parts = [warc.pack(r) if packed else r for r in recs]
        data = b"".join(parts)
        hurt = bytearray(data)
        hurt[len(parts[0]) + len(parts[1]) - 12] ^= 0x55  # in the second record's payload or check
        found = list(warc.salvage(bytes(hurt)))
        assert [f[2]["payload"] for f in found if f[2]] == [b"abc%02d" % i for i in (0, 2, 3, 4, 5)]
        gaps = [f for f in found if f[2] is None]
        assert [(g[0], g[1]) for g in gaps] == [(len(parts[0]), len(parts[1]))] and gaps[0][3]
        cut = list(warc.salvage(data[:-7]))
        assert sum(f[2] is not None for f in cut) == 5 and cut[-1][2] is None
        assert [f[2] is None for f in warc.salvage(b"junk" + data)] == [True] + [False] * 6


def test_long_header_and_count(spark):
    df = spark.createDataFrame([(1, "u" * (3 << 19), "a"), (2, "v", "b")], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.round_trip(df).collect()) == [1, 2]
    folder, archives = warc.write(df)
    assert warc.read(folder, archives, whole=True).count() == 2
    with pytest.raises(Exception, match="records read"):
        warc.read(folder, archives.withColumn("records", F.col("records") + 1), whole=True).collect()


def test_writer_holds_few_pages(tmp_path):
    pick = random.Random(7)
    payloads = [pick.randbytes(8192) for _ in range(3000)]
    columns = {
        "page_id": pa.array([str(i) for i in range(3000)]),
        "url": pa.array(["u"] * 3000),
        "payload": pa.array(payloads, pa.binary()),
        "digest": pa.array([hashlib.sha1(x).hexdigest() for x in payloads]),
        "kind": pa.array(["response"] * 3000),
        "refers": pa.array([None] * 3000, pa.string()),
    }
    batch = pa.RecordBatch.from_pydict(columns)
    tracemalloc.start()
    try:
        listed = [row for b in warc._hexed(warc._writer(tmp_path.as_uri(), 10 << 20))(iter([batch])) for row in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 6 << 20  # of 24 MB of pages and archives of 10 MB
    assert sum(x["records"] for x in listed) == 3000 and len(listed) == 3
    at = 0
    for x in listed:
        data = (tmp_path / x["archive"]).read_bytes()
        assert len(data) <= 10 << 20
        found = [head["payload"] for _, _, head, _ in warc.salvage(data)]
        assert found == payloads[at : at + x["records"]]
        at += x["records"]
