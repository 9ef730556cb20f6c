"""Repeated windows against brute force, on hostile small tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from simplexa.llm import repeats, windows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def docs():
    r = random.Random(5)
    words = ["aa", "b", "çé", "dd", "e", "ff"]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(25)]
    texts = base + base[:5] + [base[i] + " " + base[i + 1] for i in range(8)] + ["x " * 90, "x" * 120, "", None, " \n\t", "yz" * 60]
    return [(i * 3, t) for i, t in enumerate(texts)] + [(0, base[0]), (7, base[3]), (None, base[2])]


def brute(rows, k, words, mode):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    syms = {}
    for i in order:
        raw = (rows[i][1] or "").encode()
        syms[i] = WORD.findall(raw) if words else [raw[j : j + 1] for j in range(len(raw))]
    seen = {}
    for i in order:
        for s in range(len(syms[i]) - k + 1):
            seen.setdefault(tuple(syms[i][s : s + k]), []).append((i, s))
    gone = {i: set() for i in order}
    for places in seen.values():
        for i, s in places[1:] if mode == "later" else places if len(places) > 1 else []:
            gone[i].update(range(s, s + k))
    out = []
    for i in order:
        kept = (b" " if words else b"").join(x for j, x in enumerate(syms[i]) if j not in gone[i])
        runs = sum(1 for j in gone[i] if j - 1 not in gone[i])
        out.append((rows[i][0], len(syms[i]), len(gone[i]), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "gram", "words", "mode"), [(8, 3, True, "later"), (30, 12, False, "any"), (5, 5, True, "any"), (12, 1, False, "later")])
def test_brute(spark, k, gram, words, mode):
    rows = docs()
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, row string")
    got = windows.remove_repeats(df, k, gram, words, mode).drop("kept").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, k, words, mode)


def test_empty(spark):
    assert windows.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 8, 3, True, "later").count() == 0


@pytest.mark.parametrize("crowd", [1, 4096])
def test_crowded(spark, monkeypatch, crowd):
    """Anchors split by what is next to them give the same."""
    r = random.Random(9)
    base = [r.choice("abcdefgh") for _ in range(120)]
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(3):
            t[r.randrange(len(t))] = r.choice("xyz")
        rows.append((i // 2, " ".join(t)))
    rows.append((99, "long " * 300_000))
    monkeypatch.setattr(windows, "CROWD", crowd)
    monkeypatch.setattr(windows, "SHARD", 500)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, gram, words, mode in ((9, 4, True, "later"), (20, 8, False, "any")):
        if not words:
            df, rows = df.where("doc_id < 99"), rows[:-1]
        got = windows.remove_repeats(df, k, gram, words, mode).drop("kept").collect()
        assert sorted((tuple(x) for x in got), key=str) == brute(rows, k, words, mode)


def test_kernels():
    """Transform and matching statistics against their definitions."""
    r = random.Random(2)
    for _ in range(60):
        seqs = [[r.randrange(3) for _ in range(r.randrange(8, 20))] for _ in range(6)]
        groups, anchors = np.array([0, 0, 0, 1, 1, 1]), np.array([r.randrange(3) for _ in seqs])
        who, at = repeats.columns(groups, [np.array(s) for s in seqs], anchors, 4)
        same = lambda i, o, j: (p := o - anchors[i] + anchors[j]) >= 0 and p + 4 <= len(seqs[j]) and seqs[j][p : p + 4] == seqs[i][o : o + 4]  # noqa: B023, E731
        want = {(i, o) for i, s in enumerate(seqs) for o in range(len(s) - 3) if any(j != i and groups[j] == groups[i] and same(i, o, j) for j in range(6))}
        assert set(zip(who.tolist(), at.tolist(), strict=True)) == want
        seen = repeats.Automaton()
        for s in seqs[:3]:
            seen.add(s)
        inside = {tuple(s[a:b]) for s in seqs[:3] for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        longest = [max((n for n in range(e + 2) if n == 0 or tuple(seqs[3][e + 1 - n : e + 1]) in inside)) for e in range(len(seqs[3]))]
        assert seen.statistics(seqs[3]) == longest
