"""Near-duplicate documents and lines against brute force."""

import hashlib
import random
import re
import uuid

from simplexa.llm import lines, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["É", "The", "of"]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = [make(r.randrange(20, 90)) for _ in range(12)]
    out = list(base)
    for t in base * 3:
        w = t.split()
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    chain = base[0].split()
    for i in range(12):
        chain[-1 - 2 * i % len(chain)] = f"z{i}"
        out.append(" ".join(chain))
    out += ["", None, "  \n", "one two", "ONE two", "one two three", base[1].upper().replace("É", "É")]
    return [(i * 7 % 101 + 1, t) for i, t in enumerate(out)] + [(1, base[0])]


def test_components(spark):
    rows = corpus()
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    want = []
    for i, (d, _) in enumerate(rows):
        least = min(rows[j][0] for j in range(len(rows)) if root(j) == root(i))
        want.append((d, len(sets[i]), least, d == least))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    got = minhash.near_duplicates(df).drop("row").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def deduplicated(rows):
    """Brute force: (doc_id, n_lines, n_removed, kept_sha256) of each row."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, want = [], []
    for i in order:
        have, kept = (rows[i][1] or "").split("\n"), []
        for x in have:
            s = set(WORD.findall(lower(x)))
            if not (s and any(100 * len(s & y) >= 75 * len(s | y) for y in seen)):
                kept.append(x)
            if s:
                seen.append(s)
        want.append((rows[i][0], len(have), len(have) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return want


def test_lines(spark, monkeypatch):
    r = random.Random(8)
    base = [t or "" for _, t in corpus()]
    rows = [(i, "\n".join(r.choice(base)[:r.randrange(5, 120)] for _ in range(r.randrange(1, 7)))) for i in range(60)] + [(99, None), (3, "a b c\n\na B c d"), (None, base[0])]
    # the second table runs against the order of doc_id
    for given in (rows, [x for x in rows[::-1] if x[0] != 3]):
        want = deduplicated(given)
        df = spark.createDataFrame([(*x, 1) for x in given], "doc_id long, text string, line int")
        for hot, paired, partners, few in ((64, 100, 1, 64), (3, 20, 1, 2)):
            for name, x in (("HOT", hot), ("PAIRED", paired), ("PARTNERS", partners), ("FEW", few)):
                monkeypatch.setattr(lines, name, x)
            got = lines.dedup(df).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
            assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert lines.dedup(df.limit(0)).count() == 0


def test_family_below_threshold(spark, monkeypatch):
    """Many documents just below the threshold of each other, a few links among them: no table of their pairs."""
    r = random.Random(4)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for x in r.sample(range(5, 195, 6), 4):
            w[x] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(0, 20, 2):  # near copies of some, one step each
        w = rows[i][1].split()
        w[r.randrange(200)] = "other"
        rows.append((1000 + i, " ".join(w)))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(196)} for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    want = sorted((d, min(rows[j][0] for j in range(len(rows)) if root(j) == root(i))) for i, (d, _) in enumerate(rows))
    sizes, write = [], minhash.materialise

    def counted(df, name):
        out = write(df, name)
        if name in ("pairs", "wanted", "links"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialise", counted)
    for block in (minhash.BLOCK, 4000):  # one block, and several against each other
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
        assert sorted(map(tuple, got)) == want
    assert max(sizes) <= 2 * len(rows)


def test_lines_alike_but_not_similar(spark, monkeypatch):
    """Long lines just below the threshold, many partners each: listed partners decide them without a second pass; that pass gives the same."""
    r = random.Random(6)
    base = [f"u{i}" for i in range(100)]
    rows = []
    for i in range(40):
        w = list(base)
        for x in r.sample(range(100), 10):
            w[x] = f"t{i}x{x}"
        rows.append((i, " ".join(w)))
    rows += [(50, rows[3][1] + " more"), (51, "a b c\n" + " ".join(base))]
    want, df = deduplicated(rows), spark.createDataFrame(rows, "doc_id long, text string")
    names, write = [], lines.materialise
    monkeypatch.setattr(lines, "materialise", lambda df, name: names.append(name) or write(df, name))
    for spare, second in ((lines.SPARE, False), (1, True)):
        monkeypatch.setattr(lines, "SPARE", spare)
        names.clear()
        got = lines.dedup(df, texts=False).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == sorted(want)
        assert ("line-keys" in names) == second


def test_few_pairs_of_lines_left(spark, monkeypatch):
    """The last pairs meet the classes by broadcasts; as many joins by shuffles, where they are many, give the same."""
    r = random.Random(9)
    vocab = [f"f{i}" for i in range(40)]
    rows = [(i, "\n".join(" ".join(r.sample(vocab, r.randrange(6, 16))) for _ in range(4))) for i in range(40)]
    rows += [(100 + i, " ".join(t.split()[:-1])) for i, t in rows[:10]]
    want, df = deduplicated(rows), spark.createDataFrame(rows, "doc_id long, text string")
    for name, x in (("HOT", 3), ("PAIRED", 20), ("PARTNERS", 1), ("FEW", 2)):
        monkeypatch.setattr(lines, name, x)
    asked, oriented = [], lines.oriented

    def seen(pairs, classes, percent, few=False):
        asked.append(few)
        return oriented(pairs, classes, percent, few)

    monkeypatch.setattr(lines, "oriented", seen)
    for most in (lines.BROADCAST_BYTES, 0):
        monkeypatch.setattr(lines, "BROADCAST_BYTES", most)
        got = lines.dedup(df, texts=False).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert asked == [False, True, False, False]


def test_keys_of_lines_are_dealt_in_bulk(spark, monkeypatch, tmp_path):
    """The keys of one token reach their tasks as a few binaries of many, however many are dealt at once, and the result is brute force's."""
    r = random.Random(12)
    vocab = [f"g{i}" for i in range(400)]
    rows = [(i, "\n".join(" ".join(r.sample(vocab, r.randrange(8, 30))) for _ in range(4))) for i in range(60)]
    rows += [(200 - i, " ".join(t.split("\n")[1].split()[1:])) for i, t in rows[:20]] + [(None, rows[5][1]), (300, rows[7][1])]
    want, df = deduplicated(rows), spark.createDataFrame(rows, "doc_id long, text string")
    pairs, told = lines._pairs, tmp_path / "rows"

    def counted(*given):
        run = pairs(*given)

        def each(batches):
            held = list(batches)
            (told / uuid.uuid4().hex).write_text(str(sum(x.num_rows for x in held)))
            return run(iter(held))

        return each

    monkeypatch.setattr(lines, "_pairs", counted)
    told.mkdir()
    for at_once, most in ((lines.DEALT, 2 * 4 * 4), (50, 2 * 4 * 120)):  # slices, tasks, and parts from each
        monkeypatch.setattr(lines, "DEALT", at_once)
        got = lines.dedup(df, texts=False).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        assert 0 < sum(int(x.read_text()) for x in told.iterdir()) <= most
        for x in told.iterdir():
            x.unlink()
