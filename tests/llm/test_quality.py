import math
import random

import pytest
from pyspark.sql import functions as F

from simplexa.llm import compress, rules


def test_measure():
    assert rules.measure(None) == (0, 0, 0, 0, 0)
    assert rules.measure("") == (0, 0, 0, 0, 0)
    assert rules.measure("a # b\na # b\n\n") == (6, 6, 2, 1, 0)
    t = "a b c d e f a b c d e".split()
    assert rules.measure(" ".join(t))[4] == 10
    r = random.Random(1)
    for _ in range(50):
        w = [r.choice("abc") for _ in range(r.randrange(40))]
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        want = len({j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 5)})
        assert rules.measure(" ".join(w))[4] == want


def test_bound():
    assert rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    p = rules.upper_bound(3, 50, 0.01)
    assert sum(math.comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4)) == pytest.approx(0.01, rel=1e-6)
    assert rules.upper_bound(5, 5, 0.05) == 1


def rows(spark):
    r = random.Random(2)
    good = ["the", "river", "of", "stone", "and", "light", "house", "was", "walking"]
    out = []
    for i in range(400):
        q = int(i % 4 != 0)
        w = [r.choice(good) + ("" if q else r.choice(["###", "$$$", "&&", "!!"])) for _ in range(60)]
        out.append((i, " ".join(w), "en", q))
    return spark.createDataFrame([*out, (900, None, None, 1), (901, "", "en", 0), (0, out[0][1], "en", 0)], "doc_id long, text string, lang string, quality int")


def test_classifier(spark):
    df = rows(spark)
    model = compress.fit(df, df.select("doc_id", "quality"))
    got = compress.score(df.withColumn("score", F.lit("x")), model).join(df.select("doc_id", "quality").distinct(), "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum((r.score >= 0.5) == bool(r.quality) for r in got) / len(got) >= 0.95
    assert compress.score(df, compress.fit(df.limit(0), df.select("doc_id", "quality").limit(0))).where("score = 0.5").count() == df.count()


def test_classifier_learns_from_whole_texts(spark):
    r = random.Random(3)
    good = ["the", "river", "of", "stone", "and", "light", "house", "was", "walking"]
    junk = ["click", "casino", "cheap", "winner", "bonus", "jackpot", "voucher", "refund"]
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    made = [(i, say(good, 1500) + " " + say(good if i % 2 else junk, 400), i % 2) for i in range(400)]  # all alike for the first 6,000 bytes
    df = spark.createDataFrame(made, "doc_id long, text string, quality int")
    model = compress.fit(df, df.select("doc_id", "quality"))
    assert b"jackpot" in model.bad and b"jackpot" not in model.good
    got = compress.score(df, model).join(df.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum((x.score >= 0.5) == bool(x.quality) for x in got) / len(got) >= 0.95
    lends = [i for (i,) in df.where(~compress.held_out() & (F.xxhash64("doc_id", F.lit(12)) % 2 == 0)).select("doc_id").collect()]
    assert model.lent == (sum(i % 2 for i in lends), sum(1 - i % 2 for i in lends))


def test_rules(spark):
    df = rows(spark)
    m = rules.measures(df)
    chosen = rules.cutoffs(m, df.select("doc_id", "quality"), risk=0.2)
    got = rules.apply_rules(m, chosen).join(df.select("doc_id", "quality").distinct(), "doc_id").where("n_words > 0").collect()
    assert all(r.kept for r in got if r.quality and not r.base_failed)
    assert not any(r.kept for r in got if not r.quality and r.doc_id)
    assert rules.cutoffs(m, df.select("doc_id", "quality").limit(0)) == {}


def test_rules_in_small_strata(spark):
    r = random.Random(4)
    words = [a + b for a in ("the", "river", "stone", "light", "house", "walk") for b in ("", "s", "ed", "ing", "er", "y")]  # no window repeats
    made = []
    for lang, n in (("en", 160), ("de", 150), ("es", 144), ("fr", 145), ("it", 100)):
        for i in range(n + 20):
            w = [r.choice(words) + ("$$" if i >= n else "") for _ in range(60)]
            made.append((len(made), " ".join(w), lang, int(i < n)))
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, quality int")
    m = rules.measures(df)
    chosen = rules.cutoffs(m, df.select("doc_id", "quality"))
    assert {lang for lang, _ in chosen} == {"en", "de", "es", "fr"}
    got = rules.apply_rules(m, chosen).join(df.select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    for lang in ("en", "de", "es", "fr"):
        good = [x.kept for x in got if x.lang == lang and x.quality]
        assert rules.upper_bound(good.count(False), len(good), rules.DELTA / 4) <= rules.RISK
        assert not any(x.kept for x in got if x.lang == lang and not x.quality)
    assert all(x.kept for x in got if x.lang == "it")
    seen = {}
    for name, g in rules.PATH:  # each rule set holds the one before it
        assert g < seen.get(name, 101)
        seen[name] = g
    assert len(rules.PATH) == len(rules.RULES) * len(rules.GRID)
