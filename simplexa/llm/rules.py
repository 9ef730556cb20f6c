"""Quality rules whose cutoffs are chosen under a guarantee of few false rejections.

Base measures are taken of whole texts. Each rule rejects a document whose measure is
above a cutoff. Labelled good rows (quality 1) are the holdout: in each stratum (the
language) the steps of ``PATH`` tighten one rule after another, so that each rule set rejects
what the one before it does. They are tested in that order, fixed beforehand, as whole sets:
the exact (Clopper-Pearson) upper bound of the share of good rows that any rule of the set
rejects, at level DELTA / (number of strata), must be at most RISK; the first failure ends the
sequence. That needs no division by its length: with probability 1 - DELTA all sets that passed,
in all strata, lose at most RISK of the good documents. Of these the loosest is taken that
rejects as many labelled bad rows (quality 0) as the strictest does; the strictest itself where
the stratum has no labelled bad rows.

A stratum with fewer good rows than a test without any false rejection needs (``needed``; the
number of strata counts those that have enough) keeps all. Counts are made in Spark over all
labelled rows; what reaches the driver is two counts for each stratum and step.

Defined results: null text has no words and fails the base; null languages are a
stratum of their own; repeated rows each get a row; labels repeated for an id count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RISK, DELTA = 0.03, 0.05
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
#: Rule -> its measure, each in hundredths of a share.
RULES = {
    "symbols": "100.0 * n_symbols / greatest(word_chars, 1)",
    "dup_lines": "100.0 * n_dup_lines / greatest(n_words / 10.0, 1)",
    "repeats": "100.0 * n_repeat_words / greatest(n_words, 1)",
    "short_words": "100.0 - 100.0 * least(word_chars / greatest(n_words, 1) / 10.0, 1)",
    "long_words": "100.0 * least(word_chars / greatest(n_words, 1) / 50.0, 1)",
}
GRID = [0.5, 1, 2, 3, 5, 8, 12, 16, 20, 30, 40, 50, 60, 70, 80, 90]
#: Cutoffs in common use (a tenth symbols, 30 % repeated lines, 15 % repeated words, mean word length 3 and 10).
USUAL = {"symbols": 10, "dup_lines": 30, "repeats": 15, "short_words": 70, "long_words": 20}
#: (rule, cutoff) from loose to strict, by the share of the way from 100 to the usual cutoff; no data is asked.
PATH = sorted(((name, g) for name in RULES for g in GRID), key=lambda x: ((100 - x[1]) / (100 - USUAL[x[0]]), list(RULES).index(x[0])))


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = _WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if len(words) > 5:
        windows = list(zip(*(words[i:] for i in range(5)), strict=False))
        held = Counter(windows)
        upto = 0
        if len(held) < len(windows):
            for i, w in enumerate(windows):
                if held[w] > 1:
                    repeat += i + 5 - max(i, upto)
                    upto = i + 5
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), dup, repeat


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "lang", *[x.split(" ")[0] for x in MEASURES.split(", ")]]
    for batch in batches:
        found = [measure(t.as_py()) for t in batch.column(2)]
        cols = list(zip(*found, strict=True)) if found else [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols)], names=names)


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, the five measures, base_failed)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(_measures, f"doc_id long, lang string, {MEASURES}")
    return out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def upper_bound(bad: int, n: int, level: float) -> float:
    """Exact one-sided upper bound of a share of which ``bad`` of ``n`` were seen."""
    if bad >= n:
        return 1.0
    base = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(bad + 1)]

    def tail(p: float) -> float:
        terms = [b + i * math.log(p) + (n - i) * math.log1p(-p) for i, b in enumerate(base)]
        top = max(terms)
        return top + math.log(sum(math.exp(t - top) for t in terms))

    low, high = bad / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > math.log(level) else (low, mid)
    return high


def needed(risk: float, level: float) -> int:
    """The least number of good rows at which none rejected proves ``risk`` at ``level``."""
    return max(1, math.ceil(math.log(level) / math.log1p(-risk) - 1e-9))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[str | None, str], float]:
    """(stratum, rule) -> its cutoff in the rule set that is taken; without an entry the rule rejects nothing."""
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    held = measured.where("not base_failed").join(known, "doc_id")
    at = {step: i for i, step in enumerate(PATH)}
    hits = [f"case {' '.join(f'when {rule} > {g} then {at[name, g]}' for g in sorted(GRID, reverse=True))} else {len(PATH)} end" for name, rule in RULES.items()]
    held = held.select("lang", "quality", F.expr(f"least({', '.join(hits)})").alias("step"))  # the first step that rejects the row
    counts = [F.sum(((F.col("quality") == q) & (F.col("step") <= i)).cast("long")).alias(f"{name}_{i}") for q, name in ((1, "lost"), (0, "caught")) for i in range(len(PATH))]
    rows = held.groupBy("lang").agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"), *counts).where(F.col("good") >= needed(risk, delta)).collect()
    rows.sort(key=lambda r: -r["good"])
    while rows and rows[-1]["good"] < needed(risk, delta / len(rows)):
        least = rows[-1]["good"]
        rows = [r for r in rows if r["good"] > least]
    out = {}
    for r in rows:
        passed = 0
        while passed < len(PATH) and r[f"lost_{passed}"] <= r["good"] * risk and upper_bound(r[f"lost_{passed}"], r["good"], delta / len(rows)) <= risk:
            passed += 1
        while passed and r["bad"] and r[f"caught_{passed - 1}"] == (r[f"caught_{passed - 2}"] if passed > 1 else 0):
            passed -= 1
        out.update({(r["lang"], name): float(g) for name, g in PATH[:passed]})
    return out


def apply_rules(measured: DataFrame, chosen: dict[tuple[str | None, str], float]) -> DataFrame:
    """Adds ``failed`` (names of the rules that reject the document) and ``kept``."""
    tests = []
    for name, rule in RULES.items():
        hit = F.lit(False)
        for (lang, own), cut in sorted(chosen.items(), key=str):
            if own == name:
                hit = hit | (F.col("lang").eqNullSafe(F.lit(lang).cast("string")) & (F.expr(rule) > cut))
        tests.append(F.when(hit, F.lit(name)))
    out = measured.withColumn("failed", F.array_compact(F.array(*tests)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
