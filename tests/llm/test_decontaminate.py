import hashlib
import re

from simplexa.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_brute(spark):
    items = [(1, "a b c d e f g h i"), (2, "Éa, x-y"), (10, "b c d e f g h i j"), (3, None), (4, " . "), (5, "a b c d e f g h")]
    docs = [(1, "A b, c d e f g h i j z"), (2, "éa x y éa x y"), (3, None), (4, ""), (5, "Éa X y"), (1, "a b c d e f g h"), (6, "a b c d e f g"), (7, "ba b c d e f g h i")]
    want = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for i, x in items:
            p = words(x)
            k = min(8, len(p))
            wins = {tuple(p[j : j + k]) for j in range(len(p) - k + 1)} if p else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in wins:
                    hit.update(range(j, j + k))
                    named.add(str(i))
        want.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), len(named) >= 2))
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.decontaminate(df, bench)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
