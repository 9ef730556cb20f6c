import re
import unicodedata

from simplexa.llm import pii


def test_surrogates(spark):
    texts = ["Mail anna.k12@mail3.example.com or Anna.K12@mail3.example.com, ip 10.2.200.7. Then (013) 555-0024 and +1 (013) 555-0024.", "card 4785380592391139, key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff; Mrs. Ivanova met Mr Smith Brown", "nothing 12 here v1.2.3", "", None, "anna.k12@mail3.example.com"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    got = {r.doc_id: r for r in pii.replace(df, "k").collect()}
    assert [got[i].n_entities for i in range(6)] == [5, 4, 0, 0, 0, 1]
    assert [got[i].replaced for i in (2, 3, 4)] == ["nothing 12 here v1.2.3", "", None]
    a = got[0].surrogates
    assert a[0].lower() == a[1].lower() == got[5].replaced and a[1][0].isupper() and a[0].endswith("@mail3.example.com")
    assert all(0 <= int(x) <= 255 for x in a[2].split(".")) and a[2] != "10.2.200.7"
    assert re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", a[3]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a[4])
    b = got[1].surrogates
    assert re.fullmatch(r"\d{16}", b[0]) and re.fullmatch(r"[0-9a-f]{40}", b[1]) and re.fullmatch(r"Mrs\. [A-Z][a-z]{5}a", b[2]) and re.fullmatch(r"Mr [A-Z][a-z]{4} [A-Z][a-z]{4}", b[3])
    assert all(x != y for r in got.values() if r.found for x, y in zip(r.found, r.surrogates))
    assert pii.replace(df, "other").collect()[0].replaced != got[0].replaced


def test_distinct(spark):
    df = spark.createDataFrame([(i, f"{i * 7919:016d} 10.{i % 250}.{i // 250}.9 u{i}@a.org") for i in range(3000)], "doc_id long, text string")
    out = pii.replace(df, "k")
    assert pii.collisions(out).count() == 0
    assert pii.replace(df.limit(0), "k").count() == 0


def test_every_script_moves(spark):
    mails = ["王伟@example.com", "δημήτρης@example.gr", "محمد@example.com", "한국@example.kr", "ъь@example.ru", "éà@example.fr", "ñ@example.es", "ß@example.de", "٣@example.com", "𠀀@example.com", "ª@example.com", "½.@example.com"]
    mails += [f"{c}@example.com" for c in "abcdefghijklmnopqrstuvwxyz0123456789"] + [f"{c}{p}@example.org" for c in "aeiouxyz" for p in "._-+"]
    names = ["Dr. Αθηνά", "Dr Γεωργίου", "Herr Öğüş", "Sra Ñúñez", "Mr Wu", "Dr Li", "Mme Œé", "Господин Ёъь", "Mr Ჯა"]
    df = spark.createDataFrame([(i, f"-- {x} --") for i, x in enumerate([*mails, *names])], "doc_id long, text string")
    for key in ("k", "m", "n"):
        out = pii.replace(df, key)
        got = out.collect()
        assert [r.found for r in got] == [[x] for x in [*mails, *names]]
        for r in got:
            assert r.surrogates[0] != r.found[0] and len(r.surrogates[0]) == len(r.found[0])
            assert r.replaced == f"-- {r.surrogates[0]} --"
        assert pii.collisions(out).count() == 0
        two = got[1].surrogates[0], got[0].surrogates[0]
        assert all(unicodedata.name(c).startswith("GREEK") for c in two[0].split("@")[0]) and not set(two[1].split("@")[0]) & set("王伟")


def test_scripts_are_whole():
    listed = set("".join(pii.ALPHABETS))
    held = [cp for lo, hi, *_ in pii.scripts() for cp in range(lo, hi + 1)]
    assert len(held) == len(set(held)) and not listed & set(map(chr, held))
    assert all(n > 1 for *_, n in pii.scripts())
    assert {c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] in "LN"} <= listed | set(map(chr, held))


def test_one_person_one_surrogate(spark):
    texts = [
        "Smith saw Mr Smith and Mr. Smith, Dr Smith; Mr John Smith. Smith's dog: John, Smithson, smith",
        "(013) 555-0024 or +1 (013) 555-0024 or +44 (013) 555-0024; 4785380592391139 or 4785 3805 9239 1139 or 4785-3805-9239-1139",
        "+4915112345678 or +49 151 1234 5678",
        "Smith",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace(df, "k").collect()}
    a = got[0].surrogates
    smith, john = a[0].split(" ")[1], a[3].split(" ")[1]
    assert smith != "Smith" and john != "John"
    assert a == [f"Mr {smith}", f"Mr. {smith}", f"Dr {smith}", f"Mr {john} {smith}"]
    assert got[0].replaced == f"Smith saw {a[0]} and {a[1]}, {a[2]}; {a[3]}. {smith}'s dog: {john}, Smithson, smith"
    b = got[1].surrogates
    assert b[1] == "+1 " + b[0] and b[2] == "+44 " + b[0] and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", b[0])
    assert b[4] == " ".join(b[3][i : i + 4] for i in (0, 4, 8, 12)) and b[5] == b[4].replace(" ", "-")
    c = got[2].surrogates
    assert c[0] == c[1].replace(" ", "") and c[0].startswith("+49")
    assert all(x != y for r in got.values() if r.found for x, y in zip(r.found, r.surrogates))
    assert got[3].replaced == "Smith" and got[3].n_entities == 0
