"""Surrogate generation for personal data, in DataFrame functions only.

Entities (e-mail and IPv4 addresses, telephone and card numbers, long hexadecimal
secrets, names after a title) are found by patterns and replaced by what a keyed
three-round Feistel network makes of them: characters at even and odd places are shifted in turn
within their own alphabet (digits, vowels and consonants by case and script; every other letter
or number within those of its script and case), by amounts that
hang on the key, the kind, the entity's form and the other half, without regard to case.

* The network is a bijection on the entities of one form and keeps the form, so different
  entities get different surrogates and equal ones the same, in all documents, without a table;
  ``collisions`` checks that on the data.
* The odd half is shifted once, never by nought; where it has no letter or number, the even half
  is shifted once only. So no entity maps to itself.
* A name goes part by part, whatever its title, and each part keeps its script, case and last letter
  (which carries gender in many languages), so that a part has one surrogate wherever it stands.
  Later bare mentions of the parts of a document's names (same case, whole words, between entities)
  get it too; ``n_entities`` and ``found`` hold entities only, without these mentions.
* A telephone or card number goes by its digits, a telephone number's country code aside; code,
  separators and brackets are put back, so that it has one surrogate in all its formats.
* An e-mail address keeps its domain, an IPv4 address stays four numbers of 0 to 255.

No shuffle; a text's pieces stay in its row. Defined results: null text stays null with no
entities; an empty text is empty; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexa.llm.common import by_id

#: Kinds and their patterns, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@[\p{L}\p{N}][\p{L}\p{N}\-]*(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d])(?!\.\d)",
    "phone": r"(?:(?<!\d)\+\d{1,3}[ .\-]?)?(?<!\d)\(\d{2,4}\) ?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])",
    "card": r"(?<![\p{L}\d])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\p{L}\d])",
    "secret": r"(?<![\p{L}\d])(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,128}(?![\p{L}\d])",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Mme|Herr|Frau|Señora|Señor|Sra|Sr|Dr|Господин|Госпожа)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
#: Assigned country codes: one digit, two digits, else three.
CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}|\d{1,2})[ .\-]?"
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"]
_MORE = ["áéíóúàèìòùâêîôûäëïöüãõåæœø", "çñšžčřłśźćńğşđþð", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ", "ёйъьіїєґў"]
ALPHABETS += [a for low in _MORE for a in (low, low.upper())]
HEX_ALPHABETS = ["0123456789", "abcdef", "ABCDEF"]
#: Column with the alphabets of all other letters and numbers.
SCRIPTS = "scripts"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


_MOVES = r"[\p{L}\p{N}]"
_TOKENS = r"\p{L}+|[^\p{L}]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


@cache
def scripts() -> tuple[tuple[int, int, int, int, int], ...]:
    """(first, last, alphabet, place of the first, size of the alphabet): the runs of code points of every letter and number outside ``ALPHABETS``."""
    listed = set("".join(ALPHABETS))
    groups: dict[tuple[str, str], list[int]] = {}
    for cp in range(0x80, 0x110000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind[0] not in "LN" or c in listed:
            continue
        script = unicodedata.name(c, "OTHER").split(" ")[0].split("-")[0]
        up, low = c.upper(), c.lower()
        if kind == "Ll" and len(up) == 1 and up != c and up.lower() == c and unicodedata.category(up) == "Lu" and up not in listed:
            kind = "paired"  # its capital has the same place in an alphabet of capitals
        elif kind == "Lu" and len(low) == 1 and low != c and low.upper() == c and unicodedata.category(low) == "Ll" and low not in listed:
            continue
        groups.setdefault((script, kind), []).append(cp)
    lone = [key for key, cps in groups.items() if len(cps) == 1]
    rest = groups.setdefault(("", "L"), [])
    for key in lone:  # a lone letter can't move: it joins the others
        cp = groups.pop(key)[0]
        rest.extend([cp, ord(chr(cp).upper())] if key[1] == "paired" else [cp])
    lists = [sorted(cps) for cps in groups.values()] + [[ord(chr(cp).upper()) for cp in sorted(cps)] for (_, kind), cps in groups.items() if kind == "paired"]
    runs = []
    for number, cps in enumerate(lists):
        at = 0
        for i in range(1, len(cps) + 1):
            if i == len(cps) or cps[i] != cps[i - 1] + 1:
                runs.append((cps[at], cps[i - 1], number, at, len(cps)))
                at = i
    return tuple(runs)


def with_scripts(df: DataFrame) -> DataFrame:
    held = "[" + ",".join('{"lo":%d,"hi":%d,"a":%d,"at":%d,"n":%d}' % r for r in scripts()) + "]"
    return df.withColumn(SCRIPTS, F.from_json(F.lit(held), "array<struct<lo:int,hi:int,a:int,at:int,n:int>>"))


def _elsewhere(c: str, amount: str) -> str:
    """SQL for a letter or number outside the listed alphabets, shifted within its own."""
    run = f"filter({SCRIPTS}, r -> ascii({c}) between r.lo and r.hi)[0]"
    place = f"pmod(f.at + ascii({c}) - f.lo + 1 + pmod({amount}, f.n - 1), f.n)"
    found = f"filter({SCRIPTS}, r -> r.a = f.a and t between r.at and r.at + r.hi - r.lo)[0]"
    char = "decode(unhex(lpad(hex(g.lo + t - g.at), 8, '0')), 'UTF-32')"
    return f"transform(array({run}), f -> if(f is null, {c}, transform(array({place}), t -> transform(array({found}), g -> {char})[0])[0]))[0]"


def _shift(c: str, amount: str, alphabets: list[str]) -> str:
    cases = [f"when instr('{a}', {c}) > 0 then substr('{a}', pmod(instr('{a}', {c}) - 1 + 1 + pmod({amount}, {len(a) - 1}), {len(a)}) + 1, 1)" for a in alphabets]
    plain = sum(a.isascii() for a in alphabets)  # these come first
    cases.insert(plain, f"when ascii({c}) < 128 then {c}")
    return f"case {' '.join(cases)} when {c} rlike {_quoted(_MOVES)} then {_elsewhere(c, amount)} else {c} end"


def _network(text: str, tweak: str, alphabets: list[str]) -> str:
    """SQL for ``text`` sent through the network; ``tweak`` goes into every round's hash."""
    state = f"split({text}, '')"
    for turn, parity in enumerate((0, 1, 0)):
        other = f"lower(array_join(filter(a{turn}, (c, i) -> i % 2 != {parity}), ''))"
        amount = "cast(conv(substr(h, (i % 60) * 2 + 1, 4), 16, 10) as int)"
        moved = f"transform(a{turn}, (c, i) -> if(i % 2 = {parity}, {_shift('c', amount, alphabets)}, c))"
        if turn == 2:
            moved = f"if({other} rlike {_quoted(_MOVES)}, {moved}, a{turn})"
        state = f"transform(array({state}), a{turn} -> transform(array(sha2(concat({tweak}, '|{turn}|', {other}), 512)), h -> {moved})[0])[0]"
    return f"array_join({state}, '')"


def _address(text: str, key: str) -> str:
    state = f"transform(split({text}, '[.]'), x -> cast(x as int))"
    for turn, parity in enumerate((0, 1, 0)):
        other = f"array_join(transform(filter(b{turn}, (c, i) -> i % 2 != {parity}), c -> cast(c as string)), '.')"
        moved = f"transform(b{turn}, (c, i) -> if(i % 2 = {parity}, pmod(c + 1 + pmod(cast(conv(substr(h, i * 4 + 1, 4), 16, 10) as int), 255), 256), c))"
        state = f"transform(array({state}), b{turn} -> transform(array(sha2(concat({key}, '|ip|{turn}|', {other}), 512)), h -> {moved})[0])[0]"
    return f"array_join(transform({state}, x -> cast(x as string)), '.')"


def kind_of(entity: str) -> str:
    """SQL for the kind of an entity. Whatever matched one of the patterns matches it on its own."""
    cases = " ".join(f"when {entity} rlike {_quoted('^(?:' + p + ')$')} then '{k}'" for k, p in PATTERNS.items())
    return f"case {cases} end"


def surrogate(entity: str, key: str) -> str:
    """SQL for the surrogate of an entity (an SQL name) under a key."""
    q = _quoted(key)

    def tweaked(kind: str, kept: str, part: str, alphabets: list[str]) -> str:
        return _network(part, f"concat({q}, '|{kind}|', lower({kept}), '|', cast(length({part}) as string))", alphabets)

    def digits(kind: str, part: str) -> str:
        """The digits alone go through the network; all else stays in its place."""
        moved = tweaked(kind, "''", "n", ALPHABETS[:1])
        put = f"transform(split(s, ''), (c, i) -> if(c rlike '[0-9]', substr(d, length(regexp_replace(substr(s, 1, i + 1), '[^0-9]', '')), 1), c))"
        return f"transform(array({part}), s -> transform(transform(array(regexp_replace(s, '[^0-9]', '')), n -> {moved}), d -> array_join({put}, ''))[0])[0]"

    local, domain = f"substring_index({entity}, '@', 1)", f"substr({entity}, instr({entity}, '@'))"
    code = f"regexp_extract({entity}, {_quoted(CODE)}, 0)"
    title = f"regexp_extract({entity}, '^[^ ]+ ', 0)"
    names = f"array_join(transform(split(substr({entity}, length({title}) + 1), ' '), w -> {name_part('w', key)}), ' ')"
    return f"""case {kind_of(entity)}
      when 'email' then concat({tweaked('email', domain, local, ALPHABETS)}, {domain})
      when 'ip' then {_address(entity, q)}
      when 'phone' then concat({code}, {digits('phone', f'substr({entity}, length({code}) + 1)')})
      when 'secret' then {tweaked('secret', "''", entity, HEX_ALPHABETS)}
      when 'name' then concat({title}, {names})
      else {digits('card', entity)} end"""


def name_part(word: str, key: str) -> str:
    """SQL for the surrogate of one part of a name (of two letters or more); its last letter stays."""
    tweak = f"concat({_quoted(key)}, '|name||', cast(length({word}) - 1 as string))"
    return f"concat({_network(f'substr({word}, 1, length({word}) - 1)', tweak, ALPHABETS)}, right({word}, 1))"


def entities(text: Column | str = "text") -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(f"({ANY})"), F.lit(0))


def replace(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_entities, found, surrogates, replaced), a row a document; ``replaced`` is the new text."""
    out = with_scripts(by_id(docs)).withColumn("found", entities()).withColumn("pieces", F.split("text", ANY, -1))
    out = out.withColumn("surrogates", F.when(F.size("found") == 0, F.array().cast("array<string>")).otherwise(F.expr(f"transform(found, e -> {surrogate('e', key)})")))
    # (first entity, word) of each part of a name; a word between entities that was named before goes the same way
    name = _quoted("^(?:" + PATTERNS["name"] + ")$")
    out = out.withColumn("named", F.expr(f"flatten(transform(found, (e, i) -> if(e rlike {name}, transform(slice(split(e, ' '), 2, 2), w -> named_struct('i', i, 'w', w)), array())))"))
    token = f"if(exists(named, x -> x.i < i and x.w = t), {name_part('t', key)}, t)"
    bare = f"array_join(transform(regexp_extract_all(p, {_quoted(_TOKENS)}, 0), t -> {token}), '')"
    out = out.withColumn("pieces", F.when(F.size("named") > 0, F.expr(f"transform(pieces, (p, i) -> if(exists(named, x -> x.i < i and contains(p, x.w)), {bare}, p))")).otherwise(F.col("pieces")))
    replaced = F.when(F.size("found") == 0, F.col("text")).otherwise(F.expr("array_join(zip_with(pieces, surrogates, (p, s) -> concat(coalesce(p, ''), coalesce(s, ''))), '')"))
    return out.select("doc_id", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_entities"), "found", "surrogates", replaced.alias("replaced"))


def collisions(replaced: DataFrame) -> DataFrame:
    """(surrogate, n): surrogates that stand for two or more entities (case aside); none by construction."""
    pairs = replaced.select(F.explode(F.arrays_zip("found", "surrogates")).alias("z")).select(F.lower("z.found").alias("entity"), F.lower("z.surrogates").alias("surrogate")).distinct()
    return pairs.groupBy("surrogate").agg(F.count("*").alias("n")).where("n > 1")
