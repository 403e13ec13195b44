"""Surrogates of persons and numbers: one person, one surrogate, wherever and however a name stands."""

import random
import re

from pyspark.sql import functions as F

from recordloom.llm import surrogates


def texts_of(spark, rows, key="k"):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in surrogates.with_surrogates(df, key).collect()}


def test_one_person_has_one_surrogate_with_and_without_titles(spark):
    rows = [
        (1, "Mr John Smith met Dr John Smith. Later John Smith left; Smith smiled."),
        (2, "MR. JOHN SMITH-JONES and Mr John called. SMITH-JONES waved, Blacksmith did not."),
        (3, "John Smith is named here without a title, and Smith too."),
        (4, "Dr Kim Berg and Mrs Kim Berg and Prof. Kim Berg; Κύριος Νίκος Παπάς, ΚΎΡΙΟΣ ΝΊΚΟΣ ΠΑΠΆΣ"),
    ]
    got = texts_of(spark, rows)
    first = re.fullmatch(r"Mr (\w+) (\w+) met Dr (\w+) (\w+)\. Later (\w+) (\w+) left; (\w+) smiled\.", got[1])
    given, family = first[1], first[2]
    assert first.groups() == (given, family, given, family, given, family, family) and "John" not in got[1] and "Smith" not in got[1]
    assert given in surrogates.GIVEN["Latin"]["m"]
    second = re.fullmatch(r"MR\. (\S+) (\S+) and Mr (\S+) called\. (\S+) waved, Blacksmith did not\.", got[2])
    assert second[1] == given.upper() and second[2] == second[4] and second[2].isupper() and "SMITH" not in got[2]
    assert got[3] == rows[2][1]  # no title shows these names in this text
    third = re.fullmatch(r"Dr (\w+) (\w+) and Mrs (\w+) (\w+) and Prof\. (\w+) (\w+); Κύριος (\w+) (\w+), ΚΎΡΙΟΣ (\w+) (\w+)", got[4])
    assert third[1] == third[3] == third[5] and third[2] == third[4] == third[6] and third[1] in surrogates.GIVEN["Latin"]["f"]
    assert third[7].upper() == third[9] and third[7] in surrogates.GIVEN["Greek"]["m"]


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 % 10 + d * 2 // 10 for k, d in enumerate(reversed(list(map(int, digits))))) % 10


def test_cards_of_15_digits_and_ipv6(spark):
    text = "card 3782 822463 10005 or 378282246310005, hosts 2001:db8::8a2e:370:7334, 2001:0db8:85a3:0000:0000:8a2e:0370:7334 and ::1:2; at 12:30:45 std::vector a::b"
    got = texts_of(spark, [(1, text)])[1]
    found = re.fullmatch(r"card (\d{4} \d{6} \d{5}) or (\d{15}), hosts (\S+::\S+:\S+:\S+), ((?:[0-9a-f]{4}:){7}[0-9a-f]{4}) and ::(\w):(\w); at 12:30:45 std::vector a::b", got)
    assert found and found[1].replace(" ", "") == found[2] != "378282246310005" and found[2][0] == "3" and luhn(found[2]) == luhn("378282246310005")
    assert found[3] != "2001:db8::8a2e:370:7334" and [len(x) for x in found[3].split(":")] == [4, 3, 0, 4, 3, 4] and re.fullmatch("[0-9a-f:]+", found[3])


TEMPLATES = [
    "{title} {given} {family} wrote. {family} agreed, so did {given} {family}. <{mail}>",
    "Call {phone}, says {title} {family}; {FAMILY} repeats: {phone} or {mail}",
    "Card {card}; payer {title} {given} {family} ({mail}). {given} paid.",
]


def test_twin_in_python(spark):
    """Texts made from templates: reading the results by the same templates gives back one surrogate per entity."""
    rng = random.Random(4)
    people = [(t, g, f) for t, g in (("Mr", "Tobias"), ("Mrs", "Wilma"), ("Dr", "Quentin"), ("Herr", "Ignaz")) for f in ("Quarrel", "Zeppo", "Oakham", "Tillman", "Vandermeer")]
    entities = []
    for i, (title, given, family) in enumerate(people):
        card = f"4{rng.randrange(10**14):014d}"
        card += str(-luhn(card + "0") % 10)
        entities.append({"title": title, "given": given, "family": family, "FAMILY": family.upper(), "mail": f"{given.lower()}.{i}@host{i % 7}.example.org", "phone": f"+1 ({200 + i}) 555-{1000 + 7 * i}", "card": card})
    made = [(rng.randrange(len(TEMPLATES)), rng.choice(entities)) for _ in range(120)]
    rows = [(i, TEMPLATES[t].format(**e)) for i, (t, e) in enumerate(made)]
    got = texts_of(spark, rows + [(1000 + i, text) for i, text in rows])
    seen: dict[tuple[str, str], set] = {}
    for i, (t, e) in enumerate(made):
        assert got[i] == got[1000 + i]
        names = iter(re.findall(r"\{(\w+)\}", TEMPLATES[t]))
        pattern = re.sub(r"\\\{\w+\\\}", lambda _: f"(?P<x{next(counter)}>.+?)", re.escape(TEMPLATES[t])) if (counter := iter(range(99))) else ""
        found = re.fullmatch(pattern, got[i])
        assert found, (pattern, got[i])
        for name, value in zip(names, found.groups()):
            kind = "family" if name == "FAMILY" else name
            assert name != "FAMILY" or value.isupper()
            seen.setdefault((kind, e[kind]), set()).add(value.lower() if kind in ("family", "mail") else value)
    for (kind, original), values in seen.items():
        assert len(values) == 1, (kind, original, values)
        value = next(iter(values))
        assert value == original if kind == "title" else value.lower() != original.lower()
        assert kind != "card" or (luhn(value) == 0 and value[0] == original[0])
    for kind in ("given", "family", "mail", "phone", "card"):
        values = [next(iter(v)) for (k, _), v in seen.items() if k == kind]
        assert len(values) == len(set(values)) > 2


def test_columns_of_any_name_and_rows_of_one_id(spark):
    names = ["row", "raw", "raws", "doc", "known", "names", "at_row", "named_row", "kind", "part"]
    rows = [(None, "Mr Ott Quux. Quux", *names), (None, "Quux alone", *names), (5, None, *names), (5, "a " * 50_000 + "Mrs Ida Quux", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)).withColumn("z.dot", F.lit(1))
    got = surrogates.with_surrogates(df, "k", counted="n")
    assert got.columns == [*[c for c in df.columns if c != "text"], "text", "n"]
    out = sorted(((r["text"] or "")[-40:], r["n"]) for r in got.collect())
    assert len(out) == 4 and ("Quux alone", 0) in out and ("", 0) in out and sum("Quux" in t for t, _ in out) == 1
    assert all(tuple(r[n] for n in names) == tuple(names) for r in got.collect())
