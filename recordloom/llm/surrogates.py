"""Surrogates for personal data, in DataFrame functions only.

Entities are found by patterns: e-mail addresses, phone numbers, card numbers, social
security numbers, IBANs, IPv4 and IPv6 addresses, long hexadecimal secrets, and persons
named with a title. Names that a title has shown are then known in the whole text: the
same given or family name without a title gets the same surrogate there. A mention is cut into parts; a part that identifies (a mail box, a mail
domain, the digits of a number, a given name, a family name) has a canonical form,
and its surrogate depends on key, kind and canonical form alone. So each mention of a
person or number gets the same surrogate in every document, in the format of the
mention: separators, letter case, script and title stay, a card keeps its first digit and its check sum, a phone its country code. A given name has one gender in all texts, and its surrogate the
same: that of the titles it is seen with, or none in particular where they differ or tell nothing.

Distinctness: surrogates are checked against each other and against the originals of
their kind; of those that collide all but one draw again, until none is left. From
the fourth draw on words grow by a syllable, letter or further given name, so there is
always room; addresses whose private network is used up move to a larger one, and
then to any. Other numbers keep their length.

The pattern runs over all texts once; what it has found is written beside the rows, in
the shared folder. Texts without entities are not shuffled. Those with entities meet a
map of their own mentions, joined by a row number.

Defined cases: null texts stay null; texts without entities stay as they are; repeated
rows and null ids are rows of their own; an empty table gives an empty result; further
columns are carried, whatever their names. An IPv6 address in another spelling counts as
another address.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.llm.common import saved

# Titles by the gender that they tell.
TITLES = {
    "m": "Mr|Herr|Monsieur|Sr|Señor|Don|Господин|Г-н|Κύριος",
    "f": "Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora|Doña|Госпожа|Г-жа|Κυρία",
    "n": "Dr|Prof",
}
# Given names by script and gender, and syllables of family names by script.
GIVEN = {
    "Latin": {
        "m": "Adrian Bruno Carl David Emil Felix Gustav Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul".split(),
        "f": "Alma Berta Clara Dora Emma Frida Greta Hanna Ida Julia Karin Lena Marta Nora Olga Petra".split(),
        "n": "Alex Andrea Chris Dominique Eden Jordan Kim Lou Maxime Morgan Noa Robin Sacha Sam Toni Vivian".split(),
    },
    "Cyrillic": {
        "m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Степан Фёдор".split(),
        "f": "Алина Вера Галина Дарья Елена Жанна Зоя Инна Кира Лидия Мария Нина Ольга Полина Раиса Софья".split(),
        "n": "Валя Женя Саша Слава Шура Паша Тоша Лёша".split(),
    },
    "Greek": {
        "m": "Άγγελος Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Λεωνίδας Μάριος Νίκος Πέτρος Σπύρος Φώτης".split(),
        "f": "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Ρένα Σοφία Χρύσα".split(),
        "n": "Άγις Άρης Κική Λίλα".split(),
    },
}
FAMILY = {
    "Latin": ("Al Ber Cor Dan El Far Gran Hol Is Jan Kel Lar Mor Nor Os Pel".split(), "an ber den er feld gard in ler man nes ow rin sen ton vik well".split()),
    "Cyrillic": ("Бел Вол Гор Дол Ел Жар Зим Кал Лес Мор Нов Ор Пет Руд Сол Тих".split(), "анов енко еров иков инский ман овский оленко".split()),
    "Greek": ("Αλεξ Βαρ Γαλ Δημ Καρ Λαμπ Μαν Νικ Παπ Στεφ".split(), "άκης ίδης όπουλος ούσης άς ιανός".split()),
}
ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäçèéêëìíîïñòóôöùúûü", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ",
    "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
RANGES = ["09", "az", "AZ", "ßÿ", "ÀÞ", "аё", "АЯ", "άώ", "ΆΫ"]

_NAME = r"\p{Lu}[\p{L}'’\-]*\p{L}"
_SPELLED = {g: f"{t}|{t.upper()}" for g, t in TITLES.items()}
_ANY_TITLE = "|".join(_SPELLED.values())
_HEX = "[0-9a-fA-F]{1,4}"
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+\-]*@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,128}(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}.])(?:\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.\-])(?:\d{4}[ \-]\d{6}[ \-]\d{5}|(?:\d{4}[ \-]?){3}\d{1,7})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}.\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9a-fA-F:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::{_HEX}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_ANY_TITLE})\.?[ \t]{_NAME}(?:[ \t]{_NAME})?",
}
PATTERN = "|".join(PATTERNS.values())
NAME_PATTERN = rf"(?<![\p{{L}}\p{{N}}]){_NAME}(?![\p{{L}}\p{{N}}])"
MAY_HOLD = r"[0-9@]|(?:" + _ANY_TITLE + r")\.?[ \t]\p{Lu}"
MARK, ESCAPE = "\ue000", "\ue001"
ESCAPES = [(ESCAPE, "\ue001\ue002"), (MARK, "\ue001\ue003")]
DRAWS = 64
WIDER, WIDEST = 16, 32  # draws from which addresses move to 10.0.0.0/8, and to any network


def _first_match(value: Column, choices: dict[str, str], default: str) -> Column:
    return reduce(lambda rest, x: F.when(value.rlike(x[1]), F.lit(x[0])).otherwise(rest), reversed(choices.items()), F.lit(default))


def _part(kind: Column, canonical: Column, text: Column) -> Column:
    return F.struct(kind.alias("kind"), canonical.alias("canonical"), text.alias("text"))


def _kept(text: Column) -> Column:
    return _part(F.lit(None).cast("string"), F.lit(None).cast("string"), text)


def mention_parts() -> Column:
    """The parts of the mention in column ``raw`` of kind ``kind``."""
    raw, kind = F.col("raw"), F.col("kind")
    at = F.instr(raw, "@")
    box, domain = F.substring(raw, F.lit(1), at - 1), F.substring(raw, at + 1, F.length(raw))
    top = F.regexp_extract(domain, r"\.[^.]+$", 0)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.array(_part(F.lit("box"), F.lower(raw), box), _kept(F.lit("@")), _part(F.lit("host"), F.lower(host), host), _kept(top))
    title = F.regexp_extract(raw, rf"^(?:{_ANY_TITLE})\.?[ \t]", 0)
    gender = _first_match(title, {g: rf"^(?:{t})\.?[ \t]$" for g, t in _SPELLED.items()}, "n")
    names = F.split(F.substring(raw, F.length(title) + 1, F.length(raw)), r"[ \t]")
    script = lambda name: F.when(name.rlike(r"\p{IsCyrillic}"), F.lit("Cyrillic")).when(name.rlike(r"\p{IsGreek}"), F.lit("Greek")).otherwise(F.lit("Latin"))
    given, family = names[0], F.element_at(names, -1)
    family_part = _part(F.concat(F.lit("family "), script(family)), F.lower(family), family)
    given_part = _part(F.concat(F.lit("given "), script(given), F.lit(" "), gender), F.lower(given), given)
    person = F.when(F.size(names) > 1, F.array(_kept(title), given_part, _kept(F.lit(" ")), family_part)).otherwise(F.array(_kept(title), family_part))
    country = F.when(kind == "phone", F.regexp_extract(raw, r"^\+\d{1,3}(?=[ .\-(])", 0)).when(kind == "iban", F.substring(raw, 1, 2)).otherwise(F.lit(""))
    rest = F.substring(raw, F.length(country) + 1, F.length(raw))
    number = F.array(_kept(country), _part(kind, F.upper(F.regexp_replace(rest, r"[^\p{L}\p{N}]", "")), rest))
    address = F.array(_part(kind, raw, raw))
    return F.when(kind == "email", email).when(kind == "person", person).when(kind == "ip", address).otherwise(number)


def _stream(key: str, length: Column) -> Column:
    """Hexadecimal digits, two for each place, from key, kind, canonical form and draw."""
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "canonical", F.col("draw").cast("string"))
    return F.array_join(F.transform(F.sequence(F.lit(0), (length / 64).cast("int")), lambda k: F.sha2(F.concat_ws("\x1f", seed, k.cast("string")), 512)), "")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int") + 1)


def _syllable(ends: list[str], stream: Column, i: Column) -> Column:
    return F.when(i > 0, _pick(ends, _byte(stream, i + 8))).otherwise(F.lit(""))


def _substituted(text: Column, stream: Column) -> Column:
    """Every digit and letter replaced by another of its alphabet."""

    def replaced(c, i):
        out = c
        for alphabet, (low, high) in zip(reversed(ALPHABETS), reversed(RANGES)):
            letter = F.substring(F.lit(alphabet), F.pmod(_byte(stream, i), F.lit(len(alphabet))) + 1, F.lit(1))
            out = F.when((c >= low) & (c <= high), letter).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), replaced), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10; the last digit counts once."""
    terms = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2 % 10) + (c.cast("int") / 5).cast("int")), F.lit(0)))
    return F.aggregate(terms, F.lit(0), lambda s, x: s + x) % 10


def _candidates(parts: DataFrame, key: str) -> DataFrame:
    """Adds the surrogate of the canonical form for the current draw."""
    kind, form = F.col("kind"), F.col("canonical")
    stream, draw = F.col("stream"), F.col("draw")
    number = F.conv(F.substring(stream, 1, 12), 16, 10).cast("long")
    more = F.greatest(draw - 3, F.lit(0))
    box = _substituted(F.regexp_replace(form, "@.*$", ""), stream)
    letters = F.substring(_substituted(F.repeat(F.lit("a"), 64), stream), F.lit(1), more)
    word = F.concat(F.when(kind == "box", box).otherwise(_substituted(form, stream)), letters)
    card = F.concat(F.substring(form, 1, 1), F.substring(_substituted(form, stream), F.lit(2), F.length(form) - 2))
    check = F.pmod(_luhn(form) - _luhn(F.concat(card, F.lit("0"))), F.lit(10)).cast("string")
    octet = lambda i: (F.pmod(_byte(stream, F.lit(i)), F.lit(254)) + 1).cast("string")
    prefix = F.regexp_extract(form, r"^(?:10\.|127\.|192\.168\.|169\.254\.)", 0)
    prefix = F.when(draw >= WIDEST, F.lit("")).when((draw >= WIDER) & (F.length(prefix) > 4), F.lit("10.")).otherwise(prefix)
    kept = F.size(F.split(prefix, r"\.")) - 1
    octets = F.array(*[octet(i) for i in range(4)])
    address = F.concat(prefix, F.array_join(F.slice(octets, F.lit(1), 4 - kept), "."))
    digits = F.upper(F.substring(stream, F.lit(1), F.length(form)))
    name = F.lit(None).cast("string")
    for script, (stems, ends) in FAMILY.items():
        longer = F.array_join(F.transform(F.sequence(F.lit(0), more), partial(_syllable, ends, stream)), "")
        name = F.when(kind == f"family {script}", F.concat(_pick(stems, number), longer, _pick(ends, F.floor(number / 1024)))).otherwise(name)
        for gender, given in GIVEN[script].items():
            further = F.array_join(F.transform(F.sequence(F.lit(0), more), partial(_syllable, [f"-{x}" for x in given], stream)), "")
            name = F.when(kind == f"given {script} {gender}", F.concat(_pick(given, number), further)).otherwise(name)
    surrogate = F.when(kind.isin("box", "host"), word).when(kind == "card", F.concat(card, check)).when(kind == "ip", address).when(kind.isin("secret", "ip6"), digits)
    surrogate = surrogate.when(kind.rlike("^(?:family|given)"), name).otherwise(_substituted(form, stream))
    return parts.withColumn("stream", _stream(key, F.length("canonical"))).withColumn("surrogate", surrogate).drop("stream")


def surrogate_table(parts: DataFrame, key: str) -> DataFrame:
    """kind, canonical, surrogate: distinct within a kind, and none an original of its kind. ``parts`` is distinct."""
    originals = parts.select("kind", F.lower("canonical").alias("name"))
    waiting, done = parts.withColumn("draw", F.lit(0)), None
    for draw in range(DRAWS):
        drawn = saved(_candidates(waiting.withColumn("draw", F.lit(draw)), key).withColumn("name", F.lower("surrogate")), "surrogates")
        fresh = drawn.join(originals, ["kind", "name"], "left_anti")
        if done is not None:
            fresh = fresh.join(done.select("kind", "name"), ["kind", "name"], "left_anti")
        winners = fresh.groupBy("kind", "name").agg(F.min("canonical").alias("canonical"))
        good = saved(drawn.join(winners, ["kind", "name", "canonical"]).select("kind", "canonical", "surrogate", "name"), "distinct-surrogates")
        done = good if done is None else done.unionAll(good)
        waiting = drawn.join(good.select("kind", "canonical"), ["kind", "canonical"], "left_anti").select("kind", "canonical", "draw")
        if waiting.isEmpty():
            return done.drop("name")
    raise ValueError(f"some surrogates still collide after {DRAWS} draws")


def _like(text: Column, word: Column) -> Column:
    """A word in the letter case of a text: all capital, all small, or as it is."""
    shouted = (F.upper(text) == text) & (F.lower(text) != text)
    return F.when(shouted & (F.length(text) > 1), F.upper(word)).when(F.lower(text) == text, F.lower(word)).otherwise(word)


def _formatted() -> Column:
    """The surrogate in the format of the part's text: separators and letter case."""
    text, surrogate, kind = F.col("part.text"), F.col("surrogate"), F.col("part.kind")
    held = F.split(surrogate, "")

    def cased(c, i):
        mine = F.substring(text, i + 1, F.lit(1))
        return F.when((F.upper(mine) == mine) & (F.lower(mine) != mine), F.upper(c)).otherwise(c)

    address = F.array_join(F.transform(held, cased), "")

    def filled(c, i):
        place = F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
        mine = F.get(held, place - 1)
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.when(F.lower(c) == c, F.lower(mine)).otherwise(mine)).otherwise(c)

    number = F.array_join(F.transform(F.split(text, ""), filled), "")
    return F.when(kind.isNull(), text).when(kind.isin("box", "host", "ip"), address).when(kind.rlike("^(?:family|given)"), _like(text, surrogate)).otherwise(number)


def mentions(text: Column) -> Column:
    """The distinct mentions in a text; null where there are none."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    return F.when(text.rlike(MAY_HOLD), found)


def _kind_of(raw: Column) -> Column:
    order = ["email", "person", "iban", "secret", "ip", "ip6", "ssn", "card", "phone"]
    return _first_match(raw, {k: f"^(?:{PATTERNS[k]})$" for k in order}, "phone")


def _one_gender(cut: DataFrame) -> DataFrame:
    """The parts of mentions, with every given name in the gender that its titles agree on, else "n"."""
    kind, name = F.col("part.kind"), F.col("part.canonical")
    script = F.regexp_extract(kind, "^given (.*) [mfn]$", 1)
    seen = cut.filter(kind.startswith("given")).select(script.alias("s"), name.alias("c"), F.right(kind, F.lit(1)).alias("g"))
    genders = seen.groupBy("s", "c").agg(F.bool_or(F.col("g") == "m").alias("m"), F.bool_or(F.col("g") == "f").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), F.lit("m")).when(F.col("f") & ~F.col("m"), F.lit("f")).otherwise(F.lit("n"))
    known = genders.select("s", "c", F.concat(F.lit("given "), F.col("s"), F.lit(" "), gender).alias("given_kind"))
    joined = cut.join(known, kind.startswith("given") & (script == F.col("s")) & (name == F.col("c")), "left")
    part = _part(F.coalesce("given_kind", kind), name, F.col("part.text")).alias("part")
    return joined.select("raw", "at", part)


def mention_parts_table(raws: DataFrame, key: str) -> DataFrame:
    """raw, at, part and surrogate (null for a part that stays) of the distinct mentions ``raws``."""
    distinct = saved(raws.select("raw").distinct().withColumn("kind", _kind_of(F.col("raw"))), "distinct-mentions")
    cut = saved(distinct.select("raw", F.posexplode(mention_parts()).alias("at", "part")), "mention-parts")
    cut = saved(_one_gender(cut), "mention-parts")
    parts = cut.filter("part.kind is not null").select("part.kind", "part.canonical").distinct()
    table = surrogate_table(saved(parts, "parts"), key).withColumnsRenamed({"kind": "k", "canonical": "c"})
    joined = cut.join(table, (F.col("part.kind") == F.col("k")) & (F.col("part.canonical") == F.col("c")), "left")
    return saved(joined.select("raw", "at", "part", "surrogate"), "surrogate-parts")


def _replacements(parts: DataFrame) -> DataFrame:
    """raw, replacement for each distinct mention."""
    pieces = parts.select("raw", F.struct("at", _formatted().alias("text")).alias("piece"))
    return pieces.groupBy("raw").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), "").alias("replacement"))


def replaced_text(text: Column, known: Column, names: Column) -> Column:
    """The text with every mention that the map ``known`` holds replaced, and every capitalised word that
    ``names`` holds in small letters."""
    safe = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), ESCAPES, text)
    marked = lambda pattern: F.regexp_replace(safe, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}"))
    parts = F.split(F.when(names.isNotNull(), marked(f"{PATTERN}|{NAME_PATTERN}")).otherwise(marked(PATTERN)), MARK, -1)

    def surrogate(p, i):
        name = F.try_element_at(names, F.lower(p))
        return F.when(i % 2 == 1, F.coalesce(F.try_element_at(known, p), _like(p, name), p)).otherwise(p)

    joined = F.array_join(F.transform(parts, surrogate), "")
    return reduce(lambda t, x: F.replace(t, F.lit(x[1]), F.lit(x[0])), reversed(ESCAPES), joined)


def with_surrogates(docs: DataFrame, key: str, counted: str = "__replaced") -> DataFrame:
    """``docs`` with surrogates in ``text``, which comes after the other columns, and the number of distinct mentions replaced in the column ``counted``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    looked = docs.select(whole, F.monotonically_increasing_id().alias("row"), mentions(F.col("text")).alias("raws"))
    rows = saved(looked, "mentions")
    some = F.coalesce(F.size("raws"), F.lit(0)) > 0
    found = rows.filter(some).select("row", F.explode("raws").alias("raw"))
    parts = mention_parts_table(found, key)
    pairs = found.join(saved(_replacements(parts), "replacements"), "raw")
    maps = pairs.groupBy(F.col("row").alias("at_row")).agg(F.map_from_entries(F.collect_list(F.struct("raw", "replacement"))).alias("known"))
    kind = F.col("part.kind")
    named = parts.filter(kind.rlike("^(?:family|given)")).select("raw", F.col("part.canonical").alias("name"), F.struct(~kind.startswith("family"), "surrogate").alias("s"))
    per_row = found.join(named, "raw").groupBy("row", "name").agg(F.min("s").alias("s"))  # a name that is both counts as a family name
    names = per_row.groupBy(F.col("row").alias("named_row")).agg(F.map_from_entries(F.collect_list(F.struct("name", "s.surrogate"))).alias("names"))
    kept = lambda text: [*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != "text"], text.alias("text")]
    plain = rows.filter(~some).select(*kept(F.col("doc.text")), F.lit(0).alias(counted))
    changed = rows.filter(some).join(maps, F.col("row") == F.col("at_row"), "left").join(names, F.col("row") == F.col("named_row"), "left")
    text = replaced_text(F.col("doc.text"), F.col("known"), F.col("names"))
    changed = changed.select("doc", text.alias("new"), F.coalesce(F.size("known"), F.lit(0)).alias("found"))  # a step of its own: further columns may be called like these
    return plain.unionAll(changed.select(*kept(F.col("new")), F.col("found").alias(counted)))
