"""Each operator on a small table of awkward rows, against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from recordloom.llm import exact_dedup, external_shuffle, id_files, longest_match, mixing, near_dedup, packing, prob_minhash, surrogates, toxicity, vector_dedup
from recordloom.llm.word_ids import WordIds
from recordloom.session import fresh_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PROSE = " ".join(f"word{i % 97} is{i % 31} here{i % 13}" for i in range(40))
ROWS = [
    (1, "one two three four five six seven", "s1"),
    (2, "one  two\tthree four five six seven", "s1"),
    (3, None, "s1"),
    (4, "", None),
    (5, " ", "s2"),
    (6, PROSE, "s2"),
    (7, PROSE + " tail", "s2"),
    (8, PROSE + " tail", "s2"),
    (9, "long " * 9000 + "end", "s3"),
    (9, "long " * 9000 + "end", "s3"),
    (10, "two words", "s3"),
    (None, "two words", "s3"),
    (None, "中文 Ünïcode 😀 <|endoftext|>", None),
]
SCHEMA = "doc_id long, text string, source string"
NAMES = ["kept", "bucket", "score", "component", "row", "length", "digest", "released"]


@pytest.fixture(scope="module")
def docs(spark):
    """The rows above with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({n: F.lit(n) for n in NAMES}).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(docs, empty):
    import hashlib

    groups = defaultdict(list)
    for i, text, _ in ROWS:
        groups[spaced(text)].append(i)
    expected = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        expected += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    for history, batch in ((docs.filter("doc_id < 8"), docs.filter("doc_id >= 8 or doc_id is null")), (docs.filter("doc_id > 5"), docs.filter("doc_id <= 5 or doc_id is null")), (empty, docs), (docs, empty)):
        got = [tuple(r) for r in exact_dedup.exact_dedup(history, batch).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert exact_dedup.exact_dedup(empty, empty).collect() == []
    kept = exact_dedup.drop_repeats(docs.filter("doc_id < 8"), docs.filter("doc_id >= 8 or doc_id is null"))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 5, 6, 7, 9, 10, None], key=str)


def test_near_dedup(docs, empty):
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in near_dedup.classes(docs).collect()), key=str)
    classes = {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6, 9: 9, 10: 10}
    expected = [(i, classes[i], i == classes[i]) for i in [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10]] + [(None, 10, False), (None, None, True)]
    assert got == sorted(expected, key=str)
    assert near_dedup.classes(empty).collect() == []
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 9, 10, None, None], key=str)


def test_near_dedup_finds_all_links_of_many_variants(spark):
    """One text in many variants: buckets with several components, small and large."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    root = list(range(150))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(150):
        for j in range(i):
            if len(sets[i] & sets[j]) * 100 >= len(sets[i] | sets[j]) * 80:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(150)} and 1 < len(set(got.values())) < 150


def test_near_dedup_compares_all_pairs_that_banding_finds(spark):
    """Two links in a bucket whose leader is another text, with signatures that agree nowhere."""
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:30], "x" * 200, *words[31:]]), *(" ".join(f"{x}{i}" for i in range(60)) for x in "pq")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = prob_minhash.new_word_hashes()
    nodes = []
    for i, text in enumerate(texts):
        found = prob_minhash.shingles(text, hashes)[0]
        bands = [[1], [1], [1, 2], [2]][i]
        nodes.append((bytearray(prob_minhash.set_key(found)), i, hashlib.sha256(text.encode()).digest(), bands, len(found), [i] * prob_minhash.PLACES))
    nodes = spark.createDataFrame(nodes, "key binary, rep_id long, rep_digest binary, bands array<long>, extent int, sketch array<tinyint>")
    keys = {r["key"]: r["rep_id"] for r in nodes.collect()}
    assert {frozenset((keys[r["a"]], keys[r["b"]])) for r in near_dedup.links(docs, nodes).collect()} == {frozenset((0, 1))}


def test_near_dedup_of_texts_that_differ_in_one_long_token(spark):
    """Plain similarity 41/51, just a link; by length the long token would outweigh the rest."""
    texts = []
    for pair in range(30):
        words = [f"{pair:02}{i:03}" for i in range(50)]
        texts += [" ".join([*words[:25], c * 100, *words[26:]]) for c in "xy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()} == {i: i // 2 * 2 for i in range(60)}


def test_near_dedup_keeps_unrelated_texts_that_share_a_doc_id_or_have_none(spark):
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " end"), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[4]), (9, texts[4] + " end"), (None, ""), (None, "")]
    kept = [tuple(r) for r in near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    second = [t for i, t in kept if t in (texts[1], texts[1] + " end")]
    assert len(second) == 1
    assert Counter(kept) == Counter([(None, texts[0]), (None, second[0]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (None, ""), (None, "")])


def expected_ids(text, end):
    tokenizer = WordIds(TOKENIZER).tokenizer
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, empty):
    got = packing.packed_pieces(docs, TOKENIZER).collect()
    expected = []
    for i, text, _ in ROWS:
        ids = expected_ids(text, 0)
        expected += [(i, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.packed_pieces(empty, TOKENIZER).collect() == []


def test_packing_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 50)
    lengths = [(i, int(n)) for i, n in enumerate(np.random.default_rng(0).integers(1, 100, 400))] + [(i, 60) for i in range(400, 470)] + [(500, 100), (501, 1)]
    got = packing.pack(spark.createDataFrame(lengths, "row long, length long"), 100).collect()
    sums = Counter()
    for r in got:
        sums[r["sequence_id"]] += r["length"]
    assert sorted((r["row"], r["length"]) for r in got) == sorted(lengths) and max(sums.values()) <= 100
    assert len(sums) <= 1.12 * max(sum(n for _, n in lengths) / 100, sum(n > 50 for _, n in lengths)) + 2


def test_id_files(spark, docs, empty):
    folder = fresh_folder(spark, "ids")
    manifest = id_files.write_ids(docs, TOKENIZER, 2, folder, tokens_per_file=5000, partitions=2).persist()
    got = id_files.read_ids(manifest, keep_ids=True).orderBy("start").collect()
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in ordered]
    assert sorted((r["doc_id"], tuple(r["ids"]), r["ids_crc32"]) for r in got if r["doc_id"] is not None) == sorted((i, tuple(expected_ids(t, 2)), crc(expected_ids(t, 2))) for i, t, _ in ROWS if i is not None)
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    one = id_files.IdFile(manifest.orderBy("part", "seq").first()["path"])
    assert one.width == 2 and [(n, ids.tolist()) for n, ids in (one.document(i) for i in range(one.n_docs))] == [(n, ids.tolist()) for n, _, ids in one.documents()]
    assert id_files.written_and_read(spark, empty, TOKENIZER, 2).collect() == []


def test_vector_dedup(spark):
    e = [1.0, 0.0, 0.0]
    rows = [
        (1, e, 0), (2, [2.0, 0.0, 0.0], 0), (3, [1.0, 0.1, 0.0], 0), (4, e, 1), (5, e, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 0.0], 0),
        (9, [float("nan"), 1.0, 0.0], 0), (10, [float("inf"), 1.0, 0.0], 0), (11, [1.0, 0.0], 0), (12, [], 0), (3, [1.0, 0.1, 0.0], 0), (None, [0.0, 1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS links")
    got = sorted((tuple(r) for r in vector_dedup.near_vectors(df).collect()), key=str)
    linked = {1: (3, 1), 2: (3, 1), 3: (3, 1)}
    expected = [(i, *linked.get(i, (0, i)), linked.get(i, (0, i))[1] == i) for i, *_ in rows]
    assert got == sorted(expected, key=str)
    assert vector_dedup.near_vectors(df.filter("false")).collect() == []


@pytest.mark.parametrize("bucket_bytes", [2000, 10**8])
def test_shards(docs, empty, bucket_bytes):
    rows = external_shuffle.shard_rows(docs, 4, bucket_bytes=bucket_bytes).collect()
    texts = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS]
    assert sorted((tuple(r)[:3] for r in rows), key=str) == sorted(texts, key=str)
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(4) for k in range(4 if s == 0 else 3)]
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    again = external_shuffle.shard_rows(docs.repartition(5), 4, bucket_bytes=bucket_bytes).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    carried = external_shuffle.sharded(docs, 4)
    assert set(docs.columns) < set(carried.columns) and external_shuffle.shard_rows(empty, 4).collect() == []


def test_one_id_that_overfills_its_bucket(spark):
    df = spark.range(4000).selectExpr("if(id < 2500, 7, id) AS doc_id", "repeat('x', 20) AS text")
    found = external_shuffle.sharded(df, 16, bucket_bytes=4000).groupBy("__shard").count().collect()
    assert [r["count"] for r in found] == [250] * 16


def test_mixing(docs, empty):
    rows = mixing.mix(docs, repeats=2.0).collect()
    tokens = Counter()
    ids = {}
    for i, text, source in ROWS:
        tokens[i] += max(1, len((text or "").split()))
        ids[i] = min(ids.get(i, source or ""), source or "")
    shares, drawn = Counter(), Counter()
    for i, n in tokens.items():
        shares[ids[i]] += n
    for r in rows:
        assert (r["tokens"], r["source"]) == (tokens[r["doc_id"]], ids[r["doc_id"]])
        drawn[r["source"]] += r["tokens"]
    weights = {r["source"]: r["weight"] for r in rows}
    assert math.isclose(sum(weights.values()), 1) and {r["doc_id"] for r in rows} == set(tokens)
    budget = max(n / weights[s] for s, n in shares.items())
    assert max(budget * weights[s] / n for s, n in shares.items()) <= 2.001
    for source, n in shares.items():
        assert drawn[source] >= budget * weights[source] - 1e-6 * n > drawn[source] - max(t for i, t in tokens.items() if ids[i] == source)
    assert mixing.mix(empty, repeats=2.0).collect() == []
    assert mixing.mixed_documents(docs, repeats=2.0).columns == docs.columns


@pytest.mark.parametrize("last", [1, 3])
def test_mixing_draws_every_document_of_a_large_source(spark, last):
    """Short documents beside a very long one: the end of an epoch is less than a millionth of it."""
    rows = spark.createDataFrame([(0, "a", 10**10), *((i, "a", last) for i in range(1, 200)), (200, "b", 5)], "doc_id long, source string, tokens long")
    drawn = Counter(r["doc_id"] for r in mixing.draws(rows, mixing.weighted(rows, repeats=1.5)).collect())
    assert set(drawn) == set(range(201)) and all(drawn[i] == 1 for i in range(200))


def test_exponents(spark):
    sources = spark.createDataFrame([(1000,), (100,), (10,)], "tokens long")
    share = np.array([1000, 100, 10]) / 1110

    def entropy(a):
        w = share**a / (share**a).sum()
        return -(w * np.log(w)).sum()

    a = mixing.exponent(sources, entropy=0.8)
    assert abs(entropy(a) - 0.8) < 1e-6
    a = mixing.exponent(sources, repeats=3.0)
    assert abs(100 ** (1 - a) - 3.0) < 1e-5
    w = share ** (b := mixing.exponent(sources, repeats=2.0, budget=1110.0))
    assert abs((w / w.sum() / share).max() - 2.0) < 1e-5 and 0 < b < 1
    assert mixing.exponent(sources, entropy=9.0) == 0.0 and mixing.exponent(sources, repeats=1.0) == 1.0


def test_token_counts(docs, empty):
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    automaton = longest_match.LongestMatch(*longest_match.sentencepiece_vocabulary(vocabulary))
    expected = []
    for i, text, _ in ROWS:
        found = [automaton.count(w) for w in re.findall(r"\w+|[^\w\s]", (text or "").lower())]
        expected.append((i, sum(max(n, 1) if n >= 0 else 1 for n in found), len(found), sum(n < 0 for n in found)))
    assert sorted((tuple(r) for r in longest_match.token_counts(docs, vocabulary).collect()), key=str) == sorted(expected, key=str)
    assert longest_match.token_counts(empty, vocabulary).collect() == []


def test_surrogates(spark, docs):
    rows = [
        (1, "Mr. John Smith wrote to JOHN.Smith3@mail7.example.com and john.smith3@mail7.example.com, +1 (017) 555-7713"),
        (2, "Mrs Ann Smith, card 4111 1111 1111 1111 or 4111111111111111, 10.0.0.7 and 97.51.17.173, SSN 123-45-6789"),
        (3, None), (4, ""), (5, "nothing  to  hide, 12 apples at 3.14"), (6, "Frau MÜLLER  a@b.co"), (7, "c@b.co"), (7, "a@b.co"), (None, "a@b.co"),
        (8, " ".join(f"{x}@b.co" for x in "abcdefghijklmnop")),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS raw", "'y' AS kind")
    got = surrogates.with_surrogates(df, key="k")
    assert got.columns == ["doc_id", "raw", "kind", "text", "__replaced"]
    texts = defaultdict(list)
    for r in got.collect():
        texts[r["doc_id"]].append(r["text"])
    first = re.fullmatch(r"Mr\. (\w+) (\w+) wrote to (\S+) and (\S+), \+1 \((\d{3})\) (\d{3})-(\d{4})", texts[1][0])
    second = re.fullmatch(r"Mrs (\w+) (\w+), card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}), (10\.\d+\.\d+\.\d+) and (\S+), SSN (\d{3}-\d{2}-\d{4})", texts[2][0])
    assert first and second and first[2] == second[2] != "Smith" and first[1] in surrogates.GIVEN["Latin"]["m"] and second[1] in surrogates.GIVEN["Latin"]["f"]
    assert first[3].lower() == first[4] and first[3][:4].isupper() and second[3].replace(" ", "") == second[4]
    digits = [int(d) for d in second[4]]
    assert digits[0] == 4 and sum(d if k % 2 == 0 else d * 2 % 10 + d * 2 // 10 for k, d in enumerate(reversed(digits))) % 10 == 0
    assert texts[3] == [None] and texts[4] == [""] and texts[5] == [rows[4][1]]
    assert re.fullmatch(r"Frau [A-ZÄÖÜ]+  \S+@\S+\.co", texts[6][0])
    assert texts[None] == [texts[6][0].split()[-1]] and set(texts[7]) >= set(texts[None])
    boxes = texts[8][0].split()
    assert len(set(boxes)) == 16 and not set(boxes) & set(rows[-1][1].split())
    assert surrogates.with_surrogates(df.filter("false"), key="k").collect() == []
    other = {r["doc_id"]: r["text"] for r in surrogates.with_surrogates(df.filter("doc_id = 2"), key="other").collect()}
    assert other[2] != texts[2][0]


def test_surrogates_have_room_for_many_given_names_and_addresses(spark):
    from pyspark.sql import functions as F

    kinds = {"given Latin m": 10_000, "given Greek n": 2_000}
    parts = [(kind, f"name{i}") for kind, n in kinds.items() for i in range(n)]
    parts += [("ip", f"192.168.{i // 256}.{i % 256}") for i in range(256 * 256)]
    table = surrogates.surrogate_table(spark.createDataFrame(parts, "kind string, canonical string").repartition(8), "k")
    counts = {r["kind"]: tuple(r)[1:] for r in table.groupBy("kind").agg(F.count("canonical"), F.countDistinct(F.lower("surrogate"))).collect()}
    assert counts == {k: (n, n) for k, n in [*kinds.items(), ("ip", 65536)]}
    assert not table.filter("kind = 'ip' and surrogate not rlike '^10([.][0-9]+){3}$'").count()
    assert {p for r in table.filter("kind = 'given Greek n'").collect() for p in r["surrogate"].split("-")} == set(surrogates.GIVEN["Greek"]["n"])


def test_toxicity(spark, docs, empty):
    from pyspark.sql import functions as F

    bad = ["scumbag", "foulness", "vilely"]
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{k}" for k in rng.integers(0, 300, 60)]
        toxic = i % 4 == 0
        if toxic:
            for at in rng.choice(60, 4, replace=False):
                words[at] = bad[rng.integers(0, 3)] + ("s" if rng.random() < 0.3 else "")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (5000, 0)]
    df = spark.createDataFrame([*rows, (5000, None), (None, ""), (0, rows[0][1]), (5001, "w1 " * 50_000 + "scumbag vilely foulness")], "doc_id long, text string").withColumn("score", F.lit("x"))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.judged(df, table).collect()
    assert len(got) == len(rows) + 4
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["predicted"])
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    wrong = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1 and by[i] != {int(i % 4 == 0)}]
    assert not wrong and by[5000] == by[None] == {0} and by[5001] == {1} and by[0] == {1}
    kept = toxicity.drop_toxic(df, table)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, p in by.items() if p == {0}}
    assert {r["score"] for r in toxicity.judged(df, table.filter("toxic = 0")).collect()} == {0.0}
    assert {r["score"] for r in toxicity.judged(df, table.filter("false")).collect()} == {0.0}
    assert toxicity.judged(empty, table).collect() == []
    _, found = toxicity.passages("calm words then scumbag vilely here", toxicity.Model({"scumbag": 5.0, "vile*": 4.0}), toxicity.WordScores({"scumbag": 5.0, "vile*": 4.0}))
    assert [(a, b) for a, b, _, _ in found] == [(3, 4)]
