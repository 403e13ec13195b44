"""The archive, the runs and the search on small awkward tables, against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import periodic_runs, ranked_search, warc_archive
from recordloom.session import fresh_folder

CLASHING = {"record": "a", "sha256": "b", "header": "c", "payload": "d", "rank": "e", "score": "f", "row": "g", "terms": "h", "runs": "i", "words": "j", "n": "k", "p": "l"}


def with_clashes(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})


# -- archive ------------------------------------------------------------------------

PAGES = [
    (5, "http://a/1", "<p>same</p>"),
    (3, "http://a/2", "<p>same</p>"),
    (3, "http://a/2", "<p>same</p>"),
    (None, "http://a/3", "<p>same</p>"),
    (7, None, ""),
    (8, "http://b/\r\nX-Page-Id: 99", None),
    (9, "http://c/", "body\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nÜ"),
    (10, "http://d/", "x" * 300_000),
    (11, "http://d/?q=a b", "x" * 300_000),
]
PAGE_SCHEMA = "page_id long, url string, html string"


def expected_pages(rows, least):
    out = []
    held = {}
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        key = (page is None, page or 0, i)
        held[data] = min(held.get(data, key), key)
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        first = held[data]
        revisit = len(data) >= least and first != (page is None, page or 0, i)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if revisit else "response", (None if first[0] else first[1]) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 12])
def test_archive_gives_back_every_record(spark, least):
    pages = with_clashes(spark.createDataFrame(PAGES, PAGE_SCHEMA)).repartition(3)
    got = warc_archive.archived(pages, least).drop("url").collect()
    assert sorted(map(tuple, got), key=str) == expected_pages(PAGES, least)


def test_archive_keeps_payloads_once_and_headers_whole(spark):
    folder = fresh_folder(spark, "test-archive")
    warc_archive.store_pages(spark.createDataFrame(PAGES, PAGE_SCHEMA), folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(p[2] or "") for p in PAGES})
    rows = warc_archive.originals(spark, folder).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        header = bytes(r["header"]).decode()
        assert header.startswith("WARC/1.1\r\nWARC-Type: ") and header.endswith("\r\n\r\n") and header.count("\r\n\r\n") == 1
        assert header.count("X-Page-Id:") == (0 if r["page_id"] is None else 1) + ("%0D%0AX-Page-Id:" in header)
        size = int(re.search("Content-Length: (\\d+)", header)[1])
        assert size == (0 if "WARC-Type: revisit" in header else len(r["payload"]))


def test_warc_files_and_back(spark):
    folder, files, again = (fresh_folder(spark, f"test-{n}") for n in ("archive", "warc", "again"))
    warc_archive.store_pages(spark.createDataFrame(PAGES, PAGE_SCHEMA), folder)
    for compression in ("none", "gzip"):
        warc_archive.write_warc(spark, folder, f"{files}-{compression}", compression)
        read = warc_archive.read_warc(spark, f"{files}-{compression}")
        expected = {}
        for r in warc_archive.originals(spark, folder).collect():
            header = bytes(r["header"])
            expected[header] = b"" if b"Type: revisit" in header else bytes(r["payload"])
        assert {bytes(r["header"]): bytes(r["payload"]) for r in read.collect()} == expected
        warc_archive.store_records(read, f"{again}-{compression}")
        back = warc_archive.originals(spark, f"{again}-{compression}")
        assert {bytes(r["header"]): bytes(r["payload"]) for r in back.collect()} == expected
    with pytest.raises(ValueError):
        list(warc_archive.split_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))


def test_a_changed_payload_is_noticed(spark):
    folder = fresh_folder(spark, "test-archive")
    warc_archive.store_pages(spark.createDataFrame(PAGES, PAGE_SCHEMA), folder)
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    bad.write.parquet(f"{folder}-bad/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}-bad/headers")
    with pytest.raises(Exception, match="digest"):
        warc_archive.read_pages(spark, f"{folder}-bad").collect()


def test_an_empty_archive(spark):
    assert warc_archive.archived(spark.createDataFrame([], PAGE_SCHEMA)).collect() == []


# -- runs ---------------------------------------------------------------------------


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(12, 2 * q):
                part = words[s : s + length]
                if not any(part[: length - p] == part[p:] for p in range(1, q)):
                    found.append((s, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(400):
        k = rng.choice([1, 2, 3, 5])
        words = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            unit, at = [rng.randrange(k) for _ in range(rng.randint(1, 9))], rng.randint(0, len(words))
            words[at:at] = (unit * 12)[: rng.randint(0, 60)]
        got = [tuple(r) for r in periodic_runs.runs_of(np.array(words, np.int64)).tolist()]
        assert got == brute_runs(words)
        assert not got or periodic_runs.suspects(np.array(words, np.int64), np.array([len(words)])).tolist() == [0]


def run_texts():
    rng = random.Random(3)
    fixed = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a " * 11), (5, "a " * 12), (6, "a b " * 6), (6, "a b " * 6), (None, "x y z " * 30),
        (7, "one\xa0two " * 12), (8, "a\x1cb c\x85d " * 9), (9, "end " + "over and over " * 2000 + "end"), (10, "ab " * 7 + "cd " * 20 + "ab cd " * 9),
    ]
    draw = lambda n: [rng.choice(["red", "blue", "green", "tall"]) for _ in range(n)]
    some = [(i, " ".join(draw(rng.randint(0, 40)) + draw(rng.randint(1, 9)) * rng.randint(0, 6) + draw(rng.randint(0, 9)))) for i in range(11, 150)]
    return fixed + some


def test_runs_against_brute_force(spark, monkeypatch):
    rows = run_texts()
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 500)
    got = periodic_runs.digested(periodic_runs.with_runs(periodic_runs.made_periodic(docs))).collect()
    expected = [brute_row(*r) for r in rows]
    assert sum(r[1] for r in expected) > 30 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_runs_and_collapsed_texts(spark):
    found = periodic_runs.with_runs(spark.createDataFrame([(1, "so " + "la di " * 8 + "so")], "doc_id long, text string")).first()
    assert found["collapsed"] == "so la di so" and [tuple(r) for r in found["runs"]] == [(1, 16, 2)] and found["n_words"] == 18
    assert periodic_runs.with_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# -- search -------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_search(docs, queries, k):
    held = [(i, Counter(brute_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        asked = Counter(brute_terms(text))
        found = []
        for (doc, c), size in zip(held, sizes):
            score = 0
            for t, times in asked.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * ((10**9 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * size * n // total)))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort()
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(found[:k])]
    return sorted(out, key=str)


def search_tables():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÄÖ", "x1", "the", "THE", "of"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: "".join(w + rng.choice([" ", ". ", "-", "\n", "\x7f"]) for w in rng.choices(words, weights, k=n))
    docs = [(i, text(rng.choice([0, 1, 5, 40, 200]))) for i in range(300)]
    docs += [(1000 + i, "the tie is here x1") for i in range(40)] + [(7, docs[7][1]), (None, "ÄÖ x1"), (None, None), (2000, ""), (2001, "w59 " * 5000)]
    queries = [(i, text(rng.choice([1, 3, 30]))) for i in range(25)] + [(90, None), (91, ""), (92, "unheard"), (93, "tie x1 x1 x1"), (93, "tie x1 x1 x1"), (None, "ÄÖ été Été")]
    return docs, queries


@pytest.mark.parametrize("segment, splits, block", [(4096, 32, 200_000), (16, 1, 200_000), (50, 4, 60)])
def test_search_against_brute_force(spark, monkeypatch, segment, splits, block):
    docs, queries = search_tables()
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(ranked_search, "SPLITS", splits)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    table = with_clashes(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    asked = with_clashes(spark.createDataFrame(queries, "item_id long, text string")).repartition(2)
    got = ranked_search.search(table, asked, 20).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, queries, 20)


def test_search_opens_few_intervals_for_a_rare_term(monkeypatch):
    seen = []
    scores = ranked_search._View.scores
    monkeypatch.setattr(ranked_search._View, "scores", lambda self, times, docs: seen.append(len(docs)) or scores(self, times, docs))
    n = 4000
    places = np.concatenate([np.arange(n), np.arange(0, n, 100)]).astype(np.int32)
    row = {"doc_ids": np.arange(n).tobytes(), "sizes": np.full(n, 10).tobytes(), "terms": np.repeat([1, 2], [n, n // 100]).astype(np.int32).tobytes(), "places": places.tobytes(), "times": np.ones(len(places), np.int32).tobytes()}
    segment = ranked_search.Segment(row, np.array([0, 10, 3000]), n, 10 * n)
    best = []
    segment.search(ranked_search.Query(0, np.array([1, 2]), np.array([1, 1])), best, 20)
    assert sorted(-d for _, d in best) == list(range(0, 2000, 100)) and sum(seen) < 200


def test_search_of_empty_tables(spark):
    docs, queries = (spark.createDataFrame([], f"{n} long, text string") for n in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert ranked_search.search(docs, queries).collect() == []
    assert ranked_search.search(some, queries).collect() == []
    assert ranked_search.search(docs, some.withColumnRenamed("doc_id", "item_id")).collect() == []
