"""The five stages of the corpus pipeline, each against brute force on what the stage before it kept."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from recordloom.llm import toxicity
from recordloom.session import fresh_folder

WORDS = [a + b for a in "ka lo mi nu re so ta vu".split() for b in "st nd rg lm ck pf".split()]
VILE = [f"{x} filthy rotten scum" for x in ("you", "they", "such")]


def tables():
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    docs, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        body = text(int(rng.integers(20, 60)))
        docs.append((i, f"{body} {' '.join(VILE)} {text(5)}" if toxic else body, "en", f"s{min(i % 5, 2)}", 0))
        labels.append((i, 0, int(toxic)))
    plain = [d for d in docs if d[0] % 8]
    docs += [(1000 + k, plain[k][1].replace(" ", "  "), "en", "s3", 0) for k in range(20)]  # equal but for blanks
    docs += [(1100 + k, plain[k][1] + " " + text(2), "en", "s3", 0) for k in range(20, 40)]  # near copies
    docs += [(1200, None, "en", None, 0), (1201, "", "en", "s3", 0), (1202, "x " * 9000, None, "s4", 0), (1203, "one two", "en", "s4", 0)]
    return docs, labels


def shingles(text):
    words = text.lower().split()
    span = min(5, len(words))
    return {tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words else set()


def test_every_stage_against_brute_force(spark):
    docs, labels = tables()
    folder = fresh_folder(spark, "pipeline-test")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = {}
    table = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [table]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], folder).write.parquet(f"{folder}/stage-{i}")
        frames.append(spark.read.parquet(f"{folder}/stage-{i}"))
        kept[name] = frames[-1].collect()
        assert i == 4 or frames[-1].columns == table.columns

    # toxicity: the model of the stage, applied in plain Python
    model = toxicity.fit(table, spark.read.parquet(f"{folder}/labels.parquet"))
    words = toxicity.WordScores(model.scores)
    fine = [d for d in docs if model.probability(toxicity.evidence(toxicity.passages(d[1] or "", model, words)[1])) < toxicity.THRESHOLD]
    assert sorted(map(tuple, kept["toxicity"]), key=str) == sorted(fine, key=str)
    assert sum("scum" in (d[1] or "") for d in fine) <= 5 and len(fine) >= 390 - 50

    # exact dedup: the smallest doc_id of equal texts
    first = {}
    for d in sorted(fine):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d[1] or ""), d)
    assert sorted(map(tuple, kept["exact dedup"]), key=str) == sorted(first.values(), key=str)

    # near dedup: components of pairs with a Jaccard similarity of 0.8 or more
    left = sorted(first.values())
    sets = [shingles(d[1] or "") for d in left]
    parent = list(range(len(left)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    single = [d for i, d in enumerate(left) if root(i) == i]
    assert len(single) <= len(left) - 15 and sorted(map(tuple, kept["near dedup"]), key=str) == sorted(single, key=str)

    # mixing: all documents, smaller sources again up to the repetition limit, larger ones never more often
    times = Counter(r["doc_id"] for r in kept["mixing"])
    assert set(times) == {d[0] for d in single} and {tuple(r) for r in kept["mixing"]} == set(single)
    size, drawn = defaultdict(int), defaultdict(int)
    for d in single:
        n = max(1, len((d[1] or "").split()))
        size[d[3] or ""] += n
        drawn[d[3] or ""] += n * times[d[0]]
        assert times[d[0]] <= math.ceil(corpus_pipeline.REPEATS)
    largest = max(size, key=size.get)
    assert drawn[largest] == size[largest] and all(drawn[s] / size[s] <= corpus_pipeline.REPEATS + 9001 / size[s] for s in size)
    assert any(drawn[s] > size[s] for s in size)

    # packing: every drawing whole, in pieces of at most 2048, gapless, near the bound
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for r in kept["mixing"]:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for n, i in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[i : i + 2048], "<u4")
            pieces[(r["doc_id"], n, i, len(part), zlib.crc32(part.tobytes()))] += 1
    assert pieces == Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in kept["packing"])
    sequences = defaultdict(list)
    for r in kept["packing"]:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    assert len(sequences) <= -(-sum(k[3] * n for k, n in pieces.items()) // 2048) + 1
