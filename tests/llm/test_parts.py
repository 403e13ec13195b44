"""The parts that run inside tasks, against brute force or other libraries."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from recordloom.llm import grouping_genetic as gga
from recordloom.llm import longest_match, near_dedup, prob_minhash, toxicity, vector_dedup, word_ids
from recordloom.llm.elias_fano import EliasFano
from recordloom.llm.perfect_hash import PerfectHash, as_words
from recordloom.llm.word_ids import WordIds


def test_chunks_of_new_words_are_kept_once():
    encoder = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    text = "qzxv, Wjkpy. mnbvc*** ärglqq, plain"
    before = len(encoder.kept)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.kept) - before == len(text.split())


def library_ids(encoder, texts):
    return [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def all_ids(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(pa.array(texts, pa.string()))]


def test_batches_ask_for_each_word_once(monkeypatch):
    encoder = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    asked = Counter()
    monkeypatch.setattr(encoder.arrow_kept, "compute", lambda word: asked.update([word]) or encoder._word(word))
    texts = ["Qzxv, wjkpy. mnbvc*** don't", "", " qzxv  MNBVC wjkpy,\n42 ", "中 qzxv", "qzxv<|endoftext|>", "wjkpy."]
    assert all_ids(encoder, texts) == all_ids(encoder, texts) == library_ids(encoder, texts) and all_ids(encoder, []) == []
    assert asked == Counter(["", "qzxv", ",", "wjkpy", ".", "mnbvc", "***", "don", "'t", "4", "2"])


def test_batches_in_portions_and_full_tables(monkeypatch):
    encoder, drawn = WordIds(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    texts = ["".join(drawn.choice("abcÉŸſßª9²'s.,-  \t") for _ in range(drawn.choice([0, 3, 200, 3000]))) for _ in range(120)] + ["x" * 5000, ""]
    monkeypatch.setattr(word_ids, "PORTION_BYTES", 4000)
    for table in (0, 3000, 10**6):
        monkeypatch.setattr(word_ids, "ARROW_TABLE_BYTES", table)
        assert all_ids(encoder, texts) == library_ids(encoder, texts)
        assert encoder.arrow_kept.words.nbytes + encoder.arrow_kept.ids.nbytes <= table
    assert len(encoder.arrow_kept.words) > 1000 and all_ids(encoder, ["abc new", "9"]) == library_ids(encoder, ["abc new", "9"])


@pytest.mark.parametrize("control", ["\x00", "\x08", "\x0e", "\x1f", "\x7f", "a\x1cb", "\x85", "\xa0"])
def test_texts_with_control_characters_go_through_the_library(control):
    encoder = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert not encoder._plain(f"abc {control} def") and encoder._plain("abc\t\x0b\x0c\r\n def")


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    words = as_words(digests)
    built = PerfectHash.from_bytes(PerfectHash.build(words).to_bytes())
    assert built.size == n and sorted(built.slots(words)) == list(range(n))
    strangers = as_words([hashlib.sha256(f"x{i}".encode()).digest() for i in range(50)])
    assert ((built.slots(strangers) >= -1) & (built.slots(strangers) < max(n, 1))).all()


def test_perfect_hash_refuses_repeats():
    with pytest.raises(ValueError):
        PerfectHash.build(as_words([b"a" * 32] * 2))


@given(st.lists(st.integers(0, 2**62), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = sorted(values)
    coded = EliasFano.from_bytes(EliasFano.encode(np.array(values, dtype=np.uint64)).to_bytes())
    assert coded.all().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1} & set(range(len(values))):
        assert coded.select(i) == values[i]


def test_elias_fano_select_over_gaps():
    values = sorted([0] * 300 + [10**6] * 5 + list(range(2 * 10**9, 2 * 10**9 + 2000, 7)))
    coded = EliasFano.encode(np.array(values, dtype=np.uint64))
    assert [coded.select(i) for i in range(len(values))] == values
    assert len(coded.to_bytes()) < 8 * len(values)


@pytest.fixture(scope="module")
def encoder():
    return WordIds(public_tokenizers.path("word_bpe_49k.json"))


@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250), st.sampled_from("'sdΣσςİ́　中😀 \n")), max_size=20))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_library(encoder, text):
    for t in (text, text + "<|endoftext|>" + text, f"don't {text}'re"):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x180), st.sampled_from("'sdtſŸ \n\x0b")), max_size=30), max_size=8))
@settings(max_examples=300, deadline=None)
def test_ids_of_batches_are_those_of_the_library(encoder, texts):
    assert all_ids(encoder, texts) == library_ids(encoder, texts)


@given(st.lists(st.integers(1, 64), min_size=1, max_size=80), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_packings_hold_every_item(lengths, seed):
    lengths = np.array(lengths)
    found = gga.evolve(lengths, 64, [], [seed])
    for bins in [*found, gga.crossover(found[0], found[-1], lengths, 64, np.random.default_rng(seed))]:
        fills = np.bincount(bins, weights=lengths)
        assert len(bins) == len(lengths) and bins.min() == 0 and fills.max() <= 64 and fills.min() > 0
    assert gga.cost(found[0], lengths, 64) == min(gga.cost(f, lengths, 64) for f in found)


def test_packing_reaches_the_bound_where_it_can():
    lengths = np.array([40, 24] * 50 + [32] * 20)
    assert gga.cost(gga.evolve(lengths, 64, [], [1])[0], lengths, 64)[0] == 60


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for same in (0.3, 0.8):
        a = rng.integers(1, 2**63, 600).astype(np.uint64)
        b = np.concatenate([a[: int(600 * same)], rng.integers(1, 2**63, 600 - int(600 * same)).astype(np.uint64)])
        weights = {x: w for x, w in zip([*a, *b], rng.uniform(20, 40, 1200))}
        w = np.array([weights[x] for x in [*a, *b]])
        signed = prob_minhash.signatures(np.concatenate([a, b]), w, np.repeat([0, 1], 600), 2)
        shared, united = set(a) & set(b), set(a) | set(b)
        exact = sum(weights[x] for x in shared) / sum(weights[x] for x in united)
        assert abs((signed[0] == signed[1]).mean() - exact) < 0.13
    alone = prob_minhash.signatures(np.array([5], np.uint64), np.array([3.0]), np.array([0]), 2)
    assert (alone[0] == 5).all() and (alone[1] == 0).all()


def test_shingles():
    hashes = prob_minhash.new_word_hashes()
    assert len(prob_minhash.shingles("", hashes)[0]) == len(prob_minhash.shingles(" \n ", hashes)[0]) == 0
    assert len(prob_minhash.shingles("a b c", hashes)[0]) == 1 and len(prob_minhash.shingles("a b c d e f", hashes)[0]) == 2
    assert (prob_minhash.shingles("A  b\nc d e", hashes)[0] == prob_minhash.shingles("a b c d e", hashes)[0]).all()
    assert len(prob_minhash.shingles("a " * 1000, hashes)[0]) == 1


def test_tiles_find_links_between_components():
    rng = random.Random(3)
    base = rng.sample(range(10**6), 100)
    sets = [sorted({*base[: rng.randint(70, 100)], *rng.sample(range(10**6), rng.randint(0, 25))}) for _ in range(60)]

    def tile(part, names):
        return {
            "keys": [bytes([i]) for i in names], "components": [bytes([i]) for i in names], "sizes": np.array([len(s) for s in part]),
            "shingles": np.concatenate([np.array(s) for s in part]),
        }

    found = near_dedup.joining_links(tile(sets[:30], range(30)), tile(sets[30:], range(30, 60)))
    parent = list(range(60))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in found:
        x, y = set(sets[a[0]]), set(sets[b[0]])
        assert len(x & y) * 100 >= len(x | y) * 80
        parent[root(a[0])] = root(b[0])
    for i in range(30):
        for j in range(30, 60):
            x, y = set(sets[i]), set(sets[j])
            if len(x & y) * 100 >= len(x | y) * 80:
                assert root(i) == root(j)


@given(st.lists(st.sampled_from([-2.0, -1.0, -0.5, 0.0, 1.0, 2.0, 3.0]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_maximal_segments(scores):
    """The definition, recursively: the best segment, then those left and right of it."""

    def split(low, high):
        best = None
        for a in range(low, high):
            for b in range(a, high):
                s = sum(scores[a : b + 1])
                if s > 0 and (best is None or s > best[0] + 1e-9 or (abs(s - best[0]) < 1e-9 and b - a < best[2] - best[1])):
                    best = (s, a, b)
        return [] if best is None else [*split(low, best[1]), best, *split(best[2] + 1, high)]

    found = toxicity.maximal_segments(np.array(scores))
    assert math.isclose(max((s for *_, s in found), default=0), max((s for s, *_ in split(0, len(scores))), default=0))
    for a, b, s in found:
        assert math.isclose(s, sum(scores[a : b + 1])) and s > 0
        assert all(sum(scores[a:k]) > 0 for k in range(a + 1, b + 2))  # every prefix and suffix is positive
        assert all(sum(scores[k : b + 1]) > 0 for k in range(a, b + 1))
    assert all(x[1] < y[0] for x, y in zip(found, found[1:]))
    assert {i for i, s in enumerate(scores) if s > 0} == {i for a, b, _ in found for i in range(a, b + 1) if scores[i] > 0}


def test_longest_match_agrees_with_word_piece():
    from tokenizers import models

    initial, following = longest_match.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    automaton, ids = longest_match.LongestMatch(initial, following), {"[UNK]": 0}
    for piece in [*sorted(initial), *(f"##{p}" for p in sorted(following))]:
        ids.setdefault(piece, len(ids))
    model, rng = models.WordPiece(ids, unk_token="[UNK]", max_input_chars_per_word=10**6), random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("abcdeinorstlßéλ中09") for _ in range(rng.randint(1, 20)))
        pieces = [t.value for t in model.tokenize(word)]
        assert automaton.count(word) == (-1 if pieces == ["[UNK]"] else len(pieces))
    small = longest_match.LongestMatch({"a", "abcdx"}, {"b", "c", "cdy", "dz"})
    assert [small.count(w) for w in ("abcdx", "abcd", "abcdz", "abcdy", "abcz", "a", "b")] == [1, -1, 4, 3, -1, 1, -1]


def test_linked_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=40)
    a = np.concatenate([centre + rng.normal(size=(80, 40)) * s for s in (0.1, 0.2, 3.0)]) * rng.uniform(0.001, 1e6, (240, 1))
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
    expected = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.98)) if i < j}
    for rotation in (None, axes):
        rows, columns = vector_dedup.linked_pairs(a, a, rotation, True, 0.98)
        assert expected and set(zip(rows.tolist(), columns.tolist())) == expected
        rows, columns = vector_dedup.linked_pairs(a[:100], a[100:], rotation, False, 0.98)
        assert {(i, j + 100) for i, j in zip(rows.tolist(), columns.tolist())} == {(i, j) for i, j in expected if i < 100 <= j}
