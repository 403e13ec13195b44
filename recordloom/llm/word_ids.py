"""Token ids by a tokenizer file of the tokenizers library, at corpus speed.

``Tokenizer.encode`` spends most of its time on normalising and on bookkeeping of
offsets. For files whose normaliser and pre-tokenizer are the lower-casing word
split with byte symbols, no token crosses a word, so a word's ids are asked of the
library's model once and kept. Texts with characters outside the range in which
the rules of both sides are known to agree go through ``encode`` as they are, and
so does every text of any other kind of file.

``WordIds.encode`` takes one text. ``WordIds.encode_all`` takes the texts of a batch
together: Arrow finds their distinct chunks without spaces and the distinct words of
those, so that Python sees only words that are not yet known.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from recordloom.llm.common import LONGEST_WORD, BoundedTable, worker_holds

# The split rule of word-level byte BPE files (public tokenizer format).
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
_UNUSUAL = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ſ]")

PORTION_BYTES = 4 << 20  # texts that are encoded together, or one longer text
ARROW_TABLE_BYTES = 16 << 20
LOOKED_THROUGH = 20  # known words for each word of a portion, up to which they are searched


def _byte_symbols() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the characters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Kept(BoundedTable):
    """Packed ids by word."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute
        self.ends = {mark: compute(mark) for mark in ".,"}

    def part(self, word: str) -> bytes:
        """Ids of a word within a chunk; it is not kept, as its chunk is."""
        return self.get(word) or self.old.get(word) or self.compute(word)

    def make(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self.compute(chunk)
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return self.part(chunk[:-1]) + self.ends[chunk[-1]]
        words = _WORDS.findall(chunk)
        return b"".join(map(self.part, words)) if len(words) > 1 else self.compute(chunk)


def _strung(outer: pa.Array, index: pa.Array, lists: pa.ListArray) -> pa.ListArray:
    """For each list of places that ``outer`` (its offsets) and ``index`` (its places) give: the ``lists`` there, one behind the other."""
    taken = lists.take(index)
    return pa.ListArray.from_arrays(taken.offsets.take(outer), taken.flatten())


class _ArrowTable:
    """Ids by word, as Arrow arrays of at most ``ARROW_TABLE_BYTES``; when they are full, those of the present words stay."""

    def __init__(self, compute):
        self.compute = compute
        self._set(pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32())))

    def _set(self, words: pa.StringArray, ids: pa.ListArray) -> None:
        self.words, self.ids = words, ids

    def _made(self, words: pa.StringArray) -> pa.ListArray:
        made = list(map(self.compute, words.to_numpy(zero_copy_only=False).tolist()))
        ends = np.cumsum([0, *map(len, made)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(made), "<u4")))

    def of(self, words: pa.StringArray) -> pa.ListArray:
        """The ids of distinct words."""
        if len(self.words) > LOOKED_THROUGH * len(words):  # few words: asking the model is quicker
            return self._made(words)
        at = pc.index_in(words, value_set=self.words)
        unknown = at.is_null()
        new = words.filter(unknown)
        known = len(self.words)
        all_ids = pa.concat_arrays([self.ids, self._made(new)])
        at = pc.replace_with_mask(at, unknown, pa.array(np.arange(known, known + len(new)), pa.int32()))
        found = all_ids.take(at)
        self._set(pa.concat_arrays([self.words, new]), all_ids)
        if self.words.nbytes + self.ids.nbytes > ARROW_TABLE_BYTES:
            short = pc.less_equal(pc.utf8_length(words), LONGEST_WORD)
            words, ids = words.filter(short), found.filter(short)
            fits = words.nbytes + ids.nbytes <= ARROW_TABLE_BYTES
            self._set(words.slice(0, None if fits else 0), ids.slice(0, None if fits else 0))
        return found


class WordIds:
    """Encodes texts to packed little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_word = (
            spec["model"]["type"] == "BPE"
            and (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and [p.get("type") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": WORD_SPLIT}
            and not spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]
            and not spec["pre_tokenizer"]["pretokenizers"][1].get("use_regex", True)
        )
        added = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.model = self.tokenizer.model
        self.symbols = {chr(b): s for b, s in _byte_symbols().items()}
        self.symbols = str.maketrans(self.symbols)
        self.kept = _Kept(self._word)
        self.arrow_kept = _ArrowTable(self._word)

    def _word(self, word: str) -> bytes:
        symbols = word if word.isascii() else word.encode().decode("latin1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def _plain(self, text: str) -> bool:
        return (
            self.by_word
            and not _UNUSUAL.search(text)
            and not (self.special and self.special.search(text))
        )

    def encode(self, text: str) -> bytes:
        if self._plain(text):
            return b"".join(map(self.kept.__getitem__, text.lower().split()))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """What ``encode`` gives for each of the texts, in their order."""
        if not self.by_word:
            yield from map(self.encode, texts.to_pylist())
            return
        portion = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // PORTION_BYTES
        starts = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), len(texts)]
        for first, end in zip(starts, starts[1:]):
            yield from self._portion(texts.slice(first, end - first).cast(pa.string()))

    def _portion(self, texts: pa.StringArray) -> Iterator[bytes]:
        plain = pc.invert(pc.match_substring_regex(texts, _UNUSUAL.pattern))
        if self.special:
            plain = pc.and_not(plain, pc.match_substring_regex(texts, self.special.pattern))
        ids = self._by_word(texts.filter(plain))
        ends, data = ids.offsets.to_numpy().tolist(), ids.flatten().to_numpy()
        at = 0
        for text, known in zip(texts, plain.to_pylist()):
            if known:
                yield data[ends[at] : ends[at + 1]].tobytes()
                at += 1
            else:
                yield self.encode(text.as_py())

    def _by_word(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of plain texts: of the words of their distinct chunks."""
        chunked = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        chunks = chunked.flatten().dictionary_encode()
        alone = pc.utf8_is_alpha(chunks.dictionary)
        single, mixed = chunks.dictionary.filter(alone), chunks.dictionary.filter(pc.invert(alone))
        parts = pc.split_pattern(pc.replace_substring_regex(mixed, f"({_WORDS.pattern})", "\\1\n"), "\n")
        words = pa.concat_arrays([single, parts.flatten()]).dictionary_encode()
        of_parts = parts.offsets.to_numpy() + len(single)
        outer = np.concatenate([np.arange(len(single)), of_parts])
        ids = _strung(pa.array(outer, pa.int32()), words.indices, self.arrow_kept.of(words.dictionary))
        places = np.empty(len(chunks.dictionary), np.int32)  # of the chunks in ids
        places[np.argsort(~alone.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(places))
        return _strung(chunked.offsets, pa.array(places).take(chunks.indices), ids)


def word_ids(path: str) -> WordIds:
    """The encoder of this Python process for a tokenizer file: loaded once, its words kept from task to task."""
    return worker_holds(f"word ids {path}", lambda: WordIds(path))
