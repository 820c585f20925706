"""Tokenizer ids with the `tokenizers` library, each distinct chunk encoded once per worker.

A text is cut where every supported pre-tokenizer has a boundary anyway: in front of a
run of white space (the run stays with the chunk after it for byte-level models) or at
white space (models that drop it). The ids of a text are then the ids of its chunks in
order. Cutting and finding the distinct chunks of a batch is Arrow's work, so Python sees
each of them once a batch, and the ids of a batch are gathered by one index.

A chunk is two parts if punctuation stands behind a letter or digit at its end. A part that
is new and one pre-token goes to the library's model, any other to the whole library.
A cache of two generations keeps the ids of parts that come again: when the young one is
full it becomes the old one, and what is still used moves on.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Unicode White_Space, which the tokenizers' own \s means (Python's \s also has \x1c-\x1f).
WHITE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_GLUED = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_DROPPED = re.compile(f"[^{WHITE}]+")
#: White space other than single spaces and single line ends; white space beyond ASCII. For Arrow.
_RUNS = "  | \n|\n\n|[" + WHITE.replace(" ", "").replace("\n", "") + "]"
_WIDE = "[" + "".join(c for c in WHITE if c > "\x7f") + "]"

#: Parts of a generation, and their characters.
CACHE_CHUNKS, CACHE_CHARS = 400_000, 6_000_000
GROUP_CHARS = 4_000_000

#: No pre-token has one of these letters or digits with ASCII punctuation behind it (one
#: letter is left out: its lower case ends in a mark).
_LETTERS = "A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x12F), (0x131, 0x24F)))
_PUNCTUATION = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
_ENDS = f"[0-9{_LETTERS}]$"
_SIGNS = re.escape(_PUNCTUATION)
#: Byte-level models write each byte as a character: printable Latin-1 as itself, the others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class _Glued:
    """White space belongs to the chunk after it. Keys: "word" is " word", "\rword" is
    "word" at the start of a line, "\r\rchunk" is any chunk."""

    #: In front of any chunk; alone, a chunk without ids.
    raw = "\r\r"
    #: One pre-token of letters, digits or signs.
    one = re.compile(f" ?(?:[{_LETTERS}]+|[0-9]+|[{_SIGNS}]+)|\n")

    @staticmethod
    def plain(texts: pa.Array) -> pa.Array:
        return pc.invert(pc.match_substring_regex(texts, _RUNS))

    @staticmethod
    def cut(texts: pa.Array) -> pa.Array:
        marked = pc.binary_join_element_wise(pa.scalar("\r", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        return pc.split_pattern(pc.replace_substring(marked, "\n", " \r\r\n \r"), " ")

    @staticmethod
    def keys(text: str) -> list[str]:
        return ["\r\r" + x for x in _GLUED.findall(text)]

    @staticmethod
    def chunk(key: str) -> str:
        return " " + key if key[:1] != "\r" else key[2:] if key[1:2] == "\r" else key[1:]

    @staticmethod
    def word(key: str) -> str:
        """What the model sees of an ASCII word."""
        return _BYTE_SIGNS[0x20] + key

    @staticmethod
    def model_text(part: str) -> str:
        return "".join([_BYTE_SIGNS[b] for b in part.encode()])


class _Dropped:
    """White space is dropped and case is folded. A key is its chunk."""

    raw = ""
    one = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+")
    word = staticmethod(str.lower)

    @staticmethod
    def plain(texts: pa.Array) -> pa.Array:
        return pc.invert(pc.match_substring_regex(texts, _WIDE))

    @staticmethod
    def cut(texts: pa.Array) -> pa.Array:
        return pc.ascii_split_whitespace(texts)

    @staticmethod
    def keys(text: str) -> list[str]:
        return _DROPPED.findall(text)

    @staticmethod
    def chunk(key: str) -> str:
        return key

    @staticmethod
    def model_text(part: str) -> str:
        return "".join([_BYTE_SIGNS[b] for b in part.lower().encode()])


class _Generation:
    """Parts' places in one flat array of ids. The part at place 0 has none."""

    def __init__(self, nothing: str):
        self.place: dict[str, int] = {nothing: 0}
        self.start = np.zeros(2, np.int64)
        self.flat = np.zeros(1 << 16, "<u4")
        self.n = self.chars = 0

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.n + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.n : self.n + len(ids)] = ids
        self.place.update(zip(keys, range(len(self.place), len(self.place) + len(keys)), strict=True))
        self.start = np.concatenate([self.start, self.n + np.cumsum(sizes)])
        self.n += len(ids)
        self.chars += sum(map(len, keys))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of parts one after the other, and how many each has."""
        first, size = self.start[at], self.start[at + 1] - self.start[at]
        return self.flat[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())], size


class ChunkEncoder:
    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; spinning threads cost CPU
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.way = _Glued if keeps_space else _Dropped
        self.young, self.old = _Generation(self.way.raw), _Generation(self.way.raw)

    def _learn(self, keys: list[str]) -> None:
        young, old, way, tokenize = self.young, self.old, self.way, self.model.tokenize
        if len(old.place) > 1:
            kept = [key for key in keys if key in old.place]
            young.add(kept, *old.gather(np.array([old.place[key] for key in kept], np.int64)))
            keys = [key for key in keys if key not in old.place]
        some, whole, ids, sizes = [], [], [], []
        for key in keys:
            if key.isalpha() and key.isascii():
                text = way.word(key)
            elif way.one.fullmatch(part := way.chunk(key)):
                text = way.model_text(part)
            else:
                whole.append(key)
                continue
            own = [t.id for t in tokenize(text)]
            some.append(key)
            ids += own
            sizes.append(len(own))
        young.add(some, np.array(ids, "<u4"), np.array(sizes, np.int64))
        for k in range(0, len(whole), 10_000):
            some = whole[k : k + 10_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(list(map(way.chunk, some)), add_special_tokens=False)]
            young.add(some, np.array([i for own in found for i in own], "<u4"), np.array(list(map(len, found)), np.int64))

    def _places(self, keys: list[str]) -> np.ndarray:
        get = self.young.place.get
        found = list(map(get, keys))
        if None in found:
            new = list({key: None for key, at in zip(keys, found, strict=True) if at is None})
            if len(self.young.place) + len(new) > CACHE_CHUNKS or self.young.chars > CACHE_CHARS:
                self.old, self.young = self.young, _Generation(self.way.raw)
                get = self.young.place.get
                new = list(dict.fromkeys(key for key in keys if key != self.way.raw))
            self._learn(new)
            found = list(map(get, keys))
        return np.array(found, np.int64)

    def _group(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        held = pa.array(texts, pa.large_string())
        plain = self.way.plain(held)
        at = np.concatenate([np.flatnonzero(plain), np.flatnonzero(pc.invert(plain))])  # texts in the order they are cut
        lists = [self.way.cut(held.filter(plain))]
        if len(odd := at[len(lists[0]) :]):
            lists.append(pa.array([self.way.keys(texts[k]) for k in odd], lists[0].type))
        counts = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
        words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        heads = pc.utf8_rtrim(words.dictionary, _PUNCTUATION)
        cut = pc.and_(pc.less(pc.binary_length(heads), pc.binary_length(words.dictionary)), pc.match_substring_regex(heads, _ENDS)).to_numpy(zero_copy_only=False)
        keys, raw = words.dictionary.to_numpy(zero_copy_only=False).tolist(), self.way.raw
        tails = [raw] * len(keys)
        for k, head in zip(np.flatnonzero(cut).tolist(), heads.filter(pa.array(cut)).to_numpy(zero_copy_only=False).tolist(), strict=True):
            tails[k], keys[k] = raw + keys[k][len(head) :], head
        places = self._places(keys + tails).reshape(2, -1)
        ids, size = self.young.gather(places.T.ravel())  # of each distinct chunk
        size = size.reshape(-1, 2).sum(axis=1)
        start, ends = np.cumsum(size) - size, np.cumsum(counts)
        code = words.indices.to_numpy()
        size, first = np.insert(size[code], ends, 1), np.insert(start[code], ends, 0)
        after = np.cumsum(size)
        ids = np.append(ids, np.uint32(0))[np.repeat(first - after + size, size) + np.arange(after[-1])]
        last = after[ends + np.arange(len(ends))]
        ids[last - 1] = end_id
        out: list[np.ndarray] = [None] * len(texts)
        for k, own in zip(at.tolist(), np.split(ids, last[:-1]), strict=True):
            out[k] = own
        return out

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """ids of each text, little-endian unsigned 32-bit, end_id last."""
        out, k = [], 0
        with common.uncollected():
            while k < len(texts):
                first, chars = k, 0
                while k < len(texts) and (k == first or chars < GROUP_CHARS):
                    chars += len(texts[k])
                    k += 1
                out += self._group(texts[first:k], end_id)
        return out


def encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    return common.alone(f"encoder {path} {keeps_space}", lambda: ChunkEncoder(path, keeps_space))
