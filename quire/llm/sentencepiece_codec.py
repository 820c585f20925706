"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

A text's lattice has an edge for every piece that spells a stretch of it, weighted by the
piece's score over the temperature; characters that no piece spells are their bytes. No
piece has a space behind another sign, nor letters next to other signs, so the lattice of
a text is the chain of the lattices of its words and signs, whatever their length, and each
distinct one is filtered forward once: for every end position, the sum of the weights of all ways there,
and with it the distribution of the last edge. Words that are new are filtered together, one place
of all of them at a time. Sampling runs backward from the end of each word, for all
words of a batch at a time, one inverse-distribution lookup an edge.

The draws come from a counter hash of (row key, word's place, step), so a row's sample
hangs on nothing but its key, its text and the parameters. Temperature 0 takes the best
path instead of a sample.

Defined results: null is empty and has no pieces; rows that repeat a key and a text get
the same sample; decoding gives back the text exactly, up to characters that UTF-8 cannot
hold.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TEMPERATURE = 1_000.0
#: Edges of lattices that a worker keeps (about 20 bytes each) before it starts anew.
CACHE_EDGES = 6_000_000
#: Chunks of texts that it keeps.
CACHE_CHUNKS = 600_000
#: Characters of new words that are filtered together.
FILTER_CELLS = 60_000
#: Words of more characters are filtered one by one.
LONG = 1_000
#: Stands for U+2581 in a text, whose own piece means a space; no UTF-8 text has it.
_SIGN = "\udc81"
_WORD = re.compile("▁*[^▁]+|▁+")
#: The same, cut between letters and other signs too, for models whose pieces never mix them.
_LETTER, _OTHER = r"[^\W\d_²³¹¼½¾]", r"[\W\d_²³¹¼½¾](?<!▁)"
_PART = re.compile(f"▁*(?:{_LETTER}+|(?:{_OTHER})++)|▁+")
_MIXED = re.compile(f"{_LETTER}(?={_OTHER})|{_OTHER}(?={_LETTER})")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Column:
    """A numpy array that grows."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 16, kind), 0

    def extend(self, values) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Lattices:
    """Words' lattices, flat. A state is a place in a word; its edges are the pieces that
    end there. The edges of state s lie in (s, s + 1] by the cumulated probability that
    they are the last, and a draw takes the first edge that it does not reach."""

    def __init__(self, path: str, temperature: float):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.temperature = temperature
        n = self.model.get_piece_size()
        usual = [k for k in range(n) if not (self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_byte(k) or self.model.is_unused(k))]
        scores = [self.model.get_score(k) for k in usual]
        lowest = min((x for x in scores if x > -1e8), default=0.0)  # user-defined pieces have -1e9
        self.pieces = {self.model.id_to_piece(k): (k, max(x, lowest)) for k, x in zip(usual, scores, strict=True)}
        self.longest = max(map(len, self.pieces))
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.best = not temperature
        scale = temperature or TEMPERATURE
        self.cut = (_WORD if any(map(_MIXED.search, self.pieces)) else _PART).findall
        self.weighted = {piece: (k, math.exp(score / scale)) for piece, (k, score) in self.pieces.items()}
        self.lowest = min(score for _, score in self.pieces.values())
        self.trie = self._trie()
        self.least = min(w for _, w in self.weighted.values())
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}  # the state at the word's end
        self.chunks: dict[str, int] = {}  # what stands between two spaces: its place below
        self.chunk_start, self.chunk_ends = np.zeros(1, np.int64), np.zeros(0, np.int64)  # the states at the ends of its words
        self.n_states = 0
        self.first = _Column(np.int64)  # each state's first edge
        self.cum, self.come_from, self.id = _Column(np.float64), _Column(np.int32), _Column(np.int32)
        self.spelt: dict[tuple[int, ...], int] = {}  # characters of several bytes: their edges' ids are below 0

    def _trie(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Beginnings of pieces by length: (number of the beginning without the last
        character, that character) as one sorted key; weight and id of the piece it is, or 0."""
        levels, numbers = [], {"": 0}
        for n in range(1, self.longest + 1):
            begins = sorted({piece[:n] for piece in self.weighted if len(piece) >= n}, key=lambda x: (numbers[x[:-1]], ord(x[-1])))
            keys = np.array([numbers[x[:-1]] << 21 | ord(x[-1]) for x in begins], np.int64)
            found = [self.weighted.get(x, (0, 0.0)) for x in begins]
            levels.append((keys, np.array([w for _, w in found]), np.array([k for k, _ in found], np.int32)))
            numbers = {x: k for k, x in enumerate(begins)}
        return levels

    def _bytes_of(self, c: str) -> tuple[int, int]:
        raw = "▁".encode() if c == _SIGN else c.encode("utf-8", "replace")
        ids = tuple(self.bytes[b] for b in raw)
        return (ids[0] if len(ids) == 1 else -1 - self.spelt.setdefault(ids, len(self.spelt))), len(raw)

    def _best(self, word: str) -> list[tuple[int, int]]:
        """(start, id) of the pieces with the highest sum of scores; the longer last piece wins a tie."""
        sums, last = [0.0], [(0, 0)]
        for end in range(1, len(word) + 1):
            ways = [(sums[k] + got[1], -k, got[0]) for k in range(max(0, end - self.longest), end) if (got := self.pieces.get(word[k:end]))]
            if not ways or ways[-1][1] != 1 - end:
                i, size = self._bytes_of(word[end - 1])
                ways.append((sums[end - 1] + size * self.lowest, 1 - end, i))
            total, start, i = max(ways)
            sums.append(total)
            last.append((-start, i))
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at = last[at][0]
        return out[::-1]

    def add(self, words: list[str]) -> None:
        """Filter new words forward."""
        if self.best:
            cum, come_from, ids, state = [], [], [], self.n_states
            for word in words:
                for start, i in self._best(word):
                    cum.append(state + 1.0)
                    come_from.append(state - 1 if start else -1)
                    ids.append(i)
                    state += 1
                self.words[word] = state - 1
            self.n_states = state
            self.first.extend(self.cum.n + np.arange(len(cum)))
            self.cum.extend(cum)
            self.come_from.extend(come_from)
            self.id.extend(ids)
            return
        words, k = sorted(words, key=len), 0
        while words and len(words[-1]) > LONG:
            self._filter_long(words.pop())
        while k < len(words):  # words of like lengths together
            end, most = k + 1, max(FILTER_CELLS, len(words[k]))
            while end < len(words) and (end - k + 1) * len(words[end]) <= most:
                end += 1
            self._filter(words[k:end])
            k = end

    def _ways(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """weight, id of the piece of n + 1 characters that starts at a place of a word: (n, place, word)."""
        n_words, reach = len(words), min(self.longest, width)
        lengths = np.fromiter(map(len, words), np.int64, n_words)
        signs = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n_words, width)
        signs = np.append(signs.T.astype(np.int64).ravel(), np.zeros(reach * n_words, np.int64))
        weight, ids = np.zeros((reach, width * n_words)), np.zeros((reach, width * n_words), np.int32)
        at = np.flatnonzero(np.arange(width)[:, None] < lengths)
        node = np.zeros(len(at), np.int64)
        for n, (keys, weights, own) in enumerate(self.trie[:reach]):
            asked = node << 21 | signs[at + n * n_words]
            node = np.searchsorted(keys, asked)
            node[node == len(keys)] = 0
            on = keys[node] == asked
            if not n:  # characters that are no piece are their bytes
                bare = at[~on | (weights[node] == 0)]
            at, node = at[on], node[on]
            weight[n, at], ids[n, at] = weights[node], own[node]
        for k in bare.tolist():
            ids[0, k], size = self._bytes_of(chr(signs[k]))
            weight[0, k] = self.least**size
        return weight.reshape(reach, width, n_words), ids.reshape(reach, width, n_words)

    def _filter(self, words: list[str]) -> None:
        """Filter words, the longest last, forward together. Their states are numbered by end, then word."""
        width, n = len(words[-1]), len(words)
        weight, ids = self._ways(words, width)
        reach = weight.shape[0]
        alpha = np.zeros((width + 1, n))
        alpha[0] = 1.0
        cum, edge = np.zeros((width, n, reach)), np.zeros((width, n, reach), bool)
        for end in range(1, width + 1):
            total = np.zeros(n)
            for size in range(min(end, reach), 0, -1):  # from the longest piece to the shortest, which closes its state
                way = weight[size - 1, end - size]
                total += alpha[end - size] * way
                cum[end - 1, :, reach - size], edge[end - 1, :, reach - size] = total, way > 0
            cum[end - 1] /= np.where(total > 0, total, 1)[:, None]
            alpha[end] = total
            if len(far := np.flatnonzero((total > 0) & ((total < 1e-100) | (total > 1e100)))):  # only ratios of the last ones matter
                alpha[max(0, end - reach) : end + 1, far] /= total[far]
        end, word, back = np.nonzero(edge)
        size, state = reach - back, self.n_states + end * n + word
        closes = np.append(state[1:] != state[:-1], True)
        counts = np.bincount(state - self.n_states, minlength=width * n)
        start = end + 1 - size
        self.first.extend(self.cum.n + np.cumsum(counts) - counts)
        self.cum.extend(np.where(closes, state + 1.0, state + cum[end, word, back]))
        self.come_from.extend(np.where(start > 0, state - size * n, -1))
        self.id.extend(ids[size - 1, start, word])
        self.words.update(zip(words, (self.n_states + (np.fromiter(map(len, words), np.int64, n) - 1) * n + np.arange(n)).tolist(), strict=True))
        self.n_states += width * n

    def _filter_long(self, word: str) -> None:
        """The same for one word, place by place: the edges alone are kept in memory."""
        alpha, reach, base = [1.0], self.longest, self.n_states
        first, cum, come_from, ids = [], [], [], []
        for end in range(1, len(word) + 1):
            ways = [(k, got) for k in range(max(0, end - reach), end) if (got := self.weighted.get(word[k:end]))]
            if not ways or ways[-1][0] != end - 1:
                i, size = self._bytes_of(word[end - 1])
                ways.append((end - 1, (i, self.least**size)))
            sums = np.cumsum([alpha[k - end] * w for k, (_, w) in ways])
            state, total = base + end - 1, float(sums[-1])
            first.append(self.cum.n + len(cum))
            cum += (state + sums[:-1] / total).tolist() + [state + 1.0]
            come_from += [base + k - 1 if k else -1 for k, _ in ways]
            ids += [i for _, (i, _) in ways]
            alpha = [*alpha[-reach + 1 :], total]
            if not 1e-100 < total < 1e100:  # only ratios of the last ones matter
                alpha = [x / total for x in alpha]
            if len(cum) > 100_000 or end == len(word):
                self.first.extend(first)
                self.cum.extend(cum)
                self.come_from.extend(come_from)
                self.id.extend(ids)
                first, cum, come_from, ids = [], [], [], []
        self.words[word] = base + len(word) - 1
        self.n_states += len(word)

    def _chunks(self, chunks: list[str]) -> np.ndarray:
        """Places of chunks, each a stretch that ends where a space or the text does."""
        found = list(map(self.chunks.get, chunks))
        if None in found:
            new = [chunk for chunk, at in zip(chunks, found, strict=True) if at is None]
            cuts = [[chunk] if chunk[1:].isalpha() else self.cut(chunk) for chunk in new]  # letters are one word
            if unseen := {w for own in cuts for w in own if w not in self.words}:
                self.add(list(unseen))
            self.chunks.update(zip(new, range(len(self.chunks), len(self.chunks) + len(new)), strict=True))
            self.chunk_start = np.append(self.chunk_start, len(self.chunk_ends) + np.cumsum([len(own) for own in cuts]))
            self.chunk_ends = np.append(self.chunk_ends, np.array([self.words[w] for own in cuts for w in own], np.int64))
            found = list(map(self.chunks.get, chunks))
        return np.array(found, np.int64)

    def _ends(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The states at the ends of all words, and how many words each text has."""
        held = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())
        plain = pc.invert(pc.match_substring_regex(held, r"\A\z|\A | \z|  |\xe2\x96\x81")).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(held.filter(pa.array(plain)), b" ")
        at = np.flatnonzero(plain)
        counts = np.zeros(len(texts), np.int64)
        counts[at] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        odd = {k: [t] if (t := texts[k]) else [] for k in np.flatnonzero(~plain).tolist()}  # these are cut as one
        words = lists.flatten().dictionary_encode()
        keys = ["▁" + x.decode("utf-8", "surrogatepass") for x in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        code = self._chunks(keys)[words.indices.to_numpy()] if keys else np.zeros(0, np.int64)
        wholes = {k: "▁" + own[0].replace("▁", _SIGN).replace(" ", "▁") for k, own in odd.items() if own}
        cuts = {k: self.cut(whole) for k, whole in wholes.items()}
        if unseen := {w for own in cuts.values() for w in own if w not in self.words}:
            self.add(list(unseen))
        size = self.chunk_start[code + 1] - self.chunk_start[code]
        flat = self.chunk_ends[np.repeat(self.chunk_start[code] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        before = np.concatenate([[0], np.cumsum(size)])  # words before a chunk
        first = np.cumsum(counts) - counts
        n_words = before[first + counts] - before[first]
        if not cuts:
            return flat, n_words
        parts, at = [], before[first]
        for k in range(len(texts)):
            if k in cuts:
                parts.append(np.array([self.words[w] for w in cuts[k]], np.int64))
                n_words[k] = len(parts[-1])
            else:
                parts.append(flat[at[k] : at[k] + n_words[k]])
        return np.concatenate(parts), n_words

    def encode(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Sampled ids of each text."""
        if self.cum.n > CACHE_EDGES or len(self.chunks) > CACHE_CHUNKS:
            self.clear()
        with common.uncollected():
            ends, counts = self._ends(texts)
        if not counts.sum():
            return [np.zeros(0, np.int32) for _ in texts]
        first, cum, come_from = self.first.data, self.cum.data, self.come_from.data
        row = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            seed = _mix(_mix(np.array(keys, dtype=np.int64).view(np.uint64))[row] + np.uint64(0x9E3779B97F4A7C15) * (nth.astype(np.uint64) + np.uint64(1)))
        state, left, steps = ends, np.arange(len(row)), []
        taken = np.zeros(len(row), np.int64)
        while len(left):
            with np.errstate(over="ignore"):
                u = (_mix(seed[left] + np.uint64(len(steps) + 1) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            u += state
            edge, behind = first[state], np.arange(len(state))
            while len(behind := behind[cum[edge[behind]] <= u[behind]]):
                edge[behind] += 1
            steps.append((left, edge))
            taken[left] += 1
            state = come_from[edge]
            on = state >= 0
            left, state = left[on], state[on]
        after = np.cumsum(taken)  # a word's pieces are found from its end
        ids = np.empty(int(after[-1]), np.int32)
        for k, (word, edge) in enumerate(steps):
            ids[after[word] - 1 - k] = self.id.data[edge]
        cuts = np.concatenate([[0], after])[np.cumsum(counts)]
        out = np.split(ids, cuts[:-1])
        if ids.min() < 0:
            spelt = list(self.spelt)
            out = [np.array([i for x in own.tolist() for i in ((x,) if x >= 0 else spelt[-1 - x])], np.int32) if len(own) and own.min() < 0 else own for own in out]
        return out


@functools.lru_cache(maxsize=2)
def lattices(path: str, temperature: float) -> Lattices:
    return Lattices(path, temperature)


def encode(docs: DataFrame, model: str, temperature: float = TEMPERATURE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: a sampled segmentation of every whole text."""

    def run(batches):
        own = lattices(model, temperature)
        for batch in batches:
            keys, texts, out = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()], []
            k = 0
            while k < len(texts):
                end, chars = k, 0
                while end < len(texts) and (end == k or chars < 1_000_000):
                    chars += len(texts[end])
                    end += 1
                out += own.encode([-1 if x is None else x for x in keys[k:end]], texts[k:end])
                k = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """Adds text, the decoded ids, to the columns named in keep (default: doc_id)."""
    columns = keep or ["doc_id"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*columns).schema)

    def run(batches):
        own = lattices(model, TEMPERATURE).model
        for batch in batches:
            texts = [own.decode(x) if x else "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(texts, pa.string())], names=[*columns, "text"])

    return coded.select(*columns, F.col("ids").alias("_ids")).mapInArrow(run, f"{kinds}, text string")


def round_trip(docs: DataFrame, model: str, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), text_sha256 of the
    decoded text, lossless: encoded and decoded in one pass over the texts."""
    import hashlib
    import zlib

    def run(batches):
        own = lattices(model, temperature)
        for batch in batches:
            keys, texts, k = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()], 0
            rows = []
            while k < len(texts):
                end, chars = k, 0
                while end < len(texts) and (end == k or chars < 1_000_000):
                    chars += len(texts[end])
                    end += 1
                for text, ids in zip(texts[k:end], own.encode([-1 if x is None else x for x in keys[k:end]], texts[k:end]), strict=True):
                    back = own.model.decode(ids.tolist()) if len(ids) else ""
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4")), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == text))
                k = end
            n, crc, sha, same = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "text_sha256", "lossless"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_sha256 string, lossless boolean")
