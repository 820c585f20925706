"""Language identification by words first, then by ever shorter character n-grams.

A word that training has seen is scored by its log frequency in each language. A word
that it has not seen is scored by its known 5-grams, else 4-grams, and so on down to
single characters, in each case the mean of their log frequencies. A text's language is
the one with the largest sum over all its words.

The model is fitted on a bounded sample of labelled rows, TRAIN_PER_LANG of each language
in expectation, taken by a hash of the id. All words and n-grams of the sample are kept,
so the size of the broadcast model is bounded by that of the sample.

Defined results: a text that is null or has no letter is `und` with score 0, and so is
every text if nothing could be learned. Ties go to the first language in byte order. Rows
that repeat an id are learned and judged each for itself. Texts of any length are read
whole. An empty table gives no rows. Extra columns pass through, whatever their names; the
names of the results must not be among them.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_PER_LANG = 150
LONGEST = 5
#: Words a worker keeps scored.
CACHE_WORDS = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    framed = f"<{word}>" if n > 1 else word
    return [framed[k : k + n] for k in range(len(framed) - n + 1)]


def _counts(frames):
    """(kind, lang, item, n) of a partition; kind 0 is a word, else the n-gram's length."""
    common.alone("language_id")
    words: dict[str, Counter] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            words.setdefault(lang, Counter()).update(words_of(text or ""))
    for lang, seen in words.items():
        yield pd.DataFrame({"kind": 0, "lang": lang, "item": list(seen), "n": list(seen.values())})
        for n in range(1, LONGEST + 1):
            grams: Counter = Counter()
            for word, count in seen.items():
                for gram in grams_of(word, n):
                    grams[gram] += count
            yield pd.DataFrame({"kind": n, "lang": lang, "item": list(grams), "n": list(grams.values())})


class Model:
    """Log frequencies: a row of the table for each known word, and for each known n-gram,
    whose length tells its kind."""

    def __init__(self, langs: list[str], table: np.ndarray, words: dict[str, int], grams: dict[str, int]):
        self.langs, self.table, self.words, self.grams = langs, table, words, grams
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, len(langs)))

    def word(self, word: str) -> np.ndarray:
        if (at := self.words.get(word)) is not None:
            return self.table[at]
        for n in range(LONGEST, 0, -1):
            found = [at for gram in grams_of(word, n) if (at := self.grams.get(gram)) is not None]
            if found:
                return self.table[found].sum(axis=0) / len(found)
        return np.zeros(len(self.langs))

    def row(self, word: str) -> int:
        at = len(self.cache)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.word(word)
        self.cache[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        get, row = self.cache.get, self.row
        at = [i if (i := get(w)) is not None else row(w) for w in words]
        total = self.rows[at].sum(axis=0)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(train: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Model:
    """train: doc_id, text, lang. Rows without a language are left out."""
    train = train.where(F.col("lang").isNotNull())
    found = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    sample = train.join(F.broadcast(found), "lang").where(draw < F.lit(per_lang) / F.col("n"))  # a row for each language
    langs = sorted(r["lang"] for r in found.collect())
    kinds = "kind int, lang string, item string, n long"
    counts = common.written(sample.select("lang", "text").mapInPandas(_counts, kinds), "language-counts")
    sums = counts.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))
    rows = sums.toArrow().combine_chunks()  # what is counted in the sample
    item, own = (rows[c].combine_chunks().dictionary_encode() for c in ("item", "lang"))
    kind, n = rows["kind"].to_numpy(), rows["n"].to_numpy()
    known = {x: k for k, x in enumerate(langs)}
    lang = np.array([known[x] for x in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy()]
    distinct, items = np.unique(kind.astype(np.int64) * len(item.dictionary) + item.indices.to_numpy(), return_inverse=True)
    of_kind = distinct // max(len(item.dictionary), 1)
    totals = np.ones((LONGEST + 1, len(langs)))  # items of a kind, and one
    np.add.at(totals, (kind, lang), n)
    totals += np.bincount(of_kind, minlength=LONGEST + 1)[:, None] / 2
    table = np.full((len(distinct), len(langs)), 0.5)
    table[items, lang] += n
    table = np.log(table / totals[of_kind])
    names = item.dictionary.take(pa.array(distinct % max(len(item.dictionary), 1))).to_pylist()
    n_words = int((of_kind == 0).sum())  # words come first
    return Model(langs, table, dict(zip(names[:n_words], range(n_words), strict=True)), dict(zip(names[n_words:], range(n_words, len(names)), strict=True)))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its score, under these names, to the columns in keep (default: all)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns if keep is None else keep
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def score(frames):
        common.alone("language_id")
        own = shared.value  # a worker's tasks share the words it has scored
        for batch in frames:
            got = [own.predict(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*columns, *names])

    return docs.select(*columns, F.col(text).alias(common.unused(columns, "_text"))).mapInArrow(score, f"{kinds}, `{names[0]}` string, `{names[1]}` double")
