"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its words, word pairs and pairs with one word between, as 32-bit
hashes. Each coordinate has a learning rate of its own and L1 keeps most weights at zero,
so what is broadcast is a short sorted list of hashes and weights.

The classifier is fitted on the driver on at most TRAIN_DOCS labelled rows, those whose
id has the smallest hash, with TRAIN_FEATURES features at most, over the hashes that at
least MIN_DOCS of them have. Scoring covers all rows and whole texts.

Defined results: null and empty texts get the score of the bias alone; a label that is
null is not learned; of labels that repeat an id the largest counts; with no labels at
all every score is 0.5 and nothing is predicted toxic. Of documents that repeat a labelled
id one is learned; each is scored. An empty table gives no rows. Extra columns pass through,
whatever their names; the score's own name must not be among them.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_DOCS, MIN_DOCS = 12_000, 3
#: Features of the texts that are learned, 4 bytes each on the driver.
TRAIN_FEATURES = 16_000_000
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 8.0, 1.0, 10
CACHE_WORDS = 300_000
#: Odd multipliers of the hashes of one word, the second word of a pair, and of a skip pair.
_ONE, _TWO, _SKIP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

_WORD = re.compile(r"[^\W_]+")


class Features:
    def __init__(self):
        self.cache: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        import xxhash

        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = x = xxhash.xxh64_intdigest(word)
        return x

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes."""
        get, new = self.cache.get, self._hash
        h = np.array([get(w) or new(w) for w in _WORD.findall((text or "").lower())], dtype=np.uint64)
        with np.errstate(over="ignore"):
            parts = (h * _ONE, h[:-1] * _ONE + h[1:] * _TWO, h[:-2] * _ONE + h[2:] * _SKIP)
            mixed = np.concatenate(parts)
            mixed ^= mixed >> np.uint64(32)
            mixed *= _ONE
        return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


class Ftrl:
    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.free = np.full(size + 1, l1)
        self.free[size] = 0  # the bias, last, is not held at zero

    def weights(self, at) -> np.ndarray:
        z, free = self.z[at], self.free[at]
        return np.where(np.abs(z) <= free, 0, (np.sign(z) * free - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def labelled(labels: DataFrame, label: str, fold, most: int) -> DataFrame:
    """doc_id and label of at most `most` rows that fold admits, by a hash of the id."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fold)
    rows = rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, label, text, one row for each id of the sample that docs has: of rows that
    repeat an id, the text with the smallest hash. A task sends on as many texts as the sample has rows."""
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # the sample is bounded: rows of two numbers
    own = F.min_by(F.struct("label", "text"), F.struct(F.xxhash64("text"), "text")).alias("own")
    return joined.groupBy("doc_id").agg(own).select("doc_id", "own.label", "own.text")


def _places(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where the known ones of found are in known; both sorted."""
    if not len(known):
        return np.zeros(0, np.int64)
    at = np.searchsorted(known, found)
    at[at == len(known)] = 0
    return at[known[at] == found]


def fit(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """sample: doc_id, label, bounded. Sorted hashes, their weights, and the bias. Whole texts
    are learned, as many as have TRAIN_FEATURES features together, by the same hash of the id."""

    def features(frames):
        common.alone("toxicity")
        of = Features()
        for frame in frames:
            at = [of(x) for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "n": list(map(len, at)), "at": [x.tobytes() for x in at]})

    made = common.written(labelled_texts(docs, sample).mapInPandas(features, "doc_id long, label int, n long, at binary"), "label-features")
    sizes = sorted(((r["doc_id"] * 0x9E3779B1) % 2**32, r["doc_id"], r["n"]) for r in made.select("doc_id", "n").collect())  # TRAIN_DOCS rows of two numbers
    total = np.cumsum([n for *_, n in sizes])
    if len(sizes) and total[-1] > TRAIN_FEATURES:
        some = [i for (_, i, _), n in zip(sizes, total, strict=True) if n <= TRAIN_FEATURES]
        made = made.join(F.broadcast(common.small_table(docs.sparkSession, {"doc_id": pa.array(some, pa.int64())})), "doc_id", "left_semi")
    rows = made.select("doc_id", "label", "at").toArrow().combine_chunks()
    if not len(rows):
        return np.zeros(0, np.uint32), np.zeros(0), 0.0
    ids, labels = rows["doc_id"].to_numpy(), rows["label"].to_numpy()
    found = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows["at"]]  # views of the rows as they came
    order = np.argsort((ids * 0x9E3779B1) % 2**32, kind="stable")  # one that does not hang on partitions
    every = np.concatenate(found)
    every.sort()  # in place: what occurs MIN_DOCS times is equal to what stands MIN_DOCS - 1 further
    short = len(every) - MIN_DOCS + 1
    known = np.unique(every[: max(short, 0)][every[: max(short, 0)] == every[MIN_DOCS - 1 :][: max(short, 0)]])
    del every
    examples = [(_places(known, found[k]).astype(np.int32), labels[k]) for k in order]
    del rows, found
    model = Ftrl(len(known))
    for _ in range(EPOCHS):
        for at, label in examples:
            model.learn(at, label)
    every = model.weights(slice(None))
    kept = np.flatnonzero(every[:-1])
    return known[kept], every[kept], float(every[-1])


def is_toxic(score: Column, model: tuple[np.ndarray, np.ndarray, float], least: float = 0.5) -> Column:
    """Whether a score of the model is a toxic text's: none is if the model has learned nothing."""
    return score >= least if len(model[0]) or model[2] else F.lit(False)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Adds the score, under this name, to the columns in keep (default: all)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns if keep is None else keep
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def run(batches):
        common.alone("toxicity")
        of, (known, weights, bias) = Features(), shared.value
        for batch in batches:
            sums = np.array([weights[_places(known, of(x))].sum() for x in batch.column(batch.num_columns - 1).to_pylist()]) + bias
            got = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(got, pa.float64())], names=[*columns, name])

    return docs.select(*columns, F.col(text).alias(common.unused(columns, "_text"))).mapInArrow(run, f"{kinds}, `{name}` double")
