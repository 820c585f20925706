"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

Every token falls into one of BUCKETS buckets, and a bucket has a fixed sparse ternary
index vector. Over the whole corpus, a bucket's word vector is the sum of the index
vectors of its neighbours within WINDOW tokens. A document is the mean and the spread of
its tokens' vectors; a two-layer network in numpy turns that into a logit, and a
temperature fitted on rows kept apart calibrates the probability.

Word vectors cover all documents: each partition sums its own, blocks of them are added
up in two rounds, and BUCKETS x WIDTH numbers reach the driver. The network is fitted on
at most TRAIN_DOCS labelled rows, those whose id has the smallest hash.

Defined results: null and empty texts are scored as a zero vector; labels that are null
are not learned; with no labels, or only one kind of them, every score is their share
(0.5 with none). Of documents that repeat a labelled id one is learned; each is scored.
Texts of any length are read whole. An empty table gives no rows. Extra columns pass
through, whatever their names; the score's own name must not be among them.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import labelled_texts

BUCKETS, WIDTH, NONZERO, WINDOW = 2**14, 48, 4, 2
TRAIN_DOCS = 16_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
BLOCKS, SPLITS = 16, 64
CACHE_WORDS = 300_000
#: Tokens whose neighbours are added in one step.
STEP = 1_000_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Buckets:
    def __init__(self):
        self.cache: dict[str, int] = {}

    def _new(self, token: str) -> int:
        import xxhash

        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.cache[token] = x = xxhash.xxh32_intdigest(token) % BUCKETS
        return x

    def __call__(self, text: str | None) -> np.ndarray:
        get, new = self.cache.get, self._new
        return np.array([x if (x := get(t)) is not None else new(t) for t in _TOKEN.findall(text or "")], dtype=np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each bucket's index vector."""
    draw = np.random.default_rng(20)
    return np.argsort(draw.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO], draw.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def add_contexts(total: np.ndarray, tokens: np.ndarray, doc: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """total: (BUCKETS * WIDTH), plus the index vectors of neighbours of the same document."""
    for k in range(1, WINDOW + 1):
        same = doc[:-k] == doc[k:]
        a, b = tokens[:-k][same], tokens[k:][same]
        for x, y in ((a, b), (b, a)):
            for j in range(NONZERO):
                total += np.bincount(x * WIDTH + places[y, j], weights=signs[y, j], minlength=len(total))


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(BUCKETS, WIDTH) of unit rows, from all documents."""

    def contexts(batches):
        from pyspark import TaskContext

        of, (places, signs), total, tokens, n = Buckets(), index_vectors(), np.zeros(BUCKETS * WIDTH), [], 0

        def flush():
            nonlocal tokens, n
            if n > 1:
                add_contexts(total, np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(x) for x in tokens]), places, signs)
            tokens, n = [], 0

        for batch in batches:
            for x in batch[text]:
                tokens.append(of(x))
                n += len(tokens[-1])
                if n >= STEP:
                    flush()
        flush()
        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"split": part % SPLITS, "block": range(BLOCKS), "sums": [x.astype("<f4").tobytes() for x in np.split(total, BLOCKS)]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, x in zip(batch["block"], batch["sums"], strict=True):
                got = np.frombuffer(x, "<f4").astype(float)
                sums[block] = sums[block] + got if block in sums else got
        yield pd.DataFrame({"split": 0, "block": list(sums), "sums": [x.astype("<f4").tobytes() for x in sums.values()]})

    kind = "split int, block int, sums binary"
    first = docs.select(F.col(text).alias(text)).mapInPandas(contexts, kind)
    rows = first.repartition("block", "split").mapInPandas(add, kind).repartition("block").mapInPandas(add, kind).collect()  # BLOCKS rows at least, BUCKETS x WIDTH numbers each time a block is whole
    total = np.zeros((BLOCKS, BUCKETS * WIDTH // BLOCKS))
    for r in rows:
        total[r["block"]] += np.frombuffer(r["sums"], "<f4")
    vectors = total.reshape(BUCKETS, WIDTH)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return (vectors - vectors.mean(axis=0)).astype(np.float32)


def pooled(of: Buckets, vectors: np.ndarray, text: str | None) -> np.ndarray:
    tokens = of(text)
    if not len(tokens):
        return np.zeros(2 * WIDTH, dtype=np.float32)
    x = vectors[tokens]
    return np.concatenate([x.mean(axis=0), x.std(axis=0)])


class Network:
    """Two layers; standardised inputs; the logit is divided by the temperature."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.draw, n = draw, 2 * WIDTH
        self.p = [draw.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.mean, self.scale, self.temperature, self.constant = np.zeros(n), np.ones(n), 1.0, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        if len(set(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        apart = np.arange(len(y)) % 8 == 7  # for the temperature
        self.mean, self.scale = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-6
        train, z, own = (x[~apart] - self.mean) / self.scale, x[apart], y[~apart]
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for at in np.array_split(self.draw.permutation(len(own)), max(1, len(own) // BATCH)):
                a = train[at]
                h = np.maximum(a @ self.p[0] + self.p[1], 0)
                g = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -35, 35))) - own[at]) / max(len(at), 1)
                back = np.outer(g, self.p[2]) * (h > 0)
                grads, t = [a.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])], t + 1
                for k, gk in enumerate(grads):
                    gk = gk + DECAY * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk * gk
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if apart.any():
            logits, label = self.logits(z), y[apart]
            loss = lambda s: np.mean(np.logaddexp(0, -np.where(label == 1, 1, -1) * logits / s))
            self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
        return self


def fit(docs: DataFrame, sample: DataFrame, vectors: np.ndarray) -> Network:
    """sample: doc_id, label, bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(frames):
        of, v = Buckets(), shared.value
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "x": [pooled(of, v, t).astype("<f4").tobytes() for t in frame["text"]]})

    rows = labelled_texts(docs, sample).mapInPandas(pool, "doc_id long, label int, x binary").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(rows["x"]), "<f4").reshape(-1, 2 * WIDTH).astype(float)
    return Network().fit(x, rows["label"].to_numpy(float))


def score(docs: DataFrame, network: Network, vectors: np.ndarray, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Adds the score, under this name, to the columns in keep (default: all)."""
    shared = docs.sparkSession.sparkContext.broadcast((network, vectors))
    columns = docs.columns if keep is None else keep
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def run(batches):
        import pyarrow as pa

        of, (net, v) = Buckets(), shared.value
        for batch in batches:
            x = np.array([pooled(of, v, t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, 2 * WIDTH)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(net.scores(x), pa.float64())], names=[*columns, name])

    return docs.select(*columns, F.col(text).alias(common.unused(columns, "_text"))).mapInArrow(run, f"{kinds}, `{name}` double")
