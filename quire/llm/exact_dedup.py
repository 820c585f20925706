"""Exact dedup against a minimal perfect hash over historical distinct digests.

History is kept in shards of bounded size. A shard is one row: the bit levels of a
minimal perfect hash over its digests, and slot arrays with the full 32-byte digest and
the locator (id, row) and copies of the row that stays. A lookup hashes a digest to its
slot and compares all 32 bytes, so a stranger is never taken for a member. Rows whose
digest is a member are repeats of the slot's winner, whose locator decides, and add to the
slot's copies; the others are grouped apart.

Rows are reduced to one per digest before they meet a shard, so a text that a third of
all rows share is one probe. Shards are cut by digest prefix, are even by nature, and as
many as the larger of history and probes needs. The rows themselves meet their digest's
entry by a join that broadcasts the entries of the most frequent digests.

Defined results: a null text equals an empty one; of equal texts the smallest id stays,
a null id comes after all others, rows that repeat an id are told apart by their place
in the input, so one row of a group stays, always. An empty table gives no rows. Texts of
any length are read whole. Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Digests of history, and of probes, that a shard holds at most on average (57 bytes each in its slots).
SHARD_KEYS = 50_000
GAMMA = 2


# --- minimal perfect hash -------------------------------------------------------------


def _place(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit of each digest on a level. words: (n, 4) uint64 of the digests."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Levels of bits: a key that is alone at its bit settles there, the others go on to
    the next level; the rank of a key's bit is its slot."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        base = 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - bits)
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(words):
            bits = max(64, GAMMA * len(words))
            at = _place(words, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            words = words[~alone[at]]
            if len(levels) > 200:
                raise ValueError("digests are not distinct")
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has its bit (then it is no member)."""
        out = np.full(len(words), -1, dtype=np.int64)
        left = np.arange(len(words))
        for level, bits in enumerate(self.levels):
            at = _place(words[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        sizes = np.array([len(x) for x in self.levels], dtype="<i8")
        return sizes.tobytes(), b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, sizes: bytes, packed: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in np.frombuffer(sizes, dtype="<i8"):
            step = (int(n) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(packed, np.uint8, step, at), count=int(n)).astype(bool))
            at += step
        return cls(levels)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4).copy()


# --- history --------------------------------------------------------------------------


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", place: str | None = None) -> DataFrame:
    """doc_id, row_id (the column `place`, if docs has row numbers of its own), digest (SHA-256
    of the text with each run of ASCII white space as one space)."""
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), common.ASCII_WS, " ")
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.col(place) if place else F.monotonically_increasing_id()).alias("row_id"),
        F.unhex(F.sha2(plain, 256)).alias("digest"),
    )


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: its winner's locator and how many rows have it."""
    winner = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    return rows.groupBy("digest").agg(F.min(winner).alias("winner"), F.count(F.lit(1)).alias("copies"))


def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build_history(distinct: DataFrame, shards: int) -> DataFrame:
    """distinct: digest, winner, copies, one row per digest. One row per shard."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        common.alone("exact_dedup")
        keys = _words(list(part["digest"]))
        mph = PerfectHash.build(keys)
        order = np.argsort(mph.slots(keys))
        sizes, bits = mph.dump()
        return pd.DataFrame([{
            "shard": int(part["shard"].iloc[0]), "sizes": sizes, "bits": bits, "slots": keys[order].tobytes(),
            "no_id": part["no_id"].to_numpy(bool)[order].tobytes(),
            "ids": part["doc_id"].fillna(0).to_numpy("<i8")[order].tobytes(),
            "rows": part["row_id"].to_numpy("<i8")[order].tobytes(), "copies": part["copies"].to_numpy("<i8")[order].tobytes(),
        }])

    flat = distinct.select(_shard(shards).alias("shard"), "digest", "winner.no_id", "winner.doc_id", "winner.row_id", "copies")
    return flat.groupBy("shard").applyInPandas(build, "shard int, sizes binary, bits binary, slots binary, no_id binary, ids binary, rows binary, copies binary")


def lookup(probes: DataFrame, history: DataFrame, shards: int) -> DataFrame:
    """probes: digest, winner, copies, one row per digest. One row per digest of history or
    probes: digest, no_id, doc_id, row_id (the row that stays), copies."""

    def settle(part: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        common.alone("exact_dedup")
        keys = _words(list(part["digest"]))
        own = pd.DataFrame({"digest": part["digest"], "no_id": part["no_id"], "doc_id": part["doc_id"].astype("Int64"), "row_id": part["row_id"], "copies": part["copies"]})
        if not len(index):
            return own
        x = index.iloc[0]
        held, copies = np.frombuffer(x["slots"], "<u8").reshape(-1, 4), np.frombuffer(x["copies"], "<i8").copy()
        at = PerfectHash.load(x["sizes"], x["bits"]).slots(keys)
        hit = (at >= 0) & (held[np.maximum(at, 0)] == keys).all(axis=1)
        copies[at[hit]] += part["copies"].to_numpy()[hit]  # a digest is one probe
        slots = pd.DataFrame({"digest": [held[k].tobytes() for k in range(len(held))], "no_id": np.frombuffer(x["no_id"], bool), "doc_id": pd.array(np.frombuffer(x["ids"], "<i8"), "Int64"), "row_id": np.frombuffer(x["rows"], "<i8"), "copies": copies})
        slots.loc[slots["no_id"], "doc_id"] = pd.NA
        return pd.concat([slots, own[~hit]])

    shaped = probes.select(_shard(shards).alias("shard"), "digest", "winner.no_id", "winner.doc_id", "winner.row_id", "copies")
    return shaped.groupBy("shard").cogroup(history.groupBy("shard")).applyInPandas(settle, "digest binary, no_id boolean, doc_id long, row_id long, copies long")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", split: int | None = None, place: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row_id.

    The table is taken as two loads: rows with an id up to `split` (default: the middle
    of the id range) are history, the others are probed against it. A column `place` of docs
    that numbers its rows is given back as row_id.
    """
    rows = common.written(digests(docs, doc_id, text, place), "digests")
    if split is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        split = 0 if low is None else (low + high) // 2
    known = F.coalesce(F.col("doc_id") <= F.lit(split), F.lit(False))
    old = common.written(groups(rows.where(known)), "history")
    new = common.written(groups(rows.where(~known)), "probes")
    shards = max(1, -(-max(old.count(), new.count()) // SHARD_KEYS))
    history = common.written(build_history(old, shards), "perfect-hash")
    settled = common.written(lookup(new, history, shards), "settled").withColumnsRenamed({"doc_id": "keep_id", "row_id": "keep_row"})
    return common.join_unique(rows, settled, "digest").select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_id",
    )
