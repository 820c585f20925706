"""Token ids in files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id
that has one, and a bitmap says which of them go on to level k + 1; a rank directory
counts the set bits before every 512th. The i-th id is read by following its ranks, so
any token is reached without decoding a block.

A file holds whole documents: magic, counts, ids and starts of the documents, then per
level chunk bytes, bitmap and directory. Rows are sorted by id over range partitions, a
file is closed when it has ROLL ids, and each is written under a name of its own and then
renamed, so a task that runs again leaves the same file.

Defined results: null text is empty (one end id), null ids come first, rows that repeat
an id follow each other by a hash of the text, so an id that many rows share is spread over
partitions. Texts of any length are written whole. An empty table gives no files and no
rows. Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"DAC1"
RANK_BITS = 512
#: Ids after which a file is closed.
ROLL = 4_000_000
#: Most partitions of a read; a file is held by its reader, one at a time.
READ_PARTS = 10_000


def dac_encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunk bytes, bitmap bytes, rank directory)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> 8
        going = more > 0
        bitmap = np.packbits(going, bitorder="little")
        blocks = -(-len(rest) // RANK_BITS)
        counts = np.add.reduceat(going, np.arange(0, len(going), RANK_BITS), dtype=np.int64) if len(going) else np.zeros(0, np.int64)
        ranks = np.zeros(blocks, dtype="<u4")
        ranks[1:] = np.cumsum(counts)[:-1] if blocks else []
        levels.append(((rest & 255).astype(np.uint8), bitmap, ranks))
        rest = more[going]
        if not len(rest):
            return levels


class Dac:
    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    def _rank(self, level: int, i: int) -> int:
        """Set bits of a level's bitmap before place i."""
        _, bitmap, ranks = self.levels[level]
        block = i // RANK_BITS
        if block >= len(ranks):
            block = max(len(ranks) - 1, 0)
        first = block * RANK_BITS
        bits = np.unpackbits(bitmap[first // 8 : (i + 7) // 8], bitorder="little", count=i - first) if i > first else ()
        return (int(ranks[block]) if len(ranks) else 0) + int(np.sum(bits))

    def access(self, i: int) -> int:
        """The i-th id alone."""
        value, shift = 0, 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """ids of [start, end)."""
        out = np.zeros(end - start, dtype=np.uint32)
        at, lo, hi = np.arange(end - start), start, end
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if hi <= lo:
                break
            out[at] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * level)
            going = np.unpackbits(bitmap[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            at = at[going]
            lo = self._rank(level, lo)
            hi = lo + len(at)
        return out


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    levels = dac_encode(ids)
    out = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(levels))]
    out += [np.array([x is None for x in doc_ids], np.uint8).tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes()]
    out.append(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
    for chunks, bitmap, ranks in levels:
        out += [struct.pack("<QQQ", len(chunks), len(bitmap), len(ranks)), chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return b"".join(out)


class TokenFile:
    """A file's documents and its codes, as views of its bytes."""

    def __init__(self, data):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a token file")
        n, self.n_ids, n_levels = struct.unpack_from("<QQQ", data, 4)
        at = 28

        def take(kind, count):
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        self.null_ids, self.doc_ids, self.starts = take(np.uint8, n), take("<i8", n), take("<u8", n + 1)
        levels = []
        for _ in range(n_levels):
            a, b, c = take("<u8", 3)
            levels.append((take(np.uint8, int(a)), take(np.uint8, int(b)), take("<u4", int(c))))
        self.codes = Dac(levels)

    def document(self, k: int) -> np.ndarray:
        return self.codes.slice(int(self.starts[k]), int(self.starts[k + 1]))


@functools.lru_cache(maxsize=4)
def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(folder: str, name: str, attempt: str, data: bytes) -> None:
    system, base = _fs(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/.{name}.{attempt}") as f:
        f.write(data)
    system.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, keeps_space: bool, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs in ascending id order; returns the manifest: part, seq, name, n_docs, n_ids, base.

    A writer knows the ids before each of its files; what its partition's first file
    starts at are running sums over partitions, one number a partition on the driver.
    """

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt, seq = context.partitionId(), str(context.taskAttemptId()), 0
        enc = tokens.encoder(tokenizer, keeps_space)
        ids, lengths, got, total, before = [], [], [], 0, 0

        def close():
            nonlocal ids, lengths, got, total, seq, before
            name = f"part-{part:06d}-{seq:05d}.dac"
            _put(folder, name, attempt, file_bytes(ids, lengths, np.concatenate(got)))
            row = pd.DataFrame([{"part": part, "seq": seq, "name": name, "n_docs": len(ids), "n_ids": total, "before": before}])
            before += total
            ids, lengths, got, total, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for k in range(0, len(batch), 200):
                some = batch.iloc[k : k + 200]
                for i, x in zip(some["doc_id"], enc.encode([t or "" for t in some["text"]], end_id), strict=True):
                    ids.append(None if pd.isna(i) else int(i))
                    lengths.append(len(x))
                    got.append(x)
                    total += len(x)
                    if total >= ROLL:
                        yield close()
        if ids:
            yield close()

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = slim.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    manifest = common.written(ordered.mapInPandas(write, "part int, seq int, name string, n_docs long, n_ids long, before long"), "token-manifest")
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per partition
    bases, total = [], 0
    for r in totals:
        bases.append((r["part"], total))
        total += r["n"]
    starts = docs.sparkSession.createDataFrame(bases, "part int, first long")
    return manifest.join(F.broadcast(starts), "part").select("part", "seq", "name", "n_docs", "n_ids", (F.col("first") + F.col("before")).alias("base"))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(frames):
        system, base = _fs(folder)
        for frame in frames:
            for name, first in zip(frame["name"], frame["base"], strict=True):
                with system.open_input_file(f"{base}/{name}") as f:
                    held = TokenFile(f.read())
                n = len(held.doc_ids)
                ids = pd.array(held.doc_ids, "Int64")
                ids[held.null_ids.astype(bool)] = pd.NA
                starts = held.starts.astype(np.int64)
                yield pd.DataFrame({
                    "doc_id": ids, "start": first + starts[:-1], "n_tokens": np.diff(starts),
                    "ids_crc32": [zlib.crc32(held.document(k).astype("<u4")) for k in range(n)],
                })

    files = manifest.select("name", "base").repartition(max(1, min(manifest.count(), READ_PARTS)))
    return files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
