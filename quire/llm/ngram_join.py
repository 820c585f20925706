"""Exact self-join on Jaccard similarity of word shingles, as T-occurrence search.

Two sets x and y with similarity of at least t share at least T = ceil(t |x|) shingles,
so a partner of x occurs T times in the inverted lists of x's shingles. The work is cut
down before lists are searched, and no step loses a link:

1. Rows with equal sets are one class. Everything below is about classes.
2. Each shingle's list is built once, sharded by hash. A shingle in one class only links
   nothing. A class with fewer than T shared shingles has no partner and is done; that is
   nearly all of a corpus. The count is taken again over the classes that are left.
3. A class's shingles are ordered by list length. Its |x| - T + 1 first ones must meet
   those of any partner, so classes that meet in none of them need not be compared. The
   components of "meet there" are dealt out to tasks, small ones many to a task.
4. A task builds the lists of its classes and searches each class by DivideSkip: the
   short lists are merged with a heap (or by counting, if they are many), what occurs
   often enough is looked up in the L longest lists by binary search, and candidates with
   the overlap that their sizes require are links.

A component with more than GROUP_CELLS shingles is cut into blocks, and tasks get pairs
of blocks, so a task's memory is bounded whatever the component.

Shingles are 64-bit hashes, compared by all their bits; classes are 128-bit hashes of whole
sets. Joins on a shingle, a class or a label that many rows share go through
common.join_unique, which takes the most frequent keys apart.

Defined results: null is empty; a text without words has an empty set, no links, and is
its own component; fewer words than a shingle has make one shingle; a null id belongs to
its component but is never the component's id; rows that repeat an id each get a row. Texts
of any length are read whole; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected

WORDS, PERCENT = 5, 75
#: Shingles a mapper sorts at once; shingles of a shard and of a task, on average.
FLUSH, SHARD_CELLS, TASK_CELLS = 1_500_000, 3_000_000, 1_500_000
#: Parts of a shard that are sorted one after the other, a power of two.
PASSES = 4
#: Shingles of a component that is still one task's.
GROUP_CELLS = 6_000_000
#: Weight of a binary search against a merge step when the long lists are chosen.
MU = 0.0085
#: Merged elements up to which a heap is used.
HEAP = 512
CACHE_WORDS = 300_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Shingles:
    def __init__(self, words: int = WORDS):
        self.words, self.cache = words, {}

    def _hash(self, word: bytes) -> int:
        import xxhash

        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = x = xxhash.xxh64_intdigest(word)
        return x

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes. bytes.lower and bytes.split know ASCII alone, as is asked."""
        get, new = self.cache.get, self._hash
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.array([get(w) or new(w) for w in words], dtype=np.uint64)
        width = min(self.words, len(h))
        s = np.full(len(h) - width + 1, width, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                s = (s ^ h[k : len(h) - width + 1 + k]) * _MIX[0]
                s ^= s >> np.uint64(29)
            s *= _MIX[1]
            s ^= s >> np.uint64(32)
            s *= _MIX[2]
            s ^= s >> np.uint64(29)
        return np.unique(s)


#: A class: the two halves of the 128-bit hash of its set.
CLASS = ["high", "low"]


def _identity(s: np.ndarray) -> tuple[int, int]:
    digest = hashlib.md5(s.tobytes(), usedforsecurity=False).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def classes_of(docs: DataFrame, doc_id: str, text: str, words: int, place: str | None = None) -> DataFrame:
    """doc_id, row_id (the row's place), n_shingles, high, low per row."""

    def run(batches):
        common.alone("ngram_join")
        of = Shingles(words)
        for batch in batches:
            rows = []
            for i, at, t in zip(batch["doc_id"], batch["row_id"], batch["text"], strict=True):
                s = of(t)
                rows.append((i, at, len(s), *_identity(s)))
            out = pd.DataFrame(rows, columns=["doc_id", "row_id", "n_shingles", *CLASS])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(place) if place else F.monotonically_increasing_id()).alias("row_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInPandas(run, "doc_id long, row_id long, n_shingles long, high long, low long")


def shared_shingles(docs: DataFrame, text: str, words: int, shards: int) -> DataFrame:
    """high, low, cell (the hash), df: shingles that occur in at least two classes, with each class that has them."""

    def post(batches):
        common.alone("ngram_join")
        of, sets, keys, seen, n = Shingles(words), [], [], set(), 0

        def flush():
            nonlocal sets, keys, seen, n
            if n:
                all_keys = np.array(keys, dtype="<i8").reshape(-1, 2)
                doc = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
                s = np.concatenate(sets)
                shard = ((s >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                s, doc = s.view(np.int64).astype("<i8")[order], doc[order]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])
                rows = []
                for k in np.flatnonzero(np.diff(cuts)):
                    own = doc[cuts[k] : cuts[k + 1]]
                    there = np.zeros(len(sets), bool)
                    there[own] = True
                    small = (np.cumsum(there) - 1)[own]
                    wide = "<u2" if there.sum() <= 65536 else "<u4"
                    rows.append((int(k), s[cuts[k] : cuts[k + 1]].tobytes(), small.astype(wide).tobytes(), all_keys[there].tobytes()))
                yield pd.DataFrame(rows, columns=["shard", "cells", "doc", "keys"])
            sets, keys, seen, n = [], [], set(), 0

        for batch in batches:
            for t in batch["text"]:
                s = of(t)
                key = _identity(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    sets.append(s)
                    keys.append(key)
                    n += len(s)
                    if n >= FLUSH:
                        yield from flush()
        yield from flush()

    def count(part: pd.DataFrame) -> pd.DataFrame:
        common.alone("ngram_join")
        cells = [np.frombuffer(x, "<i8") for x in part["cells"]]
        keys = [np.frombuffer(k, "<i8").reshape(-1, 2) for k in part["keys"]]
        first = np.cumsum([0, *map(len, keys)])
        own = [np.frombuffer(d, "<u2" if 2 * len(c) == len(d) else "<u4") for c, d in zip(cells, part["doc"], strict=True)]
        keys, same_class = np.unique(np.concatenate(keys), axis=0, return_inverse=True)  # a class may come from several mappers
        same_class = same_class.ravel().astype(np.int32)
        found = []
        for k in range(PASSES):
            at = [np.flatnonzero(c & (PASSES - 1) == k) for c in cells]
            found.append(shared([c[x] for c, x in zip(cells, at, strict=True)], [same_class[d[x] + np.int64(base)] for d, x, base in zip(own, at, first, strict=False)]))
        cells, own, df = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"high": keys[own, 0], "low": keys[own, 1], "cell": cells, "df": df})

    def shared(cells: list[np.ndarray], own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of more than one class, their classes, and how many classes have each."""
        cells, own = np.concatenate(cells), np.concatenate(own)
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        more = np.zeros(len(cells), bool)
        same = cells[1:] == cells[:-1]
        more[1:] = same
        more[:-1] |= same
        cells, own = cells[more], own[order[more]]
        order = np.lexsort((own, cells))
        cells, own = cells[order], own[order]
        fresh = np.ones(len(cells), bool)  # one of each (cell, class)
        fresh[1:] = (cells[1:] != cells[:-1]) | (own[1:] != own[:-1])
        cells, own = cells[fresh], own[fresh]
        starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(cells)))
        df = np.repeat(counts, counts)
        kept = df > 1
        return cells[kept], own[kept], df[kept]

    lists = docs.select(F.col(text).cast("string").alias("text")).mapInPandas(post, "shard int, cells binary, doc binary, keys binary")
    return lists.groupBy("shard").applyInPandas(count, "high long, low long, cell long, df long")


def _needed(n, percent: int):
    return F.ceil(n * percent / F.lit(100.0)).cast("long")


def _with_enough(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """rows (class, cell, df) of classes that have enough shared shingles left."""
    enough = rows.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("m")).join(sizes, CLASS).where(F.col("m") >= _needed(F.col("n"), percent)).select(*CLASS)
    return rows.join(enough, CLASS, "left_semi")


class DivideSkip:
    """Inverted lists of a task's classes, filled as classes come."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.sizes, self.percent, n = sizes, percent, len(sets)
        flat = np.concatenate(sets)
        _, ids, length = np.unique(flat, return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(n), [len(s) for s in sets])
        order = np.argsort(ids, kind="stable")  # documents stay ascending within a list
        self.entries = doc[order]
        self.start = np.concatenate([[0], np.cumsum(length)])
        self.filled = np.zeros(len(length), np.int64)
        self.n = n
        self.keyed = ids[order].astype(np.int64) * n + self.entries
        cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        self.own = [own[np.argsort(length[own], kind="stable")] for own in (ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]

    def add(self, k: int) -> None:
        self.filled[self.own[k]] += 1

    def _merge(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes in the lists, ascending, and how many lists have each."""
        first, n = self.start[lists], self.filled[lists]
        first, n = first[n > 0], n[n > 0]
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if total <= HEAP:
            found: list[int] = []
            counts: list[int] = []
            for c in heapq.merge(*(self.entries[a : a + m].tolist() for a, m in zip(first, n, strict=True))):
                if found and found[-1] == c:
                    counts[-1] += 1
                else:
                    found.append(c)
                    counts.append(1)
            return np.array(found), np.array(counts)
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        counted = np.bincount(self.entries[at], minlength=self.n)
        found_at = np.flatnonzero(counted)
        return found_at, counted[found_at]

    def search(self, k: int) -> np.ndarray:
        """Classes added so far that are similar to class k."""
        own, size = self.own[k], int(self.sizes[k])
        least = -(-self.percent * size // 100)
        if len(own) < least:
            return np.zeros(0, np.int64)
        longest = max(2, int(self.filled[own].max(initial=0)))
        skipped = min(least - 1, int(least / (MU * np.log2(longest) + 1)))
        short, long = own[: len(own) - skipped], own[len(own) - skipped :]
        found, counts = self._merge(short)
        kept = counts >= least - skipped
        found, counts = found[kept], counts[kept]
        if len(found) and skipped:
            if len(found) * skipped > int(self.filled[long].sum()):  # then merging them costs less
                more, times = self._merge(long)
                at = np.searchsorted(more, found)
                at[at == len(more)] = 0
                counts = counts + np.where(more[at] == found, times[at], 0) if len(more) else counts
            else:
                asked = (long[:, None].astype(np.int64) * self.n + found[None, :]).ravel()
                at = np.searchsorted(self.keyed, asked)
                at[at == len(self.keyed)] = 0
                counts = counts + (self.keyed[at] == asked).reshape(len(long), len(found)).sum(axis=0)
        union = size + self.sizes[found] - counts
        return found[100 * counts >= self.percent * union]


def _search_task(percent: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        common.alone("ngram_join")
        part = part.sort_values(["side", "n", "key"]).reset_index(drop=True)
        index = DivideSkip([np.asarray(x, dtype=np.int64) for x in part["cells"]], part["n"].to_numpy(), percent)
        cross, side = bool(part["cross"].iloc[0]), part["side"].to_numpy()
        links, root = np.zeros(len(part), np.int64), np.arange(len(part))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for k in range(len(part)):
            if not cross or side[k]:
                found = index.search(k)
                links[k] += len(found)
                links[found] += 1
                for x in {top(int(f)) for f in found}:
                    root[x] = top(k) if x != top(k) else root[x]
            if not cross or not side[k]:
                index.add(k)
        keys = part["key"].to_numpy()
        return pd.DataFrame({"key": keys, "root": keys[[top(k) for k in range(len(part))]], "links": links})

    return run


def links_of(docs: DataFrame, rows: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT, group_cells: int = GROUP_CELLS) -> DataFrame:
    """high, low, label, links: classes that have a partner, a label that linked classes share,
    and with how many other classes each is linked. rows: classes_of(), written."""
    sizes = rows.where("n_shingles > 0").groupBy(*CLASS).agg(F.max("n_shingles").alias("n"))
    sizes = common.written(sizes, "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_CELLS))
    every = common.written(shared_shingles(docs, text, words, shards), "shared")
    shared = common.written(_with_enough(every, sizes, percent), "shared-enough")
    common.forget(every)
    again = common.written(common.join_unique(shared, shared.groupBy("cell").agg(F.count(F.lit(1)).alias("left")).where("left > 1"), "cell").drop("left"), "shared-again")
    common.forget(shared)
    left = _with_enough(again, sizes, percent)
    by_class = left.groupBy(*CLASS).agg(F.sort_array(F.collect_list(F.struct("df", "cell"))).alias("items")).join(sizes, CLASS)
    sets = common.written(by_class.withColumn("key", F.monotonically_increasing_id()), "sets")  # from here on classes have numbers
    common.forget(again)
    # n - size(items) shingles are in no other list and come first in the order
    first = F.col("n") - _needed(F.col("n"), percent) + 1 - (F.col("n") - F.size("items"))
    heads = sets.select("key", F.explode(F.slice("items", 1, first.cast("int"))).alias("item")).select("key", F.col("item.cell").alias("cell"))
    heads = common.written(heads, "heads")
    leaders = heads.groupBy("cell").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("df")).where("df > 1")
    groups = connected(common.join_unique(heads, leaders, "cell").select(F.col("key").alias("a"), "b"), "groups")
    dealt = common.written(sets.join(groups, sets["key"] == groups["id"]).select("key", "n", F.col("items.cell").alias("cells"), F.col("label").alias("group")), "dealt")
    weights = dealt.groupBy("group").agg(F.sum(F.size("cells")).alias("weight"))
    tasks = max(1, -(-(dealt.agg(F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()[0]) // TASK_CELLS))
    large = common.written(weights.where(F.col("weight") > group_cells).withColumn("blocks", F.ceil(F.col("weight") * 2 / group_cells).cast("int")), "large-groups")
    plain = dealt.join(large, "group", "left_anti").select("key", "n", "cells", F.lit(0).alias("side"), F.lit(False).alias("cross"), F.concat(F.lit("t"), F.pmod(F.xxhash64("group"), F.lit(tasks))).alias("task"))
    cut = dealt.join(large, "group").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    cut = cut.select("key", "n", "cells", (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).alias("cross"), F.concat_ws("-", "group", low, high).alias("task"))
    found = plain.unionByName(cut).groupBy("task").applyInPandas(_search_task(percent), "key long, root long, links long")
    found = common.written(found, "links").where("links > 0")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    merged = connected(found.select(F.col("key").alias("a"), F.col("root").alias("b")), "linked") if large.limit(1).count() else found.select(F.col("key").alias("id"), F.col("root").alias("label"))
    named = links.join(merged, links["key"] == merged["id"]).select("key", "label", "links").join(sets.select("key", *CLASS), "key")
    return common.written(named.select(*CLASS, "label", "links"), "linked-classes")


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, group_cells: int = GROUP_CELLS, place: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links (other sets it links
    with), row_id (its place in docs, or its number in the column `place`), kept (it is its component's
    row with the smallest id)."""
    rows = common.written(classes_of(docs, doc_id, text, words, place), "classes")
    linked = links_of(docs, rows, text, words, percent, group_cells)
    full = rows.where("n_shingles > 0")
    spot = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    classes = common.written(full.groupBy(*CLASS).agg(F.min(spot).alias("first")).join(linked, CLASS, "left"), "joined-classes")
    paired, alone = classes.where("label is not null"), classes.where("label is null")
    smallest = paired.groupBy("label").agg(F.min("first").alias("first"))
    paired = common.join_unique(paired.select(*CLASS, "label", "links"), smallest, "label").select(*CLASS, F.col("links").alias("n_links"), "first")
    of_class = common.written(paired.unionByName(alone.select(*CLASS, F.lit(0).cast("long").alias("n_links"), "first")), "labelled-classes")
    some = common.join_unique(full, of_class, CLASS).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), "n_links", "row_id", (F.col("row_id") == F.col("first.row_id")).alias("kept"))
    none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "row_id", F.lit(True).alias("kept"))
    return some.unionByName(none)
