"""Small cases of every operator: nulls, empties, ties, repeats, extra columns, brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from quire.llm import ann, exact_dedup, language_id, ngram_join, packing, quality, sentencepiece_codec, token_store, tokens, toxicity, url_filter

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = [None, "", "  ", "a", "Hello  World\n\n x", "don't stop, İstanbul! naïve 中文 <|endoftext|>", "one two three four five six seven", "word " * 3000, "x\t\ry", "▁odd ▁▁ sign"]


def docs_of(spark, rows, extra=""):
    """rows: (doc_id, text); extra columns clash with names that operators use."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'x' AS score", "'y' AS row_id", "'z' AS key", "1 AS piece", "'e' AS lang_pred")


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, [*enumerate(TEXTS), (3, "a"), (None, "a"), (None, None)])


def exact(path, keeps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize(("path", "keeps"), [(BYTE, True), (WORD, False)])
def test_chunked_ids_equal_the_library(path, keeps):
    rng = np.random.default_rng(1)
    signs = ["a", "B,", "é", "'s", " ", "  ", "\n", "\r", "\x85", "\x1c", "1.", "!!", "_", "σΣ", "İ!", "中", "\u0301", "don't", "\u2003", "\x00"]
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice(signs, rng.integers(0, 25))) for _ in range(3000)]
    want = [e.ids + [7] for e in exact(path, keeps).encode_batch(texts, add_special_tokens=False)]
    got = tokens.ChunkEncoder(path, keeps).encode(texts, 7)
    assert [list(x) for x in got] == want


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(tokens, "GROUP_CHARS", 10)
    e = tokens.ChunkEncoder(WORD, False)
    texts = [f"w{k % 7} x{k}, w{k % 3}" for k in range(50)]
    assert [list(x) for x in e.encode(texts, 1)] == [x.ids + [1] for x in exact(WORD, False).encode_batch(texts, add_special_tokens=False)]


# --- op1 ---


def test_sentencepiece_round_trip_and_seeds(spark, docs):
    coded = sentencepiece_codec.encode(docs, PIECE)
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in sentencepiece_codec.decode(coded, PIECE).collect())
    assert texts == sorted((i is None, i or 0, t or "") for i, t in [*enumerate(TEXTS), (3, "a"), (None, "a"), (None, None)])
    one = {(r["doc_id"], tuple(r["ids"])) for r in coded.repartition(5).collect()}
    two = {(r["doc_id"], tuple(r["ids"])) for r in sentencepiece_codec.encode(docs.repartition(3), PIECE).collect()}
    assert one == two
    assert all(r["lossless"] for r in sentencepiece_codec.round_trip(docs, PIECE).collect())


def test_samples_follow_the_lattice():
    own = sentencepiece_codec.Lattices(PIECE, 1000.0)

    def ways(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in own.pieces:
                for rest, x in ways(s[n:]):
                    yield (own.pieces[s[:n]][0], *rest), x + own.pieces[s[:n]][1] / 1000

    weights = {w: np.exp(x) for w, x in ways("▁Hello")}
    drawn = own.encode(list(range(20_000)), ["Hello"] * 20_000)
    for way, w in weights.items():
        share = np.mean([tuple(x.tolist()) == way for x in drawn])
        assert abs(share - w / sum(weights.values())) < 0.01
    best = sentencepiece_codec.Lattices(PIECE, 0.0)
    assert tuple(best.encode([1], ["Hello"])[0].tolist()) == max(weights, key=weights.get)


@pytest.mark.parametrize(("text", "draws"), [("internationalization" * 5, 3000), ("haha" * 30, 3000), ("-" * 80, 3000), ("-" * 30_000, 20)])
def test_samples_of_long_words_follow_the_whole_lattice(text, draws):
    own = sentencepiece_codec.Lattices(PIECE, 1000.0)
    s = "▁" + text
    edges = [(a, b, own.pieces[s[a:b]][1] / 1000) for b in range(1, len(s) + 1) for a in range(max(0, b - own.longest), b) if s[a:b] in own.pieces]
    there, back = np.full(len(s) + 1, -np.inf), np.full(len(s) + 1, -np.inf)  # logarithms of the sums of all ways to and from a place
    there[0] = back[-1] = 0
    for a, b, x in edges:
        there[b] = np.logaddexp(there[b], there[a] + x)
    for a, b, x in sorted(edges, reverse=True):
        back[a] = np.logaddexp(back[a], back[b] + x)
    want = np.exp(there + back - there[-1])
    size = {k: len(piece) for piece, (k, _) in own.pieces.items()}
    borders = np.zeros(len(s) + 1)
    drawn = own.encode(list(range(draws)), [text] * draws)
    for ids in drawn:
        borders[np.cumsum([0, *(size[k] for k in ids.tolist())])] += 1
    assert own.model.decode(drawn[0].tolist()) == text
    assert abs(borders / draws - want).max() < 5 * 0.5 / draws**0.5


# --- op2, op5, op7 ---


def labelled(spark, n=240):
    rows = [(k, ("stupid scum here %d" if k % 4 == 0 else "kind words here %d") % k + (" !! $$$ !!" if k % 3 == 0 else "")) for k in range(n)]
    labels = [(k, int(k % 3 != 0), int(k % 4 == 0)) for k in range(n)] + [(1, None, None), (0, 1, None), (None, 1, 1)]
    return docs_of(spark, [*rows, (None, None), (n, ""), (n + 1, "x" * 50_000)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_scores_all_rows(spark):
    from pyspark.sql import functions as F

    d, labels = labelled(spark)
    sample = toxicity.labelled(labels, "toxic", F.lit(True), 200)
    assert sample.count() == 200
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(d, toxicity.fit(d, sample), keep=["doc_id"]).collect()}
    assert len(scored) == 243 and all(0 <= x <= 1 for x in scored.values())
    assert all((scored[k] >= 0.5) == (k % 4 == 0) for k in range(240))
    nothing = toxicity.fit(d, sample.limit(0))
    assert {r["score"] for r in toxicity.score(d, nothing, keep=["doc_id"]).collect()} == {0.5}


def test_nothing_is_toxic_without_labels(spark, tmp_path):
    import corpus_pipeline
    from quire.llm import queries

    d, labels = labelled(spark, 12)
    d.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert [r["predicted"] for r in queries.op5_toxicity(spark, str(tmp_path)).collect()] == [0] * 15
    assert corpus_pipeline.toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() == 15


def test_quality_learns_and_scores_all_rows(spark):
    from pyspark.sql import functions as F

    d, labels = labelled(spark)
    sample = toxicity.labelled(labels.where("doc_id > 0"), "quality", F.lit(True), 300)
    vectors = quality.word_vectors(d)
    scored = {r["doc_id"]: r["score"] for r in quality.score(d, quality.fit(d, sample, vectors), vectors, keep=["doc_id"]).collect()}
    assert len(scored) == 243 and np.mean([(scored[k] >= 0.5) == (k % 3 != 0) for k in range(240)]) > 0.95
    empty = quality.word_vectors(d.limit(0))
    assert quality.score(d.limit(0), quality.fit(d, sample.limit(0), empty), empty).count() == 0


def test_context_vectors_equal_a_plain_loop():
    tokens_, doc = np.array([3, 5, 3, 9, 4]), np.array([0, 0, 0, 1, 1])
    places, signs = quality.index_vectors()
    total = np.zeros(quality.BUCKETS * quality.WIDTH)
    quality.add_contexts(total, tokens_, doc, places, signs)
    want = np.zeros((quality.BUCKETS, quality.WIDTH))
    for a in range(5):
        for b in range(5):
            if a != b and abs(a - b) <= quality.WINDOW and doc[a] == doc[b]:
                for p, s in zip(places[tokens_[b]], signs[tokens_[b]], strict=True):
                    want[tokens_[a], p] += s
    assert np.allclose(total.reshape(want.shape), want)


def test_language_backs_off_and_knows_undetermined(spark):
    rows = [(k, "the house is red and green", "en") for k in range(20)] + [(k, "das haus ist rot und schön", "de") for k in range(20, 40)] + [(50, "x", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d)
    asked = docs_of(spark, [(1, "houses"), (2, "Häuser schöne"), (3, None), (4, ""), (5, "12 !!"), (6, "the " * 20_000), (None, "und")])
    got = {r["doc_id"]: (r["p"], r["s"]) for r in language_id.predict(asked, model, names=("p", "s")).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, 6, None)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.predict(asked, language_id.fit(d.limit(0)), names=("p", "s")).where("p <> 'und'").count() == 0


# --- op3 ---


def test_perfect_hash_is_minimal_and_strangers_fail_the_byte_check():
    keys = np.frombuffer(b"".join(hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(3000)), "<u8").reshape(-1, 4)
    mph = exact_dedup.PerfectHash.load(*exact_dedup.PerfectHash.build(keys[:2000]).dump())
    assert sorted(mph.slots(keys[:2000])) == list(range(2000))
    assert mph.slots(keys).max() < 2000


@pytest.mark.parametrize("split", [None, -1, 4, 10**9])
def test_exact_dedup_equals_brute_force(spark, docs, split):
    got = exact_dedup.exact_dedup(docs, split=split).collect()
    groups = {}
    for i, t in [*enumerate(TEXTS), (3, "a"), (None, "a"), (None, None)]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    want = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(TEXTS) + 3
    for sha, ids in want.items():
        own = [r for r in got if r["text_sha256"] == sha]
        assert [r["group_size"] for r in own] == [len(ids)] * len(ids)
        assert sum(r["kept"] for r in own) == 1
        assert {r["keep_id"] for r in own} == {min(i for i in ids if i is not None)}
        assert next(r for r in own if r["kept"])["doc_id"] == own[0]["keep_id"]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


# --- op4 ---


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[400:800] = x[5]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [1.0, None] * 6), (2080, [1.0]), (None, x[0].tolist())]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hits, y = 0, x.astype(float)
    for q, near in got.items():
        near.sort()
        s = y @ y[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(900), -s))[:20]
        assert [n[0] for n in near] == list(range(1, 21))
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in near)
        hits += len(set(order) & {v for _, v, _ in near})
        if 400 <= q < 800:
            assert [v for _, v, _ in near] == list(order)
    assert hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert ann.search(few, F.col("vec_id") % 20 == 0).count() == 2
    assert ann.search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# --- op6, op9 ---


def all_ids(path, keeps, end):
    return {k: np.array(e.ids + [end], "<u4") for k, e in enumerate(exact(path, keeps).encode_batch([t or "" for t in TEXTS], add_special_tokens=False))}


def test_pieces_and_packing(spark, docs):
    got = packing.pack(packing.pieces(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), BYTE, True, 2)).collect()
    ids = all_ids(BYTE, True, 2)
    for k, own in ids.items():
        mine = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["piece"])
        assert [r["length"] for r in mine][1:] == [1024] * (len(mine) - 1)
        assert sum(r["length"] for r in mine) == len(own)
        assert all(zlib.crc32(own[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in mine)
    filled = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 1024
    assert packing.pack(packing.pieces(docs.limit(0), BYTE, True, 2)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1025, 4000) if seed % 2 else np.minimum(rng.geometric(0.01, 4000), 1024)
    histogram = dict(zip(*np.unique(lengths, return_counts=True), strict=True))
    slots, n = packing.plan({int(k): int(v) for k, v in histogram.items()})
    placed, spans = {}, {}
    for s in slots:
        placed[s.length] = placed.get(s.length, 0) + s.bins * s.times
        for b in range(s.bins):
            spans.setdefault(s.sequence + b, []).append((s.offset, s.offset + s.length * s.times))
    assert placed == {int(k): int(v) for k, v in histogram.items()}
    assert len(spans) == n
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    assert n <= -(-int(lengths.sum()) // 1024) * 1.02 + 2


def test_exact_complements_come_first():
    slots, n = packing.plan({1000: 3, 24: 1, 12: 2, 8: 3, 500: 1})
    assert n == 4
    assert {s.length for s in slots if s.sequence == 0} == {1000, 24}


def test_directly_addressable_codes():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32), rng.integers(0, 70_000, 5000).astype(np.uint32)):
        dac = token_store.Dac(token_store.dac_encode(ids))
        assert (dac.slice(0, len(ids)) == ids).all()
        for i in rng.integers(0, max(len(ids), 1), 60)[: len(ids)]:
            assert dac.access(int(i)) == ids[i]
            j = int(rng.integers(i, len(ids) + 1))
            assert (dac.slice(int(i), j) == ids[i:j]).all()


def test_token_files(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "ROLL", 50)
    folder = f"file://{tmp_path}/tokens"
    manifest = token_store.write_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), folder, WORD, False, 1)
    got = sorted(token_store.read_tokens(manifest, folder).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, (k, own) in zip(got, sorted(all_ids(WORD, False, 1).items()), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, start, len(own), zlib.crc32(own))
        start += len(own)
    every = token_store.write_tokens(docs, folder + "2", WORD, False, 1)
    assert token_store.read_tokens(every, folder + "2").count() == len(TEXTS) + 3
    none = token_store.write_tokens(docs.limit(0), folder + "3", WORD, False, 1)
    assert token_store.read_tokens(none, folder + "3").count() == 0


# --- op8 ---


def test_url_parts_rules_and_reputation(spark):
    urls = ["HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en/", "https://b.net", "http://b.net/es/1", None, "no scheme", "http://h?q/x", "x://u.co.uk/p#/f", "http://new.b.net/de/", "", "http://com"]
    rows = [(k, u, None) for k, u in enumerate(urls)] + [(100 + k, "http://good.org/" + str(k), 1) for k in range(40)] + [(200 + k, f"http://bad.org/{k}", int(k % 8 == 0)) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good int")
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules).collect()}
    assert len(got) == len(rows)
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(len(urls))] == [
        ("www.example.com", "/en/x", "www.example.com/en/"), ("a.example.com", "/en/", "example.com/en/"), ("b.net", "", None), ("b.net", "/es/1", "net/es/"),
        ("", "", None), ("", "", None), ("h", "", None), ("u.co.uk", "/p", None), ("new.b.net", "/de/", None), ("", "", None), ("com", "", None),
    ]
    assert got[0]["verdict"] == "allow" and got[1]["verdict"] == "block"
    assert {got[100 + k]["verdict"] for k in range(40)} == {"allow"} and {got[200 + k]["verdict"] for k in range(40)} == {"block"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert url_filter.judge(pages.withColumn("good", pages["good"] * None), rules).count() == len(rows)


# --- op10 ---


def brute(rows, words=5, percent=75):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def top(x):
        return x if root[x] == x else top(root[x])

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[top(a)] = top(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if top(j) == top(k) and sets[j][0] is not None]
        links = {t for _, t in sets if t and t != s and s and 100 * len(s & t) >= percent * len(s | t)}
        out.append((i, len(s), min(ids) if ids else None, len(links)))
    return sorted(out, key=str)


def near_rows(n=60):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words, rng.integers(4, 90))) for _ in range(8)]
    rows = []
    for k in range(n):
        w = base[k % 8].split()
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w))] = "Edit" + str(rng.integers(0, 30))
        rows.append((k, " ".join(w)))
    passage = " ".join(rng.choice(words, 40))
    return rows + [(n + k, passage + " " + " ".join(rng.choice(words, 5 + k))) for k in range(12)]


@pytest.mark.parametrize("group_cells", [ngram_join.GROUP_CELLS, 300])
def test_join_equals_brute_force(spark, group_cells):
    rows = near_rows() + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A\tB"), (3, "a b"), (None, "a b"), (None, "")]
    got = ngram_join.ngram_join(docs_of(spark, rows).repartition(3), group_cells=group_cells).select("doc_id", "n_shingles", "component_id", "n_links")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_join_tells_shingles_apart_by_all_bits(spark):
    of = ngram_join.Shingles(1)
    one, two = (int(of(w)[0]) for w in ("w77442", "w101782"))
    assert one != two and one % 2**32 == two % 2**32
    rows = [(1, "a b c d e w77442"), (2, "a b c d e w101782"), (3, "a b c d e w77442 f")]
    got = ngram_join.ngram_join(docs_of(spark, rows), words=1).select("doc_id", "n_shingles", "component_id", "n_links")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, words=1) == [(1, 6, 1, 1), (2, 6, 2, 0), (3, 7, 1, 1)]


def test_join_keeps_one_row_of_a_component(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (4, "A b c d e f"), (None, "a b c d e f"), (7, "")]
    got = ngram_join.ngram_join(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["kept"]) == [(4, 4), (7, 7)]
    assert ngram_join.ngram_join(docs_of(spark, rows).limit(0)).count() == 0


def test_heap_and_counting_merge_alike(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(40)]
    sizes = np.array([len(s) for s in sets])
    found = []
    for heap in (0, 10**9):
        monkeypatch.setattr(ngram_join, "HEAP", heap)
        index = ngram_join.DivideSkip(sets, sizes, 40)
        own = []
        for k in range(len(sets)):
            own.append(sorted(index.search(k).tolist()))
            index.add(k)
        found.append(own)
    want = [[j for j in range(k) if 100 * len(np.intersect1d(sets[k], sets[j])) >= 40 * len(np.union1d(sets[k], sets[j]))] for k in range(len(sets))]
    assert found == [want, want]
