"""The registered queries on a small set of tables, against SQL or plain versions; learners
against plain loops; clashing names, nulls, repeats and lost places."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import common, components, exact_dedup, language_id, ngram_join, packing, quality, queries, toxicity

WORDS = {"en": "the house is green and small with many rooms".split(), "de": "das haus ist grün und klein mit vielen räumen".split()}
CLASH = {"_row": "'r'", "_lang": "'l'", "_certain": "0.0", "_toxic": "1.0", "_text": "'t'", "row_id": "7", "digest": "'d'", "label": "9", "_n": "1", "hot": "2", "keep_id": "'k'"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("tables")), np.random.default_rng(3)
    docs, labels = [], []
    for k in range(240):
        lang = "en" if k % 2 else "de"
        text = " ".join(rng.choice([*WORDS[lang], *(f"{lang}{chr(97 + j)}x" for j in range(20))], rng.integers(8, 60)))
        docs.append((k, text + (" stupid scum" if k % 6 == 0 else "") + (" $$ !! $$ !!" if k % 5 == 0 else ""), lang))
        labels.append((k, int(k % 5 != 0), int(k % 6 == 0)))
    docs += [(300 + k, docs[k][1].replace(" ", " \n", 3), docs[k][2]) for k in range(12)] + [(400 + k, docs[k][1] + " End", docs[k][2]) for k in range(12)]
    docs += [(500, None, "en"), (501, "", None), (502, " \t", "de"), (503, "a B", "en"), (504, "A b", None), (505, "12 ... 34", "en"), (506, "the house " * 3000, "en"), (507, "stupid", "en")]
    labels += [(500, None, None), (501, 1, 0)]
    frame = spark.createDataFrame([(*d, f"s{d[0] % 3}", len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(k, f"http://{'good' if k % 2 else 'Bad'}{k % 4}.example.{'com' if k % 3 else 'net'}/{'en' if k % 5 else 'es'}/p/{k % 240}.html") for k in range(300)]
    pages += [(900, None), (901, "x"), (901, "x"), (902, "http://h" + "/y" * 20_000 + "?q"), (903, "ftp://A.CO.UK#f")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    vectors = rng.normal(size=(120, 8)).astype(np.float32)
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, docs, labels


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, tables, name):
    duck = duckdb.connect()
    for table in ("documents", "labels", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables[0]}/{table}.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, tables[0]).toPandas(), duck.sql(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    same = lambda x: x[columns].sort_values(columns).reset_index(drop=True)
    assert sorted(got.columns) == columns
    pd.testing.assert_frame_equal(same(got), same(want), check_dtype=False)


@pytest.mark.parametrize(("name", "mod", "fold", "least"), [("op2_quality", 4, 2, 0.7), ("op5_toxicity", 5, 0, 0.5)])
def test_scores_hold_the_contract(spark, tables, name, mod, fold, least):
    rows = {r["doc_id"]: r for r in queries.QUERIES[name](spark, tables[0]).collect()}
    assert set(rows) == {d[0] for d in tables[1]}
    for k, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % mod == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)


def test_languages_hold_the_contract(spark, tables):
    rows = {r["doc_id"]: r for r in queries.op7_language_id(spark, tables[0]).collect()}
    assert {k for k, r in rows.items() if r["lang_pred"] == "und"} == {500, 501, 502, 505}
    assert all(rows[k]["lang_pred"] == ("en" if k % 2 else "de") for k in range(240))
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in rows.items())


def test_stored_tokens_packs_and_samples_cover_all_documents(spark, tables):
    from tokenizers import Tokenizer

    texts = {d[0]: d[1] or "" for d in tables[1]}
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: np.array([*word.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    start = 0
    for r in sorted(queries.op9_token_store(spark, tables[0]).collect(), key=lambda r: r["doc_id"]):
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(own))
        start += len(own)
    packed = queries.op6_best_fit_packing(spark, tables[0]).toPandas()
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packed.groupby("doc_id")["length"].sum().to_dict() == {k: len(byte.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}
    filled = packed.sort_values("offset").groupby("sequence_id")["length"].agg(["sum", list])
    assert filled["sum"].max() <= 1024 and len(filled) <= -(-packed["length"].sum() // 1024) + 2
    assert all(r["lossless"] for r in queries.op1_sentencepiece(spark, tables[0]).collect())


def test_neighbours_are_ranked_and_measured(spark, tables):
    rows = queries.op4_nearest_neighbours(spark, tables[0]).toPandas()
    assert sorted(rows["query_id"].unique()) == [0, 20, 40, 60, 80, 100]
    assert (rows.groupby("query_id")["rank"].apply(list).map(lambda x: x == list(range(1, 21)))).all()


# --- learners against plain loops ---


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    examples = [(np.unique(rng.integers(0, 30, 6)), int(rng.random() < 0.4)) for _ in range(200)]
    model = toxicity.Ftrl(30)
    for at, label in examples:
        model.learn(at, label)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        free = 0.0 if k == 30 else toxicity.L1
        if abs(z[k]) <= free:
            return 0.0
        return (math.copysign(free, z[k]) - z[k]) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for at, label in examples:
        own = [*at.tolist(), 30]
        w = {k: weight(k) for k in own}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for k in own:
            sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA
            z[k] += g - sigma * w[k]
            n[k] += g * g
    assert np.allclose(model.weights(slice(None)), [weight(k) for k in range(31)])


def test_back_off_equals_a_plain_version(spark):
    rows = [(k, " ".join(WORDS["en" if k % 2 else "de"][k % 3 :]), "en" if k % 2 else "de") for k in range(30)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: collections.Counter(w for _, t, x in rows if x == lang for w in t.split()) for lang in ("de", "en")}
    grams = lambda w, n: [f"<{w}>"[k : k + n] for k in range(len(w) + 3 - n)] if n > 1 else list(w)
    by_size = {(lang, n): collections.Counter() for lang in counts for n in range(1, 6)}
    for lang, seen in counts.items():
        for w, c in seen.items():
            for n in range(1, 6):
                for g in grams(w, n):
                    by_size[lang, n][g] += c

    def logs(item, of):
        kinds = len(set().union(*(c.keys() for c in of.values())))
        return [math.log((of[lang][item] + 0.5) / (sum(of[lang].values()) + 1 + kinds / 2)) for lang in ("de", "en")]

    def plain(word):
        if any(word in c for c in counts.values()):
            return logs(word, counts)
        for n in range(5, 0, -1):
            of = {lang: by_size[lang, n] for lang in ("de", "en")}
            if known := [g for g in grams(word, n) if any(g in c for c in of.values())]:
                return list(np.mean([logs(g, of) for g in known], axis=0))
        return [0.0, 0.0]

    for word in ("house", "häuser", "greenish", "räume", "qqq", "x", "klein", "ü"):
        assert np.allclose(model.word(word), plain(word)), word


def test_network_and_pooling_equal_plain_loops():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(quality.BUCKETS, quality.WIDTH)).astype(np.float32)
    of = quality.Buckets()
    at = of("One two, two!")
    got = quality.pooled(of, vectors, "One two, two!")
    own = [vectors[k].astype(float) for k in at]
    mean = sum(own) / len(own)
    assert np.allclose(got, np.concatenate([mean, np.sqrt(sum((x - mean) ** 2 for x in own) / len(own))]), atol=1e-5)
    x, y = rng.normal(size=(200, 2 * quality.WIDTH)), rng.integers(0, 2, 200).astype(float)
    net = quality.Network().fit(x, y)
    logits = []
    for row in x:
        z = (row - net.mean) / net.scale
        hidden = [max(0.0, sum(a * b for a, b in zip(z, net.p[0][:, h], strict=True)) + net.p[1][h]) for h in range(quality.HIDDEN)]
        logits.append(sum(a * b for a, b in zip(hidden, net.p[2], strict=True)) + net.p[3][0])
    logits = np.array(logits)
    assert np.allclose(net.scores(x), 1 / (1 + np.exp(-np.clip(logits / net.temperature, -35, 35))))
    apart = np.arange(200) % 8 == 7
    loss = lambda t: np.mean([math.log1p(math.exp(-v / t)) if label else math.log1p(math.exp(v / t)) for v, label in zip(logits[apart], y[apart], strict=True)])
    assert loss(net.temperature) <= min(loss(t) for t in np.geomspace(0.25, 8, 60)) + 1e-9


def test_of_documents_that_repeat_a_labelled_id_one_is_learned(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"t{k}") for k in range(50)] + [(2, "x"), (3, None)], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (9, 1)], "doc_id long, label int")
    rows = toxicity.labelled_texts(docs, sample).collect()
    assert sorted((r["doc_id"], r["label"]) for r in rows) == [(1, 1), (2, 0), (3, 1)]
    monkeypatch.setattr(toxicity, "TRAIN_FEATURES", 1)
    assert len(toxicity.fit(docs, sample)) == 3


# --- packing ---


def test_complements_are_found_by_their_sum():
    index = packing.Complements({700: 2, 324: 1, 200: 1, 124: 1, 100: 3}, 1024)
    index.n[700] = 2
    assert index.filling(324) == [324]
    index.n[324] -= 1
    assert index.filling(324) == [200, 124]
    index.n[200] -= 1
    assert index.filling(324) == [124, 100, 100]
    index.n[100] -= 2
    assert index.filling(324) is None


# --- joins, components, places ---


def test_texts_whose_hashes_share_low_bits_are_told_apart(spark):
    rows = [(k, w) for k, w in enumerate(("word32302", "word115088", "word8932", "word179694", "word8932"))]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (2, 0)}


def test_components_of_any_edges(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, None), (300, 301), (301, 300), (300, 301)]
    got = {r["id"]: r["label"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_like_others(spark, how):
    big = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(120)] + [(None, 500)], "key long, v long")
    small = spark.createDataFrame([(k, f"n{k}") for k in range(100)], "key long, name string")
    got = sorted(map(str, common.join_unique(big, small, "key", how).select("key", "v", "name").collect()))
    assert got == sorted(map(str, big.join(small, "key", how).select("key", "v", "name").collect()))


def test_stages_keep_the_same_rows_when_the_cluster_changes(spark, tmp_path):
    rows = [(k, f"text {k % 700} with some more words to read", *["x"] * len(CLASH)) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH))
    docs.repartition(37).write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
    try:
        for stage in (corpus_pipeline.copies, corpus_pipeline.near_copies):
            out = stage(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
            assert out.columns == docs.columns
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "16")
            assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == list(range(700))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_columns_of_any_name_pass_through_the_stages(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").selectExpr("*", *(f"{v} AS {k}" for k, v in CLASH.items()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables[0])
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), tables[0]).count() == 0
    assert corpus_pipeline.sequences(spark, docs.limit(0), tables[0]).count() == 0


def test_null_ids_are_in_no_fold(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long").select(common.in_fold("doc_id", 4, 2).alias("x"))
    assert [r["x"] for r in df.collect()] == [False, zlib.crc32(b"1") % 4 == 2]


def test_dedup_ignores_clashing_columns_and_long_texts(spark):
    long = "word\t" * 200_000
    docs = spark.createDataFrame([(2, long), (1, re.sub(r"\t", " ", long)), (None, None), (None, "")], "doc_id long, text string").selectExpr("*", *(f"{v} AS {k}" for k, v in CLASH.items()))
    got = sorted(((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    assert got.count((1, 1, 2, True)) == 1 and got.count((2, 1, 2, False)) == 1
    assert sorted(g[2:] for g in got if g[1] is None) == [(2, False), (2, True)]
    assert docs.where(F.col("doc_id").isNull()).count() == 2
