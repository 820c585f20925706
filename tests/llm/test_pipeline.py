"""The pipeline on a small corpus with planted cases, against a plain version of each stage."""

import weakref

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from quire.llm import language_id, tokens


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(9)
    words = {"en": ["the", "house", "is", "green", "and", "small", "with", "many", "rooms"], "de": ["das", "haus", "ist", "grün", "und", "klein", "mit", "vielen", "räumen"]}
    rows, labels = [], []
    for k in range(160):
        lang = "en" if k % 2 else "de"
        text = " ".join(rng.choice([*words[lang], *(f"{lang}x{j}" for j in range(60))], 40))
        toxic = k % 5 == 0
        rows.append((k, text + (" stupid scum" if toxic else ""), lang))
        labels.append((k, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(200 + k, r[1].replace(" ", "\t\n"), r[2]) for k, r in enumerate(clean[:10])]  # copies but for white space
    rows += [(300 + k, r[1] + " end", r[2]) for k, r in enumerate(clean[:10])]  # near copies
    rows += [(400, None, "en"), (401, "", None), (402, "12 34 !!", "en"), (403, "you stupid scum of the house", "en"), (404, "the house " * 2000, "en")]
    df = spark.createDataFrame([(*r, f"src{r[0] % 3}", len(r[1] or ""), "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), df.columns, {r[0]: r[1] for r in rows}


def test_stages_keep_what_a_plain_version_keeps(spark, corpus):
    folder, columns, texts = corpus
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    every = set(texts)
    assert ids[0] == every - {400, 401, 402}
    assert ids[1] == {k for k in ids[0] if "stupid" not in texts[k]}
    assert ids[2] == {k for k in ids[1] if not 200 <= k < 300}
    assert ids[3] == {k for k in ids[2] if not 300 <= k < 400}


def test_the_whole_run_packs_what_is_kept(spark, corpus):
    from tokenizers import Tokenizer

    folder, _, texts = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {k for k, t in texts.items() if k < 200 and k % 5 or k == 404}
    assert {r["doc_id"] for r in got} == kept
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k in kept:
        assert sum(r["length"] for r in got if r["doc_id"] == k) == len(t.encode(texts[k], add_special_tokens=False).ids) + 1
    ends = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024


def test_numbering_starts_no_python_workers(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    plan = corpus_pipeline._numbered(docs, "n")._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "RDD" not in plan  # rows of a list come from Python workers of their own


def test_a_worker_lets_go_what_it_kept_for_another_step():
    kept = weakref.ref(tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"), True))
    assert tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"), True) is kept()
    list(language_id._counts(iter([])))
    assert kept() is None
