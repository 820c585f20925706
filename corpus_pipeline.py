"""The corpus pipeline: five stages over documents, each written as Parquet for the next.

A stage keeps the columns of documents (the last returns pieces placed in sequences).
Rows are told apart by their place in their file, so null and repeated ids are handled
as in the operators, and columns of documents may have any name. Language ID keeps a row
unless its language is undetermined or uncertain, toxicity unless its score reaches 0.5
(all rows are kept if there is no label to learn from), exact dedup and the n-gram join
keep the first row of a group, packing places every piece. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, exact_dedup, language_id, ngram_join, packing, toxicity

CERTAIN, TOXIC = 0.5, 0.5


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row that lasts: Spark deals files over the cores it has, so
    a place in a partition would not. It is the file's number and the row's place in the
    file; rows that do not come straight from files are written with their numbers."""
    try:
        about = docs.metadataColumn("_metadata")
        path, row = about["file_path"], about["row_index"]
        paths = [r["p"] for r in docs.select(path.alias("p")).distinct().collect()]  # one for each file, as Spark's own listing holds
    except AnalysisException:
        return common.written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    file = common.unused([*docs.columns, name], "_file")
    files = common.small_table(docs.sparkSession, {name: pa.array(range(len(paths)), pa.int64()), file: pa.array(sorted(paths), pa.string())})
    placed = docs.select("*", path.alias(file), row.alias(f"{file}_row"))
    return placed.join(F.broadcast(files), file).withColumn(name, F.shiftleft(name, 40) + F.col(f"{file}_row")).select(*docs.columns, name)


def _kept(docs: DataFrame, judge) -> DataFrame:
    """Rows of docs that judge(docs, name of a column that numbers them) keeps."""
    number = common.unused(docs.columns, "_row")
    numbered = _numbered(docs, number)
    kept = judge(numbered, number).where("kept").select(F.col("row_id").alias(number))
    return numbered.join(kept, number, "left_semi").select(*docs.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    lang, certain = common.unused(docs.columns, "_lang"), common.unused(docs.columns, "_certain")
    scored = language_id.predict(docs, model, names=(lang, certain))
    return scored.where((F.col(lang) != "und") & (F.col(certain) >= CERTAIN)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    sample = toxicity.labelled(common.table(spark, sf_dir, "labels"), "toxic", F.lit(True), toxicity.TRAIN_DOCS)
    model = toxicity.fit(docs, sample)
    name = common.unused(docs.columns, "_toxic")
    scored = toxicity.score(docs, model, name=name)
    return scored.where(~toxicity.is_toxic(F.col(name), model, TOXIC)).select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return _kept(docs, lambda rows, number: exact_dedup.exact_dedup(rows, place=number))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return _kept(docs, lambda rows, number: ngram_join.ngram_join(rows, place=number))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), True, 2))


STAGES = [("language_id", languages), ("toxicity", toxic), ("exact_dedup", copies), ("ngram_join", near_copies), ("best_fit_packing", sequences)]

#: Classifiers, tokenizers and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k + 1 < len(STAGES):
            out = common.written(out, f"stage-{name}")
    return out
