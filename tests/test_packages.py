"""Packages as rows: errors, batches from files and streams, partitions that do not matter."""

import pytest

from quire.plans import catalogue
from quire.sources import packages
from quire.streaming import ingest


def _rows(spark, *contents):
    return spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "doc_id long, content binary")


def test_bad_packages_are_told_apart(spark):
    good = packages.package({"word/document.xml": packages.document_part("<w:p/>")})
    rows = _rows(spark, good, b"x", None)
    assert {r["doc_id"] for r in packages.errors(rows).collect()} == {1, 2}
    assert [r["doc_id"] for r in packages.rendered(rows).collect()] == [0]
    assert [r["valid"] for r in packages.verified(packages.rendered(rows)).collect()] == [True]


def test_tables_of_a_package(spark):
    cell = "<w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc>"
    rows = _rows(spark, packages.package({"word/document.xml": packages.document_part(f"<w:tbl><w:tr>{cell}{cell}</w:tr></w:tbl><w:bookmarkStart w:id='1' w:name='m'/>")}))
    assert [(r["grid_col"], r["grid_span"], r["text"]) for r in packages.cells(rows).orderBy("cell_idx").collect()] == [(0, 2, "c"), (2, 2, "c")]
    assert [(r["type"], r["name"], r["doc_order"]) for r in packages.notes(rows).collect()] == [("bm", "m", 3)]
    assert packages.levels(rows).count() == 0


def test_table_function(spark):
    packages.register(spark)
    good = packages.package({"word/document.xml": packages.document_part("<w:p><w:r><w:t>a</w:t></w:r></w:p><w:tbl/>")})
    _rows(spark, good, b"x").createOrReplaceTempView("held")
    got = spark.sql("SELECT doc_id, block_seq, kind, text FROM held, LATERAL docx_blocks(content)").collect()
    assert sorted(map(tuple, got)) == [(0, 0, "paragraph", "a"), (0, 1, "table", "")]


def test_empty_table(spark):
    empty = _rows(spark).limit(0)
    for table in (packages.blocks, packages.cells, packages.notes, packages.styles, packages.rendered, packages.errors):
        assert table(empty).count() == 0


def test_files_and_stream(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.docx").write_bytes(packages.package({"word/document.xml": packages.document_part(f"<w:p><w:r><w:t>{k}</w:t></w:r></w:p>")}))
    batch = {r["words_xml"] for r in packages.rendered(packages.scan(spark, str(tmp_path))).collect()}
    query = ingest.render_stream(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "state"), files_a_batch=2)
    query.awaitTermination()
    assert {r["words_xml"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
    assert len(batch) == 3


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    texts = lambda n: {tuple(r) for r in packages.rendered(packages.from_texts(docs.repartition(n))).select("doc_id", "words_xml").collect()}
    assert texts(1) == texts(7)


def test_entry_has_rows(spark):
    assert catalogue.document_outline(spark, "/root/testdata/sf0.001").limit(1).count() == 1


def test_small_files_of_many_packages_keep_all_cores_busy(spark, tmp_path):
    """The file of 5,000 rows is one split; their packages are tasks of at most TASK_ROWS."""
    rows = spark.range(5000).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size")
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert spark.read.parquet(str(tmp_path / "part.parquet")).rdd.getNumPartitions() == 1
    got = catalogue.QUERIES["docx_heading_levels"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == -(-5000 // packages.TASK_ROWS)
    assert got.count() == 8 * 5000 and got.select("doc_id").distinct().count() == 5000


def test_only_asked_columns_are_handed_on(spark):
    rows = _rows(spark, packages.package({"word/document.xml": packages.document_part("<w:p/><w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr></w:p>")}), b"x")
    parsed = packages.parsed(rows, ("blocks",), columns=("block_seq", "heading_level"))
    assert parsed.schema["blocks"].dataType.elementType.names == ["block_seq", "heading_level"]
    assert sorted(map(tuple, packages.table(parsed, "blocks").collect())) == [(0, 0, 0), (0, 1, 2)]
    whole = packages.blocks(rows)
    assert sorted(map(tuple, whole.select("doc_id", "block_seq", "heading_level").collect())) == [(0, 0, 0), (0, 1, 2)]
    with pytest.raises(ValueError):
        packages.parsed(rows, ("blocks",), columns=("absent",))
