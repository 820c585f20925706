"""The package path against the Column operators, and packages that are hard to read."""

import pytest
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import text as T
from quire.operators import render, sequences
from quire.operators.verify import verify
from quire.sources import docx, packages


def test_numerals_and_counters_agree(spark):
    formats = ["decimal", "decimalZero", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "bullet", "odd"]
    asked = spark.createDataFrame([(n, f) for n in (0, 1, 4, 9, 26, 27, 52, 53, 399, 702, 703, 1994, 3999) for f in formats], "n int, fmt string")
    for r in asked.select("*", N.counter_text(F.col("n"), F.col("fmt")).alias("got")).collect():
        assert r["got"] == render.counter(r["n"], r["fmt"]), r


def test_texts_agree(spark):
    texts = ["", " a  b ", "\n\n x\r\ny\t\n ", "<a href=\"x\">&amp;</a>\x01\x7f", "é\u0085z", "a\r", "  \n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_whitespace(F.col("t")).alias("clean"), T.xml_escape(F.col("t")).alias("escaped")).collect()
    assert [(r["clean"], r["escaped"]) for r in rows] == [(docx.clean_space(t), render.escape(t)) for t in texts]


def test_links_headings_and_borders_agree(spark):
    fields = [' HYPERLINK "http://a" ', 'HYPERLINK "u" \\l "m"', 'HYPERLINK \\l "m"', "HYPERLINK x \\t y", "PAGE", "HYPERLINK"]
    got = spark.createDataFrame([(f,) for f in fields], "f string").select("f", T.hyperlink_target(F.col("f")).alias("t")).collect()
    assert [r["t"] or "" for r in got] == [docx.hyperlink_target(f) for f in fields]
    ids = ["Heading1", "heading9", "HEADING+3", "heading02", "Title", "subtitle", "Heading", "Heading10", "x"]
    got = spark.createDataFrame([(i,) for i in ids], "i string").select("i", T.heading_level(F.col("i")).alias("h")).collect()
    assert [r["h"] for r in got] == [docx.heading_of(i) for i in ids]
    styles = ["single", "double", "dashed", "dashSmallGap", "dotted", "none", "nil", "wave", ""]
    got = spark.createDataFrame([(s,) for s in styles], "s string").select("s", N.border_attribute(N.border_side("bt", F.col("s"), F.lit(4), F.lit(1), F.lit("auto"))).alias("b")).collect()
    assert [r["b"] for r in got] == [render.borders({"top": (s, 4, 1, "auto")}) for s in styles]


def test_merges_agree(spark):
    kinds = ["", "continue", "restart", "continue", "continue", "", "continue", "restart", "restart", "continue"]
    table = docx.Block("table", rows=[(False, [docx.Cell(merge=k)]) for k in kinds])
    docx._merge(table)
    df = spark.createDataFrame([(0, k, kind) for k, kind in enumerate(kinds)], "c int, k int, kind string")
    got = sequences.merge_groups(df, ["c"], ["k"], F.col("kind") == "restart", F.col("kind") == "continue").orderBy("k").collect()
    assert [(bool(r["omitted"]), r["row_span"] or 0) for r in got] == [(c.omitted, c.row_span) for _, (c,) in table.rows]


def test_of_several_restarts_in_a_row_the_last_can_be_joined():
    rows = [["restart", "restart"], ["continue", "continue"], ["continue", "continue"]]
    table = docx.Block("table", rows=[(False, [docx.Cell(merge=k) for k in row]) for row in rows])
    docx._merge(table)
    assert [[(c.omitted, c.row_span) for c in cells] for _, cells in table.rows] == [[(False, 0), (False, 3)], [(False, 2), (True, 0)], [(False, 2), (True, 0)]]


def of(spark, body, **parts):
    rows = [("word/document.xml", packages.document_part(body)), *((f"word/{k}.xml", v) for k, v in parts.items())]
    return packages.from_parts(spark.createDataFrame([(1, rows)], "doc_id long, parts array<struct<name:string,text:string>>"))


def test_deep_packages_are_errors_and_others_are_read(spark):
    deep = "<w:tbl><w:tr><w:tc>" * 500 + "<w:p/>" + "</w:tc></w:tr></w:tbl>" * 500
    held = of(spark, deep).unionByName(of(spark, "<w:p/>"))
    assert [r["error"] for r in packages.errors(held).collect()] == ["main part: nested too deeply"]
    assert packages.blocks(held).count() == 1 and packages.rendered(held).count() == 1


def test_one_parse_gives_every_table(spark):
    styles = f'<w:styles xmlns:w="{packages.NS}"><w:style w:styleId="N"><w:name w:val="n"/></w:style></w:styles>'
    body = '<w:p><w:r><w:rPr><w:sz w:val="30"/></w:rPr><w:t>x</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl><w:sectPr><w:pgSz w:w="1440" w:h="720"/></w:sectPr>'
    held = packages.parsed(of(spark, body, styles=styles)).cache()
    counts = {name: packages.table(held, name).count() for name in packages.TABLES}
    assert counts == {"blocks": 2, "runs": 1, "tables": 1, "cells": 1, "notes": 0, "styles": 1, "levels": 0, "meta": 0, "sections": 1, "theme": 0, "rels": 0, "defaults": 1}
    assert packages.table(held, "runs").first()["size"] == 15.0
    none = packages.parsed(packages.from_parts(spark.createDataFrame([], "doc_id long, parts array<struct<name:string,text:string>>")))
    assert all(packages.table(none, name).count() == 0 for name in packages.TABLES)


@pytest.mark.parametrize("body", ['<p font="a">x</p>', "<p>a&nbsp;b & c</p>", "<p align=center>x</p>", "<p><b>x</p>", "<p>a<![CDATA[<x>]]></p>", "<!-- c --><p hidden>x</p>"])
def test_verification_is_not_strict(body):
    head = '<words xmlns="urn:words:v1" version="1.2.0" mode="semantic" fidelity="verbatim" policy="preserve-and-flag"><style unit="in"/><write>'
    assert verify(f"{head}{body}</write></words>") == (True, [], [])


def test_what_is_known_within_an_unknown_element_counts():
    head = '<words xmlns="urn:words:v1" version="1.2.0" mode="semantic" fidelity="verbatim" policy="preserve-and-flag">'
    assert verify(f'{head}<odd><style unit="in"/><write/></odd></words>') == (True, [], ["unexpected top-level element <odd>"])


def test_both_clis_modes(spark, tmp_path, capsys):
    from quire import cli

    body = '<w:p><w:r><w:t> a  b</w:t></w:r><w:del w:author="z"><w:r><w:delText>c</w:delText></w:r></w:del></w:p>'
    (tmp_path / "one.docx").write_bytes(packages.package({"word/document.xml": packages.document_part(body)}))
    for mode, line in (("semantic", "<p> a b</p>"), ("lossless", '<p> a  b<del author="z">c</del></p>')):
        cli.main([str(tmp_path), "--mode", mode])
        assert line in capsys.readouterr().out
    cli.main([str(tmp_path), "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
