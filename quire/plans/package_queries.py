"""Queries over packages made from the tables at hand: the XML of each part is built by
Column expressions, so parser, renderer and verifier are held against SQL that never sees
a package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.registry import query, read
from quire.sources import packages
from quire.sources.scratch import scratch, written

NS = f'xmlns:w="{packages.NS}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def _x(*parts: str | Column) -> Column:
    """Strings and columns, one after the other."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _if(condition: str | Column, *parts: str | Column) -> Column:
    return F.when(F.expr(condition) if isinstance(condition, str) else condition, _x(*parts)).otherwise("")


def _text(*parts: str | Column, props: str | Column = "") -> Column:
    return _x("<w:r><w:rPr>", props, '</w:rPr><w:t xml:space="preserve">', *parts, "</w:t></w:r>")


def _p(*parts: str | Column, props: str | Column = "") -> Column:
    return _x("<w:p><w:pPr>", props, "</w:pPr>", *parts, "</w:p>")


def _packages(df: DataFrame, doc_id: str, body: Column, **parts: str | Column) -> DataFrame:
    """Packages with this body; further parts by name, dots and slashes written as __ and ___."""
    own = {"word/document.xml": _x(f"<w:document {NS}><w:body>", body, "</w:body></w:document>")}
    own |= {name.replace("___", "/").replace("__", "."): _x(x) for name, x in parts.items()}
    made = F.array(*[F.struct(F.lit(name).alias("name"), x.alias("text")) for name, x in own.items()])
    return packages.from_parts(packages.spread(df).select(F.col(doc_id).alias("doc_id"), made.alias("parts")))


def _inside(rendered: DataFrame, tag: str, name: str) -> DataFrame:
    """What stands between the lines of an element of the rendering."""
    inside = F.regexp_extract("words_xml", rf"(?s)<{tag}[^>]*>\n(.*)  </{tag}>", 1)
    return rendered.select("doc_id", inside.alias(name))


def _styles(*styles: str | Column, defaults: str = "") -> Column:
    return _x(f"<w:styles {NS}>", defaults, *styles, "</w:styles>")


def _style(style_id: str, name: str, inner: str = "", based_on: str = "", kind: str = "paragraph") -> str:
    base = f'<w:basedOn w:val="{based_on}"/>' if based_on else ""
    return f'<w:style w:type="{kind}" w:styleId="{style_id}"><w:name w:val="{name}"/>{base}{inner}</w:style>'


# --- runs -------------------------------------------------------------------------------


@query("""
WITH m AS (SELECT p_partkey AS k, 'a&lt;' || p_brand || '&quot;' AS t FROM part),
m1 AS (SELECT k, CASE WHEN k & 1 > 0 THEN '<smallcaps>' || t || '</smallcaps>' ELSE t END AS t FROM m),
m2 AS (SELECT k, CASE WHEN k & 2 > 0 THEN '<uppercase>' || t || '</uppercase>' ELSE t END AS t FROM m1),
m3 AS (SELECT k, CASE WHEN k & 4 > 0 THEN '<b>' || t || '</b>' ELSE t END AS t FROM m2),
m4 AS (SELECT k, CASE WHEN k & 8 > 0 THEN '<i>' || t || '</i>' ELSE t END AS t FROM m3),
m5 AS (SELECT k, CASE WHEN k & 16 > 0 THEN '<u>' || t || '</u>' ELSE t END AS t FROM m4),
m6 AS (SELECT k, CASE WHEN k & 32 > 0 THEN '<s>' || t || '</s>' ELSE t END AS t FROM m5),
m7 AS (SELECT k, CASE k % 3 WHEN 1 THEN '<sup>' || t || '</sup>' WHEN 2 THEN '<sub>' || t || '</sub>' ELSE t END AS t FROM m6)
SELECT k AS doc_id, '    <p>' || t || 'plain</p>' || chr(10) AS body FROM m7
""")
def docx_run_marks(spark, sf_dir):
    """Toggles on and off, and the order in which marks wrap."""
    toggle = lambda tag, bit: F.when(F.expr(f"p_partkey & {bit} > 0"), f"<w:{tag}/>").otherwise(f'<w:{tag} w:val="0"/>')
    props = _x(
        toggle("smallCaps", 1), toggle("caps", 2), toggle("b", 4), toggle("i", 8), _if("p_partkey & 16 > 0", '<w:u w:val="single"/>'),
        F.when(F.expr("p_partkey & 96 = 96"), "<w:dstrike/>").otherwise(toggle("strike", 32)),
        _if("p_partkey % 3 > 0", '<w:vertAlign w:val="', F.when(F.expr("p_partkey % 3 = 1"), "superscript").otherwise("subscript"), '"/>'),
    )
    body = _p(_text("a&lt;", F.col("p_brand"), "&quot;", props=props), _text("plain"))
    return _inside(packages.rendered(_packages(read(spark, sf_dir, "part"), "p_partkey", body)), "write", "body")


@query("""
WITH s AS (SELECT p_partkey AS k, p_size AS z,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' font="Georgia"' WHEN 2 THEN ' font="Calibri"' ELSE ' font="R&amp;D &quot;S&quot;"' END AS font,
  CASE WHEN p_size = 22 THEN '' ELSE ' size="' || rtrim(rtrim(printf('%.6f', p_size / 2.0::DOUBLE), '0'), '.') || 'pt"' END AS size,
  CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' color="FF0000"' ELSE ' color="00FF0' || p_size % 10 || '"' END AS color,
  CASE p_partkey % 5 WHEN 1 THEN ' highlight="yellow"' ELSE '' END AS highlight, CASE p_partkey % 7 WHEN 0 THEN ' lang="de-DE"' ELSE '' END AS lang,
  CASE p_partkey % 2 WHEN 0 THEN ' hidden="true"' ELSE '' END AS hidden, CASE p_partkey % 11 WHEN 0 THEN ' dir="rtl"' ELSE '' END AS dir FROM part)
SELECT k AS doc_id, CASE WHEN a = '' THEN 'x' ELSE '<span' || a || '>x</span>' END AS run, CASE WHEN k % 7 = 0 THEN 'de-DE' ELSE '' END AS lang
FROM (SELECT k, font || size || color || highlight || lang || hidden || dir AS a FROM s)
""")
def docx_span(spark, sf_dir):
    """Run properties that differ from the document's defaults, theme fonts among them."""
    k = lambda n: F.col("p_partkey") % n
    fonts = F.when(k(4) == 0, '<w:rFonts w:hAnsi="Tahoma"/>').when(k(4) == 1, '<w:rFonts w:ascii="Georgia" w:hAnsi="Tahoma"/>').when(k(4) == 2, '<w:rFonts w:asciiTheme="minorHAnsi"/>').otherwise('<w:rFonts w:ascii="R&amp;D &quot;S&quot;"/>')
    props = _x(
        fonts, '<w:sz w:val="', F.col("p_size"), '"/>', _if(k(3) == 1, '<w:color w:val="FF0000"/>'), _if(k(3) == 2, '<w:color w:val="#00FF0', F.col("p_size") % 10, '"/>'),
        '<w:highlight w:val="', F.when(k(5) == 1, "yellow").otherwise("none"), '"/>', _if(k(7) == 0, '<w:lang w:val="de-DE"/>'), _if(k(2) == 0, "<w:vanish/>"), _if(k(11) == 0, "<w:rtl/>"),
    )
    defaults = '<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Tahoma"/><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults>'
    theme = f'<a:theme xmlns:a="{A}"><a:themeElements><a:fontScheme><a:minorFont><a:latin typeface="Calibri"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'
    made = _packages(read(spark, sf_dir, "part"), "p_partkey", _p(_text("x", props=props)), word___styles__xml=_styles(defaults=defaults), word___theme___theme1__xml=theme)
    run = F.regexp_extract("words_xml", r"<p[^>]*>(.*)</p>", 1)
    return packages.rendered(made).select("doc_id", run.alias("run"), F.regexp_extract("words_xml", r'<p[^>]* lang="([^"]*)"', 1).alias("lang"))


@query("""
SELECT p_partkey AS doc_id, 'new' AS style_name, t.text, p_brand AS font, t.text = 'a' AND p_partkey % 2 = 0 AS bold, t.text = 'a' AND p_partkey % 2 = 0 AS italic, CASE t.text WHEN 'b' THEN 'single' ELSE '' END AS underline
FROM part, (VALUES ('a'), ('b')) t(text)
""")
def docx_run_defaults(spark, sf_dir):
    """Of styles with one id the last counts; its fonts reach every run, its marks and the
    paragraph's only runs without properties, and only where the paragraph has some."""
    style = lambda name, font: _x(f'<w:style w:type="paragraph" w:styleId="S"><w:name w:val="{name}"/><w:rPr><w:rFonts w:ascii="', font, '"/><w:b/></w:rPr></w:style>')
    props = _x('<w:pStyle w:val="S"/>', _if("p_partkey % 2 = 0", "<w:rPr><w:i/></w:rPr>"))
    body = _p("<w:r><w:t>a</w:t></w:r>", _text("b", props='<w:u w:val="single"/>'), props=props)
    held = packages.parsed(_packages(read(spark, sf_dir, "part"), "p_partkey", body, word___styles__xml=_styles(style("old", "Old"), style("new", F.col("p_brand")))), ("blocks", "runs"))
    names = packages.table(held, "blocks").select("doc_id", "style_name")
    return packages.table(held, "runs").select("doc_id", "text", "font", "bold", "italic", "underline").join(names, "doc_id")


@query("""
SELECT c_custkey AS doc_id, 'paragraph' AS kind, c_name AS text FROM customer
""")
def docx_files(spark, sf_dir):
    """Packages written as files, found again by a scan of their folder, and read."""
    folder = scratch(spark, "files")
    made = _packages(read(spark, sf_dir, "customer"), "c_custkey", _p(_text(F.col("c_name"))))
    written(packages.write_files(made, folder), "files-written")
    found = packages.scan(spark, folder).select(F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long").alias("doc_id"), "content")
    return packages.blocks(found).select("doc_id", "kind", "text")


@query("""
SELECT p_partkey AS doc_id, CAST(n AS INT) AS seq, kind, text, target FROM part, LATERAL (
  SELECT 0 AS n, 'br' AS kind, '' AS text, 'page' AS target WHERE p_partkey % 2 = 0 UNION ALL
  SELECT (p_partkey + 1) % 2, 'tab', '', '' UNION ALL SELECT (p_partkey + 1) % 2 + 1, 'text', p_brand, '' UNION ALL
  SELECT (p_partkey + 1) % 2 + 2, 'text', 'u', '' UNION ALL SELECT (p_partkey + 1) % 2 + 3, 'br', '', CASE WHEN p_partkey % 3 = 0 THEN 'column' ELSE 'textWrapping' END UNION ALL
  SELECT (p_partkey + 1) % 2 + 4, 'text', chr(172), '' UNION ALL SELECT (p_partkey + 1) % 2 + 5, 'text', chr(173), '' UNION ALL
  SELECT (p_partkey + 1) % 2 + 6, 'sym', '', 'F0' || p_partkey % 10 || 'A' UNION ALL SELECT (p_partkey + 1) % 2 + 7, 'note', '', 'footnote' UNION ALL
  SELECT (p_partkey + 1) % 2 + 8, 'img', '', CASE WHEN p_partkey % 5 = 0 THEN 'word/media/i.png' ELSE 'r' || p_partkey % 5 END)
""")
def docx_run_atoms(spark, sf_dir):
    """Tabs and breaks in their place, special signs, symbols, references and VML pictures."""
    k = F.col("p_partkey")
    body = _p(
        _x("<w:r><w:tab/><w:t>", F.col("p_brand"), "</w:t></w:r>"), "<w:r><w:t>u</w:t><w:br", _if(k % 3 == 0, ' w:type="column"'), "/></w:r>",
        "<w:r><w:noBreakHyphen/></w:r><w:r><w:softHyphen/></w:r>", '<w:r><w:sym w:font="W" w:char="F0', k % 10, 'A"/></w:r>', '<w:r><w:footnoteReference w:id="4"/></w:r>',
        '<w:r><w:pict><v:shape xmlns:v="urn:v"><v:imagedata r:id="r', k % 5, '"/></v:shape></w:pict></w:r>',
        props=_if(k % 2 == 0, "<w:pageBreakBefore/>"),
    )
    rels = '<Relationships xmlns="urn:r"><Relationship Id="r0" Target="media/i.png"/></Relationships>'
    runs = packages.runs(_packages(read(spark, sf_dir, "part"), "p_partkey", body, word____rels___document__xml__rels=rels))
    return runs.select("doc_id", "seq", "kind", "text", "target")


@query("""
SELECT s_suppkey AS doc_id, m.mode, 'k' || CASE WHEN m.mode = 'lossless' THEN
  '<ins author="' || s_name || '" date="2024">new</ins><del author="B">old</del><ins author="C">late</ins><del author="D">gone</del>' ELSE 'newlate' END AS run,
  CASE m.mode WHEN 'lossless' THEN ' two  spaces ' ELSE ' two spaces' END AS second
FROM supplier, (VALUES ('semantic'), ('lossless')) m(mode)
""")
def docx_modes(spark, sf_dir):
    """Tracked changes of runs and of paragraphs, and white space, by mode."""
    inserted = lambda author, text, more="": _x('<w:ins w:author="', author, f'"{more}><w:r><w:t>{text}</w:t></w:r></w:ins>')
    deleted = lambda author, text: f'<w:del w:author="{author}"><w:r><w:delText>{text}</w:delText></w:r></w:del>'
    run = _x("<w:r><w:t>k</w:t>", inserted(F.col("s_name"), "new", ' w:date="2024"'), deleted("B", "old"), "</w:r>")
    body = _x(_p(run, inserted("C", "late"), deleted("D", "gone")), _p("<w:r><w:t> two  spaces </w:t></w:r>"))
    made = _packages(read(spark, sf_dir, "supplier"), "s_suppkey", body)
    found = packages.rendered(made).unionByName(packages.rendered(made, "lossless"))
    line = lambda n: F.element_at(F.regexp_extract_all("words_xml", F.lit("<p>(.*?)</p>"), F.lit(1)), n)
    return found.select("doc_id", "mode", line(1).alias("run"), line(2).alias("second"))


@query("""
SELECT page_id AS doc_id, CASE page_id % 4 WHEN 0 THEN '<a href="' || u || '">go</a>' WHEN 1 THEN '<a href="word/p' || page_id || '.htm"><b>go</b></a>'
  WHEN 2 THEN '<a href="#m' || page_id || '"><s><u>go</u></s></a>' ELSE '<a href="' || u || '#x">go</a>after' END AS run
FROM (SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS u FROM pages)
""")
def docx_links(spark, sf_dir):
    """Links by relationship, by anchor and by field."""
    k = F.col("page_id")
    url = F.replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    go = lambda props="": f"<w:r><w:rPr>{props}</w:rPr><w:t>go</w:t></w:r>"
    field = _x('<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> HYPERLINK "', url, '" \\l "x" </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>', go(), '<w:r><w:fldChar w:fldCharType="end"/></w:r><w:r><w:t>after</w:t></w:r>')
    body = (
        F.when(k % 4 == 0, _x('<w:hyperlink r:id="web">', go(), "</w:hyperlink>")).when(k % 4 == 1, _x('<w:hyperlink r:id="file">', go("<w:b/>"), "</w:hyperlink>"))
        .when(k % 4 == 2, _x('<w:hyperlink r:id="none" w:anchor="m', k, '">', go('<w:u w:val="single"/><w:strike/>'), "</w:hyperlink>")).otherwise(field)
    )
    rels = _x('<Relationships xmlns="urn:r"><Relationship Id="web" Target="', url, '"/><Relationship Id="file" Target="p', k, '.htm"/></Relationships>')
    made = _packages(read(spark, sf_dir, "pages"), "page_id", _p(body), word____rels___document__xml__rels=rels)
    return packages.rendered(made).select("doc_id", F.regexp_extract("words_xml", "<p>(.*)</p>", 1).alias("run"))


@query("""
SELECT s_suppkey AS doc_id, CAST(n AS INT) AS block_seq, text, dir FROM supplier, (VALUES
  (0, 'box', ''), (1, 'sdt', ''), (2, 'deep', ''), (3, 'anchor', ''), (4, 'ab', 'rtl')) v(n, text, dir)
UNION ALL SELECT s_suppkey, 5, s_name, '' FROM supplier
""")
def docx_flatten(spark, sf_dir):
    """Text boxes, content controls, also within each other, and directed spans come out flat and in order."""
    box = lambda text: f"<w:drawing><w:txbxContent><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:txbxContent></w:drawing>"
    sdt = lambda inner: f"<w:sdt><w:sdtContent>{inner}</w:sdtContent></w:sdt>"
    word = lambda text: f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"
    body = _x(
        word("box"), sdt(word("sdt") + sdt(word("deep"))), f"<w:p><w:r><w:t>anchor</w:t></w:r></w:p>", '<w:p><w:dir w:val="rtl"><w:r><w:t>a</w:t></w:r></w:dir><w:bdo w:val="rtl"><w:r><w:t>b</w:t></w:r></w:bdo></w:p>',
        "<w:p><w:r>", box("NAME"), "</w:r></w:p>",
    )
    body = F.replace(body, F.lit("NAME"), F.col("s_name"))
    held = packages.parsed(_packages(read(spark, sf_dir, "supplier"), "s_suppkey", body), ("blocks", "runs"))
    directed = packages.table(held, "runs").where("rtl").groupBy("doc_id", "block_seq").agg(F.lit("rtl").alias("dir"))
    blocks = packages.table(held, "blocks").where("text <> ''").select("doc_id", "block_seq", "text")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_seq")) - 1
    joined = blocks.join(directed, ["doc_id", "block_seq"], "left")
    return joined.select("doc_id", seq.alias("block_seq"), "text", F.coalesce("dir", F.lit("")).alias("dir"))


# --- paragraphs -------------------------------------------------------------------------


@query("""
WITH s AS (SELECT p_partkey AS k, p_size AS z, p_brand AS brand FROM part)
SELECT k AS doc_id, '    <p' ||
  CASE k % 4 WHEN 0 THEN ' align="center"' WHEN 1 THEN ' align="right"' WHEN 2 THEN ' align="start"' ELSE '' END ||
  ' indentLeft="' || printf('%.6f', (z * 20) / 1440.0::DOUBLE) || '"' || CASE WHEN k % 2 = 0 THEN ' indentHanging="' || printf('%.6f', 360 / 1440.0::DOUBLE) || '"' ELSE '' END ||
  CASE WHEN k % 2 = 1 THEN ' indentFirst="' || printf('%.6f', 300 / 1440.0::DOUBLE) || '"' ELSE '' END ||
  CASE k % 3 WHEN 0 THEN ' tabs="' || printf('%.6f', z / 1440.0::DOUBLE) || ' ' || printf('%.6f', (z + 100) / 1440.0::DOUBLE) || '@right:dot"' WHEN 1 THEN ' tabs="' || printf('%.6f', 200 / 1440.0::DOUBLE) || '@center"' ELSE '' END ||
  ' spacingBefore="' || printf('%.6f', z / 1440.0::DOUBLE) || '"' ||
  CASE WHEN k % 2 = 0 THEN ' lineSpacing="' || printf('%.6f', 360 / 240.0::DOUBLE) || '"' ELSE ' lineSpacing="' || printf('%.6f', 360 / 1440.0::DOUBLE) || '" lineRule="exact"' END ||
  CASE WHEN k % 5 = 0 THEN ' dir="rtl"' ELSE '' END || CASE WHEN k % 7 = 0 THEN ' lang="fr"' ELSE '' END || CASE WHEN k % 5 = 1 THEN ' valign="top"' ELSE '' END || CASE WHEN k % 5 = 2 THEN ' shd="EEEEEE"' ELSE '' END ||
  CASE WHEN k & 1 > 0 THEN ' keepNext="true"' ELSE '' END || CASE WHEN k & 2 > 0 THEN ' keepLines="true"' ELSE '' END || CASE WHEN k & 4 > 0 THEN ' widowControl="true"' ELSE '' END ||
  CASE k % 6 WHEN 0 THEN ' sectionBreak="nextPage"' WHEN 1 THEN ' sectionBreak="continuous"' ELSE '' END ||
  CASE WHEN k % 6 = 2 THEN ' revisionAuthor="A &amp; B" revisionDate="2024-01-02"' ELSE '' END ||
  CASE WHEN k & 8 > 0 THEN ' suppressAutoHyph="true" snapToGrid="true" kinsoku="true" wordWrap="true" overflowPunct="true" topLinePunct="true" autoSpaceDE="true" autoSpaceDN="true"' ELSE '' END ||
  CASE WHEN k % 6 = 3 THEN ' textDirection="lr"' ELSE '' END || CASE WHEN k & 8 > 0 THEN ' suppressOverlap="true"' ELSE '' END || CASE WHEN k % 6 = 4 THEN ' divID="' || (z + 1) || '" cnfStyle="0101"' ELSE '' END ||
  CASE WHEN k % 6 = 5 THEN ' frame="dropCap=''drop'' lines=''3'' width=''' || printf('%.6f', (z * 10) / 1440.0::DOUBLE) || ''' wrap=''around'' xAlign=''left''"' ELSE '' END ||
  CASE WHEN k % 3 = 2 THEN ' at="bt ' || printf('%.6f', z / 576.0::DOUBLE) || ' d1 #FF0000; bl ' || printf('%.6f', 8 / 576.0::DOUBLE) || ' s0 #auto"' ELSE '' END ||
  '>' || brand || '</p>' || chr(10) AS body FROM s
""")
def docx_paragraph_attributes(spark, sf_dir):
    """Every attribute of a paragraph, in the order of the contract."""
    k, z = F.col("p_partkey"), F.col("p_size")
    bit = lambda tag, n: _if(F.expr(f"p_partkey & {n} > 0"), f"<w:{tag}/>")
    props = _x(
        _if(k % 4 < 3, '<w:jc w:val="', F.when(k % 4 == 0, "center").when(k % 4 == 1, "right").otherwise("start"), '"/>'), _if(k % 4 == 3, '<w:jc w:val="left"/>'),
        '<w:ind w:left="', z * 20, '"', F.when(k % 2 == 0, ' w:hanging="360"').otherwise(' w:firstLine="300"'), "/>",
        _if(k % 3 == 0, '<w:tabs><w:tab w:pos="', z + 100, '" w:val="right" w:leader="dot"/><w:tab w:pos="', z, '"/><w:tab w:val="clear" w:pos="7777"/></w:tabs>'), _if(k % 3 == 1, '<w:tabs><w:tab w:pos="200" w:val="center"/></w:tabs>'),
        '<w:spacing w:before="', z, '" w:line="360" w:lineRule="', F.when(k % 2 == 0, "auto").otherwise("exact"), '"/>',
        _if(k % 5 == 0, "<w:bidi/>"), _if(k % 7 == 0, '<w:lang w:val="fr"/>'), _if(k % 5 == 1, '<w:textAlignment w:val="top"/>'), _if(k % 5 == 2, '<w:shd w:val="clear" w:fill="EEEEEE"/>'),
        bit("keepNext", 1), bit("keepLines", 2), bit("widowControl", 4), _if(k % 6 == 0, "<w:sectPr/>"), _if(k % 6 == 1, '<w:sectPr><w:type w:val="continuous"/></w:sectPr>'),
        _if(k % 6 == 2, '<w:pPrChange w:author="A &amp; B" w:date="2024-01-02"/>'),
        *[bit(tag, 8) for tag in ("suppressAutoHyphens", "snapToGrid", "kinsoku", "wordWrap", "overflowPunct", "topLinePunct", "autoSpaceDE", "autoSpaceDN", "suppressOverlap")],
        _if(k % 6 == 3, '<w:textDirection w:val="lr"/>'), _if(k % 6 == 4, '<w:divId w:val="', z + 1, '"/><w:cnfStyle w:val="0101"/>'),
        _if(k % 6 == 5, '<w:framePr w:dropCap="drop" w:lines="3" w:w="', z * 10, '" w:wrap="around" w:xAlign="left"/>'),
        _if(k % 3 == 2, '<w:pBdr><w:top w:val="double" w:sz="', z, '" w:space="1" w:color="FF0000"/><w:left w:val="single" w:sz="8" w:space="0" w:color="auto"/><w:bottom w:val="none"/></w:pBdr>'),
    )
    return _inside(packages.rendered(_packages(read(spark, sf_dir, "part"), "p_partkey", _p(_text(F.col("p_brand")), props=props))), "write", "body")


@query("""
SELECT p_partkey AS doc_id, CAST(seq AS INT) AS block_seq, round(ind_left, 9) AS ind_left, round(sp_before, 9) AS sp_before, stops FROM part, LATERAL (
  SELECT 0 AS seq, 0.5::DOUBLE AS ind_left, p_size / 1440.0::DOUBLE AS sp_before, '0.25 left none 1.0 right dot' AS stops UNION ALL
  SELECT 1, 0.0::DOUBLE, p_size / 1440.0::DOUBLE, '0.25 left none 1.0 right dot' UNION ALL
  SELECT 2, 0.5::DOUBLE, 0.1::DOUBLE, CASE WHEN p_partkey % 2 = 0 THEN '0.25 left none 2.0 left none' ELSE '0.25 center none 1.0 right dot 2.0 left none' END)
""")
def docx_style_inheritance(spark, sf_dir):
    """Indent, spacing and tab stops along a chain of styles that ends in a cycle: own ones replace
    as a whole, stops by position, and a cleared one is gone."""
    k, z = F.col("p_partkey"), F.col("p_size")
    styles = _styles(
        _style("Leaf", "Leaf", "", "Middle"), _x('<w:style w:type="paragraph" w:styleId="Middle"><w:name w:val="Middle"/><w:basedOn w:val="Top"/><w:pPr><w:spacing w:before="', z, '"/></w:pPr></w:style>'),
        _style("Top", "Top", '<w:pPr><w:ind w:left="720"/><w:tabs><w:tab w:pos="360"/><w:tab w:pos="1440" w:val="right" w:leader="dot"/></w:tabs></w:pPr>', "Leaf"),
    )
    leaf = '<w:pStyle w:val="Leaf"/>'
    own = F.when(k % 2 == 0, '<w:tab w:pos="1440" w:val="clear"/>').otherwise('<w:tab w:pos="360" w:val="center"/>')
    body = _x(_p(_text("a"), props=leaf), _p(_text("b"), props=leaf + '<w:ind w:right="20"/>'), _p(_text("c"), props=_x(leaf, '<w:spacing w:before="144"/><w:tabs><w:tab w:pos="2880"/>', own, "</w:tabs>")))
    blocks = packages.blocks(_packages(read(spark, sf_dir, "part"), "p_partkey", body, word___styles__xml=styles))
    stops = F.array_join(F.transform("tabs", lambda t: F.concat_ws(" ", t["pos"].cast("string"), t["align"], t["leader"])), " ")
    return blocks.select("doc_id", "block_seq", F.round("ind_left", 9).alias("ind_left"), F.round("sp_before", 9).alias("sp_before"), stops.alias("stops"))


@query("""
SELECT p_partkey AS doc_id, CAST(n AS INT) AS block_seq, CAST(h AS INT) AS heading_level FROM part, LATERAL (
  SELECT 0 AS n, p_partkey % 9 + 1 AS h UNION ALL SELECT 1, 1 UNION ALL SELECT 2, 2 UNION ALL SELECT 3, 3 UNION ALL SELECT 4, CASE WHEN p_size <= 9 THEN p_size ELSE 0 END UNION ALL
  SELECT 5, 0 UNION ALL SELECT 6, CASE WHEN 10 + 3 * p_size > 60 THEN 0 ELSE 4 END UNION ALL SELECT 7, 5)
""")
def docx_heading_levels(spark, sf_dir):
    """Heading levels from style ids, ancestors and outline levels, and their demotion by bytes."""
    k, z = F.col("p_partkey"), F.col("p_size")
    styles = _styles(_style("Child", "Child", "", "Heading3"), _style("Heading3", "heading 3"), _style("Lined", "Lined", '<w:pPr><w:outlineLvl w:val="4"/></w:pPr>'))
    styled = lambda style, more="": _x('<w:pStyle w:val="', style, '"/>', more)
    body = _x(
        _p(_text("a"), props=styled(_x("HEADING", k % 9 + 1))), _p(_text("a"), props=styled("Title")), _p(_text("a"), props=styled("subtitle")), _p(_text("a"), props=styled("Child")),
        _p(_text("a"), props=_x('<w:outlineLvl w:val="', z - 1, '"/>')), _p(_text("a"), props=styled("Heading2", '<w:jc w:val="both"/>')),
        _p(_text("0123456789"), _text(F.expr("repeat('€', p_size)")), props=styled("Heading4")), _p(_text("a"), props=styled("Lined")),
    )
    made = _packages(read(spark, sf_dir, "part"), "p_partkey", body, word___styles__xml=styles)
    return packages.blocks(made, columns=("block_seq", "heading_level")).select("doc_id", "block_seq", "heading_level")


@query("""
SELECT s_suppkey AS doc_id, CAST(n AS INT) AS block_seq, code, quote FROM supplier, (VALUES
  (0, true, false), (1, true, false), (2, true, false), (3, false, false), (4, false, false), (5, true, false), (6, false, true), (7, false, true), (8, false, false), (9, false, false)) v(n, code, quote)
""")
def docx_code_and_quotes(spark, sf_dir):
    """Code by known name, known id, or a code word and monospaced runs; quotes by name or ancestor."""
    mono, text = '<w:rFonts w:ascii="DejaVu Sans Mono"/>', F.col("s_name")
    styles = _styles(_style("C1", "Source Code"), _style("W1", "my source"), _style("W2", "barcode"), _style("Q1", "Quote"), _style("Q2", "Other", "", "Q1"), _style("Q3", "Intense Quote"))
    rows = [("C1", ""), ("PlainText", ""), ("W1", mono), ("W1", ""), ("W2", mono), ("x-output", mono), ("Q1", ""), ("Q2", ""), ("Q3", ""), ("Normal", mono)]
    body = _x(*[_p(_text(text, props=props), props=f'<w:pStyle w:val="{style}"/>') for style, props in rows])
    blocks = packages.blocks(_packages(read(spark, sf_dir, "supplier"), "s_suppkey", body, word___styles__xml=styles))
    return blocks.select("doc_id", "block_seq", F.col("is_code").alias("code"), F.col("is_quote").alias("quote"))


# --- lists ------------------------------------------------------------------------------


@query("""
SELECT s_suppkey AS doc_id, array_to_string([
  '    <ol type="decimal"' || CASE WHEN st > 1 THEN ' start="' || st || '"' ELSE '' END || ' format="%1.">',
  '      <li marker="' || st || '.">', '        <p indentLeft="0.500000" indentHanging="0.250000">' || s_name || '</p>', '        <p>more</p>',
  '<ul type="o">', '          <li marker="o">', '            <p indentLeft="1.000000" indentHanging="0.250000">inner</p>', '          </li>', '</ul>      </li>',
  '      <li marker="' || st + 1 || '.">', '        <p indentLeft="0.750000" indentHanging="0.500000">own</p>', '      </li>', '    </ol>',
  '    <h2>Head</h2>', '    <ol type="decimal" start="' || st + 2 || '" format="%1.">', '      <li marker="' || st + 2 || '.">', '        <p indentLeft="0.500000" indentHanging="0.250000">last</p>', '      </li>', '    </ol>',
  '    <p>--------</p>', ''], chr(10)) AS body
FROM (SELECT s_suppkey, s_name, s_suppkey % 4 + 1 AS st FROM supplier)
""")
def docx_nested_lists(spark, sf_dir):
    """Lists nest, absorb paragraphs, count on behind headings, and end at rules; markers' geometry."""
    start = F.col("s_suppkey") % 4 + 1
    item = lambda text, level=0, more="": _p(_text(text), props=f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="3"/></w:numPr>{more}')
    body = _x(
        item(F.col("s_name")), _p(_text("more")), item("inner", 1), item("own", 0, '<w:ind w:left="1080"/>'), _p(_text("Head"), props='<w:pStyle w:val="Heading2"/>'), item("last"), _p(_text("--------")),
    )
    ind = lambda left: f'<w:pPr><w:ind w:left="{left}" w:hanging="360"/></w:pPr>'
    numbering = _x(
        f'<w:numbering {NS}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="', start, '"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/>', ind(720), '</w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/><w:lvlText w:val="o"/>', ind(1440),
        '</w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
    )
    return _inside(packages.rendered(_packages(read(spark, sf_dir, "supplier"), "s_suppkey", body, word___numbering__xml=numbering)), "write", "body")


@query("""
SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS item,
  CASE WHEN role = 'user' THEN a || '.' ELSE greatest(a, 1) || '.' || printf('%02d', b) || ')' END AS marker
FROM (SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER w AS a, count(*) FILTER (role <> 'user') OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
""")
def docx_level_markers(spark, sf_dir):
    """Markers over two levels: the outer level's running number in the inner one's template."""
    c = read(spark, sf_dir, "conversations")
    props = F.when(F.col("role") == "user", '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>').otherwise('<w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr>')
    listed = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", _p(_text("x"), props=props).alias("p")))).alias("items"))
    level = lambda k, fmt, text: f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text}"/></w:lvl>'
    numbering = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="0">{level(0, "decimal", "%1.")}{level(1, "decimalZero", "%1.%2)")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    out = packages.rendered(_packages(listed, "conv_id", F.array_join(F.col("items.p"), ""), word___numbering__xml=numbering))
    return out.select("doc_id", F.posexplode(F.regexp_extract_all("words_xml", F.lit('<li marker="([^"]*)">'), F.lit(1))).alias("item", "marker"))


@query("""
SELECT s_suppkey AS doc_id, CAST(l AS INT) AS ilvl, CASE l WHEN 0 THEN 'upperRoman' WHEN 1 THEN 'bullet' END AS num_fmt, CAST(CASE l WHEN 0 THEN s_suppkey % 7 + 2 ELSE 0 END AS INT) AS start_val,
  l = 0 AS has_override, CASE l WHEN 1 THEN 0.25 ELSE 0.0 END::DOUBLE AS ind_left, 9 AS abstract_id FROM supplier, (VALUES (0), (1)) v(l)
""")
def docx_numbering(spark, sf_dir):
    """List levels by number, through their abstract definition, with an overridden start."""
    numbering = _x(
        f'<w:numbering {NS}><w:abstractNum w:abstractNumId="9"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="upperRoman"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/><w:pPr><w:ind w:left="360"/></w:pPr></w:lvl></w:abstractNum>',
        '<w:num w:numId="5"><w:abstractNumId w:val="9"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="', F.col("s_suppkey") % 7 + 2, '"/></w:lvlOverride></w:num></w:numbering>',
    )
    levels = packages.levels(_packages(read(spark, sf_dir, "supplier"), "s_suppkey", F.lit("<w:p/>"), word___numbering__xml=numbering))
    return levels.select("doc_id", "ilvl", "num_fmt", "start_val", "has_override", "ind_left", "abstract_id")


# --- tables -----------------------------------------------------------------------------


@query("""
SELECT s_suppkey AS doc_id, array_to_string([
  '    <table id="1" c="Grid &amp; Co" width="' || printf('%.6f', (1000 + s_suppkey) / 1440.0::DOUBLE) || '" align="center" indent="0.050000" cellSpacing="0.100000" caption="' || s_name || '" summary="S" at="bt ' || printf('%.6f', 4 / 576.0::DOUBLE) || ' s0 #000000">',
  '      <tr>', '        <th colspan="2">head</th>', '        <th valign="center" textDir="btLr" noWrap="true" at="bb ' || printf('%.6f', 8 / 576.0::DOUBLE) || ' ds1 #FF0000">x</th>', '      </tr>',
  '      <tr>', '        <td rowspan="2" lang="de"><span lang="de">a</span>b</td>', '        <td><ul type="bullet"><li><p indentLeft="0.100000">item</p></li></ul></td>', '        <td>        <table id="2">',
  '          <tr>', '            <td>in</td>', '          </tr>', '        </table>', 'out</td>', '      </tr>', '      <tr>', '        <td rowspan="2"></td>', '        <td>end</td>', '      </tr>', '    </table>', ''], chr(10)) AS body,
  '    <s:col ref="1" w="0.500000"/>' || chr(10) || '    <s:col ref="1" w="1.000000"/>' || chr(10) AS cols
FROM supplier
""")
def docx_table_render(spark, sf_dir):
    """A table with all its attributes, spans and merges, lists and a table in its cells."""
    cell = lambda inner, props="": _x("<w:tc><w:tcPr>", props, "</w:tcPr>", inner, "</w:tc>")
    row = lambda *cells, props="": _x("<w:tr><w:trPr>", props, "</w:trPr>", *cells, "</w:tr>")
    item = _p(_text("item"), props='<w:numPr><w:numId w:val="1"/></w:numPr><w:ind w:left="144"/>')
    inner = _x("<w:tbl>", row(cell(_p(_text("in")))), "</w:tbl>", _p(_text("out")))
    about = _x(
        '<w:tblPr><w:tblStyle w:val="G"/><w:tblW w:w="', 1000 + F.col("s_suppkey"), '"/><w:jc w:val="center"/><w:tblInd w:w="72"/><w:tblCellSpacing w:w="144"/>',
        '<w:tblCaption w:val="', F.col("s_name"), '"/><w:tblDescription w:val="S"/><w:tblBorders><w:top w:val="single" w:sz="4" w:space="0" w:color="000000"/></w:tblBorders></w:tblPr>',
    )
    body = _x(
        "<w:tbl>", about, '<w:tblGrid><w:gridCol w:w="720"/><w:gridCol w:w="1440"/></w:tblGrid>',
        row(cell(_p(_text("head")), '<w:gridSpan w:val="2"/>'), cell(_p(_text("x")), '<w:vAlign w:val="center"/><w:textDirection w:val="btLr"/><w:noWrap/><w:tcBorders><w:bottom w:val="dashed" w:sz="8" w:space="1" w:color="FF0000"/></w:tcBorders>'), props="<w:tblHeader/>"),
        row(cell(_x(_p(_text("a", props='<w:lang w:val="de"/>')), _p(_text("b"))), '<w:vMerge w:val="restart"/>'), cell(item), cell(inner)),
        row(cell(_p(_text("gone")), "<w:vMerge/>"), cell("<w:p/>", "<w:vMerge/>"), cell(_p(_text("end")))), "</w:tbl>",
    )
    out = packages.rendered(_packages(read(spark, sf_dir, "supplier"), "s_suppkey", body, word___styles__xml=_styles(_style("G", "Grid &amp; Co", kind="table"))))
    body = F.regexp_extract("words_xml", r"(?s)<write>\n(.*)  </write>", 1)
    return out.select("doc_id", body.alias("body"), F.array_join(F.regexp_extract_all("words_xml", F.lit(r"    <s:col[^>]*/>\n"), F.lit(0)), "").alias("cols"))


@query("""
SELECT c_custkey AS doc_id, CAST(id AS INT) AS table_id, round(w, 9) AS width, caption, CAST(n AS INT) AS n_rows FROM customer, LATERAL (
  SELECT 1 AS id, c_custkey % 500 / 1440.0::DOUBLE AS w, 'outer' AS caption, 1 AS n UNION ALL SELECT 2, 0.0::DOUBLE, 'inner', 2 UNION ALL SELECT 3, 0.0::DOUBLE, 'next', 0 UNION ALL SELECT 4, 0.0::DOUBLE, 'header', 0)
""")
def docx_tables(spark, sf_dir):
    """Tables of body, cells and stories, numbered in pre-order."""
    about = lambda caption, width="": _x('<w:tblPr><w:tblCaption w:val="', caption, '"/>', width, "</w:tblPr>")
    inner = _x("<w:tbl>", about("inner"), "<w:tr/><w:tr/></w:tbl>")
    width = _x('<w:tblW w:w="', F.col("c_custkey") % 500, '"/>')
    body = _x("<w:tbl>", about("outer", width), "<w:tr><w:tc>", inner, "</w:tc></w:tr></w:tbl><w:tbl>", about("next"), "</w:tbl>")
    header = _x(f"<w:hdr {NS}><w:tbl>", about("header"), "</w:tbl></w:hdr>")
    tables = packages.table(packages.parsed(_packages(read(spark, sf_dir, "customer"), "c_custkey", body, word___header1__xml=header), ("tables",)), "tables")
    return tables.select("doc_id", "table_id", F.round("width", 9).alias("width"), "caption", "n_rows")


# --- stories, notes and parts -------------------------------------------------------------


@query("""
SELECT s_suppkey AS doc_id, array_to_string(['  <header id="1">', '    <p>ten</p>', '  </header>', '  <header id="2">', '    <p>' || s_name || '</p>', '    <ul type="bullet">', '      <li>', '        <p>item</p>', '      </li>', '    </ul>', '  </header>',
  '  <footer id="1">', '    <h1>foot</h1>', '  </footer>', ''], chr(10)) AS stories FROM supplier
""")
def docx_stories(spark, sf_dir):
    """Headers and footers by the order of their part names, each list item a list of its own."""
    story = lambda root, *inner: _x(f"<w:{root} {NS}>", *inner, f"</w:{root}>")
    two = story("hdr", _p(_text(F.col("s_name"))), _p(_text("item"), props='<w:numPr><w:numId w:val="1"/></w:numPr>'))
    foot = story("ftr", _p(_text("foot"), props='<w:pStyle w:val="Heading1"/>'))
    made = _packages(read(spark, sf_dir, "supplier"), "s_suppkey", F.lit("<w:p/>"), word___header2__xml=two, word___header10__xml=story("hdr", _p(_text("ten"))), word___footer1__xml=foot)
    return packages.rendered(made).select("doc_id", F.regexp_extract("words_xml", r"(?s)  </style>\n(.*)  <write>", 1).alias("stories"))


@query("""
SELECT s_suppkey AS doc_id, array_to_string(['    <bm id="B' || s_suppkey || '"/>', '    <fn id="2" type="footnote">', '    <p>two</p>', '', '    </fn>', '    <comment id="0" author="' || s_name || '" date="2024">    <p>hm</p>', '</comment>',
  '    <fn id="1" type="footnote">', '    <p>one</p>', '', '    </fn>', '    <fn id="5" type="endnote"/>', '    <bm id="End"/>', ''], chr(10)) AS notes FROM supplier
""")
def docx_notes_render(spark, sf_dir):
    """Bookmarks, footnotes, endnotes and comments in document order; separators are no notes."""
    ref = lambda kind, i: f'<w:r><w:{kind}Reference w:id="{i}"/></w:r>'
    mark = lambda i, name: _x(f'<w:bookmarkStart w:id="{i}" w:name="', name, '"/>')
    body = _x(
        mark(3, _x("B", F.col("s_suppkey"))), _p(_text("a"), ref("footnote", 2)), _p(ref("comment", 0)), _p(ref("footnote", 1), ref("footnote", 2)), _p(ref("endnote", 5)), mark(4, "End"),
    )
    notes = lambda root, tag, *inner: _x(f"<w:{root} {NS}>", *inner, f"</w:{root}>")
    foot = notes("footnotes", "footnote", '<w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="1">', _p(_text("one")), '</w:footnote><w:footnote w:id="2" w:type="normal">', _p(_text("two")), "</w:footnote>")
    end = notes("endnotes", "endnote", '<w:endnote w:id="5"/>')
    comments = notes("comments", "comment", '<w:comment w:id="0" w:author="', F.col("s_name"), '" w:date="2024">', _p(_text("hm")), "</w:comment>")
    made = _packages(read(spark, sf_dir, "supplier"), "s_suppkey", body, word___footnotes__xml=foot, word___endnotes__xml=end, word___comments__xml=comments)
    return _inside(packages.rendered(made), "notes", "notes")


@query("""
SELECT o_orderkey AS doc_id, '    <s:page' || CASE o_orderkey % 4 WHEN 0 THEN ' size="Letter"' WHEN 1 THEN ' size="Legal"' WHEN 2 THEN ' w="' || printf('%.6f', 11906 / 1440.0::DOUBLE) || '" h="' || printf('%.6f', 16838 / 1440.0::DOUBLE) || '"'
  ELSE ' w="' || printf('%.6f', (1000 + o_orderkey % 1000) / 1440.0::DOUBLE) || '" h="0.694444"' END || ' mt="1.000000" mb="0.500000" ml="' || printf('%.6f', (o_orderkey % 100) / 1440.0::DOUBLE) || '" mr="0.000000" mh="0.000000" mf="0.000000"/>' || chr(10) ||
  CASE WHEN o_orderkey % 3 > 1 THEN '    <s:cols n="2" space="0.500000"/>' || chr(10) ELSE '' END AS page FROM orders
""")
def docx_sections(spark, sf_dir):
    """Page sizes by preset, turned ones too, or by measure; margins and columns."""
    k = F.col("o_orderkey")
    size = F.when(k % 4 == 0, 'w:w="15840" w:h="12240"').when(k % 4 == 1, 'w:w="12240" w:h="20160"').when(k % 4 == 2, 'w:w="11906" w:h="16838"').otherwise(_x('w:w="', 1000 + k % 1000, '" w:h="1000"'))
    section = _x("<w:sectPr><w:pgSz ", size, '/><w:pgMar w:top="1440" w:bottom="720" w:left="', k % 100, '"/><w:cols w:num="', k % 3, '" w:space="720"/></w:sectPr>')
    return _inside(packages.rendered(_packages(read(spark, sf_dir, "orders"), "o_orderkey", section)), "style", "page")


@query("""
SELECT o_orderkey AS doc_id, 0 AS section_seq, round((1000 + o_orderkey % 1000) / 1440.0::DOUBLE, 9) AS w_in, CAST(CASE WHEN o_orderkey % 4 > 1 THEN o_orderkey % 4 ELSE 0 END AS INT) AS cols,
  CASE WHEN o_orderkey % 4 > 1 THEN 0.25 ELSE 0.0 END::DOUBLE AS cols_space FROM orders
""")
def docx_section_table(spark, sf_dir):
    k = F.col("o_orderkey")
    section = _x('<w:sectPr><w:pgSz w:w="', 1000 + k % 1000, '" w:h="9"/><w:cols w:num="', k % 4, '" w:space="360"/></w:sectPr>')
    held = packages.parsed(_packages(read(spark, sf_dir, "orders"), "o_orderkey", section), ("sections",))
    return packages.table(held, "sections").select("doc_id", "section_seq", F.round("w_in", 9).alias("w_in"), "cols", "cols_space")


@query("""
SELECT doc_id, '    <title>T &amp; ' || doc_id || '</title>' || chr(10) || '    <author>' || source || '</author>' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '    <created>2024-01-01</created>' || chr(10) ELSE '' END || '    <keywords>' || coalesce(lang, '') || ';k</keywords>' || chr(10) AS meta FROM documents
""")
def meta_block(spark, sf_dir):
    """Properties of a package, and which of them are written."""
    k = F.col("doc_id")
    core = _x(
        '<c:coreProperties xmlns:c="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:d="http://purl.org/dc/elements/1.1/" xmlns:t="http://purl.org/dc/terms/"><d:title>T &amp; ', k,
        "</d:title><d:creator>", F.col("source"), "</d:creator><d:subject>never</d:subject>", _if(k % 2 == 0, "<t:created>2024-01-01</t:created>"), "<c:keywords>", F.coalesce("lang", F.lit("")), ";k</c:keywords></c:coreProperties>",
    )
    return _inside(packages.rendered(_packages(read(spark, sf_dir, "documents"), "doc_id", F.lit("<w:p/>"), docProps___core__xml=core)), "meta", "meta")


@query("""
SELECT s_suppkey AS doc_id, 'F' || s_suppkey AS font, 'M' AS font_ea, '112233' AS fg, '' AS bg, 'F' || s_suppkey || ',H' AS latin, '    <s:theme font="F' || s_suppkey || '" fontEA="M" fg="112233"/>' || chr(10) AS line,
  'H' AS family, 12.5::DOUBLE AS size_pt, 'word/x' AS target FROM supplier
""")
def docx_theme(spark, sf_dir):
    """The theme, the document's defaults that take a font from it, and relationships."""
    face = lambda group, latin, ea="": _x(f"<a:{group}Font><a:latin typeface=\"", latin, '"/>', ea, f"</a:{group}Font>")
    theme = _x(
        f'<a:theme xmlns:a="{A}"><a:themeElements><a:clrScheme><a:dk1><a:srgbClr val="112233"/></a:dk1><a:lt1><a:sysClr val="window"/></a:lt1></a:clrScheme><a:fontScheme>',
        face("major", "H"), face("minor", _x("F", F.col("s_suppkey")), '<a:ea typeface="M"/>'), "</a:fontScheme></a:themeElements></a:theme>",
    )
    defaults = '<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:asciiTheme="majorHAnsi"/><w:sz w:val="25"/></w:rPr></w:rPrDefault></w:docDefaults>'
    rels = '<Relationships xmlns="urn:r"><Relationship Id="r" Target="x"/></Relationships>'
    made = _packages(read(spark, sf_dir, "supplier"), "s_suppkey", F.lit("<w:p/>"), word___theme___theme1__xml=theme, word___styles__xml=_styles(defaults=defaults), word____rels___document__xml__rels=rels)
    held = packages.parsed(made, ("theme", "defaults", "rels"))
    themes = packages.table(held, "theme").withColumn("latin", F.concat_ws(",", F.col("font_map")["minorAscii"], F.col("font_map")["majorHAnsi"])).drop("font_cs", "font_map")
    lines = packages.rendered(made).select("doc_id", F.regexp_extract("words_xml", r"    <s:theme[^>]*/>\n", 0).alias("line"))
    both = themes.join(packages.table(held, "defaults").select("doc_id", "family", "size_pt"), "doc_id").join(packages.table(held, "rels").select("doc_id", "target"), "doc_id")
    return both.join(lines, "doc_id")


@query("""
SELECT s_suppkey AS doc_id, array_to_string(['    <s:gap el="h" c="Heading2" before="0.100000"/>', '    <s:gap el="p" before="0.050000" after="' || printf('%.6f', (s_suppkey % 50 + 1) / 1440.0::DOUBLE) || '"/>',
  '    <s:align el="p" value="both"/>', '    <s:line el="p" value="1.500000" rule="auto"/>', '    <s:indent el="p" c="Heading2" left="0.500000"/>', '    <s:tab el="p" pos="0.250000" align="left" leader="none"/>',
  '    <s:custom name="A ' || s_name || '" type="paragraph" basedOn="Normal" font="Arial" size="10.5pt" color="FF0000" bold="true" italic="true" underline="single" strikethrough="true" smallCaps="true" uppercase="true" alignment="center" spacingBefore="0.100000" lineSpacing="0.250000" lineRule="exact" indentLeft="0.050000" indentHanging="0.025000"/>',
  '    <s:custom name="TableX" type="table" borderWidth="' || printf('%.6f', 4 / 576.0::DOUBLE) || '" borderColor="00FF00" borderStyle="single" width="1.000000"/>', '    <s:align el="p" value="right"/>', ''], chr(10)) AS style FROM supplier
""")
def docx_style_block(spark, sf_dir):
    """The style block: gaps, indents, alignments, lines, stops, custom styles in order of their ids, and no built-in ones."""
    custom = _x(
        '<w:style w:type="paragraph" w:styleId="Ax"><w:name w:val="A ', F.col("s_name"), '"/><w:basedOn w:val="Normal"/><w:rPr><w:rFonts w:ascii="Arial"/><w:sz w:val="21"/><w:color w:val="#FF0000"/><w:b/><w:i/><w:u w:val="single"/><w:strike/><w:smallCaps/><w:caps/></w:rPr>',
        '<w:pPr><w:jc w:val="center"/><w:spacing w:before="144" w:line="360" w:lineRule="exact"/><w:ind w:left="72" w:hanging="36"/><w:tabs><w:tab w:pos="360"/></w:tabs></w:pPr></w:style>',
    )
    normal = _x('<w:style w:type="paragraph" w:styleId="Normal"><w:name w:val="Normal"/><w:pPr><w:jc w:val="both"/><w:spacing w:before="72" w:after="', F.col("s_suppkey") % 50 + 1, '" w:line="360" w:lineRule="auto"/></w:pPr></w:style>')
    table = _style("Tx", "TableX", '<w:tblPr><w:tblW w:w="1440"/><w:tblBorders><w:top w:val="single" w:sz="4" w:color="#00FF00"/></w:tblBorders></w:tblPr>', kind="table")
    heading = _style("Heading2", "heading 2", '<w:pPr><w:spacing w:before="144"/><w:ind w:left="720"/></w:pPr>')
    body = _x(_p(_text("x"), props='<w:jc w:val="right"/>'), _p(_text("y"), props='<w:jc w:val="right"/>'), _p(_text("z"), props='<w:pStyle w:val="Normal"/><w:jc w:val="both"/>'))
    made = _packages(read(spark, sf_dir, "supplier"), "s_suppkey", body, word___styles__xml=_styles(table, heading, normal, custom, _style("Quote", "Quote"), _style("Caption", "caption")))
    return _inside(packages.rendered(made), "style", "style")


@query("""
SELECT s_suppkey AS doc_id, o.* FROM supplier, (VALUES (0, 'text', 'a', '', 0.0::DOUBLE), (1, 'link', 'go', '#m', 0.0::DOUBLE), (2, 'text', 'b', '', 0.0::DOUBLE), (3, 'img', '', 'word/media/i.png', 2.5::DOUBLE), (4, 'text', chr(8209), '', 0.0::DOUBLE)) o(seq, kind, text, target, width)
""")
def docx_true_order(spark, sf_dir):
    """Without compat: links in their place, DrawingML pictures with their size, a true non-breaking hyphen."""
    drawing = (
        '<w:r><w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><wp:extent cx="2286000" cy="914400"/><wp:docPr descr="d"/>'
        f'<a:graphic xmlns:a="{A}"><a:graphicData><pic:pic xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:blipFill><a:blip r:embed="i"/></pic:blipFill></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
    )
    rels = '<Relationships xmlns="urn:r"><Relationship Id="i" Target="media/i.png"/></Relationships>'
    body = _p(_text("a"), '<w:hyperlink w:anchor="m"><w:r><w:t>go</w:t></w:r></w:hyperlink>', _text("b"), drawing, "<w:r><w:noBreakHyphen/></w:r>")
    made = _packages(read(spark, sf_dir, "supplier"), "s_suppkey", body, word____rels___document__xml__rels=rels)
    return packages.runs(made, compat=False).select("doc_id", "seq", "kind", "text", "target", "width")


@query("""
SELECT s_suppkey AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN 'parse' END AS stage, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'heading 1' ELSE '' END AS style_name FROM supplier
""")
def docx_bad_numbers(spark, sf_dir):
    """A number that is none: in the main part the package is an error, in another that part is absent."""
    k = F.col("s_suppkey") % 3
    styles = _x(f"<w:styles {NS}>", _style("Heading1", "heading 1", '<w:rPr><w:sz w:val="SIZE"/></w:rPr>'), "</w:styles>")
    styles = F.replace(styles, F.lit("SIZE"), F.when(k == 1, "20").otherwise("10.5"))
    body = _p(_text("x"), props=_x('<w:pStyle w:val="Heading1"/>', _if(k == 0, '<w:ind w:left="wide"/>')))
    held = packages.parsed(_packages(read(spark, sf_dir, "supplier"), "s_suppkey", body, word___styles__xml=styles), ("blocks",))
    name = F.coalesce(F.try_element_at("blocks", F.lit(1))["style_name"], F.lit(""))
    return held.select("doc_id", F.when(F.col("error").isNotNull(), "parse").alias("stage"), name.alias("style_name"))


# --- the verifier -------------------------------------------------------------------------

#: A body, what it breaks, and whether that is an error; %s stands for the row's own name.
_FINDINGS = [
    ("<p align=\"left\">%s</p>", 'error', '<p> align must be center|both|right, got "left"'), ("<p indentLeft=\"x\">%s</p>", "error", '<p> indentLeft must be number, got "x"'),
    ("<p lineRule=\"%s\">x</p>", "error", '<p> lineRule must be auto|exact|atLeast, got "%s"'), ("<h2 valign=\"bottom\">x</h2>", "error", '<p> valign must not be bottom (only top|center|baseline), got "bottom"'),
    ("<p keepNext=\"yes\">x</p>", "error", '<p> keepNext must be true, got "yes"'), ("<p divID=\"1.5\">x</p>", "error", '<p> divID must be number, got "1.5"'),
    ("<p tabs=\"1.0 x@left\">x</p>", "error", '<p> tabs must be space-separated stops (pos or pos@align[:leader]), got "1.0 x@left"'), ("<p dir=up>x</p>", "error", '<p> dir must be ltr|rtl, got "up"'),
    ("<p sectionBreak=\"odd\">x</p>", "error", '<p> sectionBreak must be nextPage|continuous|evenPage|oddPage, got "odd"'), ("<p><span size=\"11\">x</span></p>", "error", '<span> size must be a number followed by pt (e.g., 11pt), got "11"'),
    ("<p><a>%s</a></p>", "error", "<a> missing required href attribute"), ("<p><a href=\"\">x</a></p>", "error", "<a> href must not be empty"), ("<p><img alt=\"\" src=\"%s\"/></p>", "error", "<img> must not have src attribute (only alt is allowed)"),
    ("<p><img/></p>", "error", "<img> missing required alt attribute"), ("<p><br/></p>", "error", "<br> missing required type attribute"), ("<p><br type=\"%s\"/></p>", "error", '<br> type must be page|textWrapping|column|clear, got "%s"'),
    ("<table id=\"%s\"><tr><td>x</td></tr></table>", "error", '<table> id must be integer, got "%s"'), ("<table align=\"both\"><tr><td>x</td></tr></table>", "error", '<table> align must be left|center|right, got "both"'),
    ("<table><tr></tr></table>", "error", "<tr> must contain at least one <td> or <th>"), ("<table><colspec/><tr><td/></tr></table>", "error", "<colspec> is not valid inside <table>; use <s:col> in <style> instead"),
    ("<table><tr><td colspan=\"a\">x</td></tr></table>", "error", '<td> colspan must be integer, got "a"'), ("<table><tr><th noWrap=\"1\">x</th></tr></table>", "error", '<th> noWrap must be true|false, got "1"'),
    ("<table><caption/><tr><td/></tr></table>", "warning", "unexpected element <caption> inside <table>"), ("<ul></ul>", "error", "<ul> must contain at least one <li>"), ("<ol><p>x</p><li/></ol>", "warning", "unexpected element <p> inside <ol>"),
    ("<ul><li align=\"both\"><p>x</p></li></ul>", "warning", "<li> must not carry block attribute align: put it on the first <p> child"), ("<pre><b>x</b></pre>", "warning", "unexpected element <b> inside <pre>"),
    ("<blockquote><p><br/></p></blockquote>", "error", "<br> missing required type attribute"), ("<aside>%s</aside>", "warning", "unknown element <aside> in write"), ("<p><font>%s</font></p>", "warning", "unknown inline element <font> in <p>"),
    ("<h1><ins>x</ins></h1>", "warning", "unknown inline element <ins> in <h1>"),
]
#: The same around the body: what stands before <write>, after it, in place of the root's attributes.
_FRAMES = [
    ("<meta><who/></meta>", "", "", "warning", "unknown <meta> child <who>"), ("<header><p>x</p></header>", "", "", "error", "<header> missing required id attribute"), ("<footer id=\"a\"/>", "", "", "error", '<footer> id must be integer, got "a"'),
    ("<extra/>", "", "", "warning", "unexpected top-level element <extra>"), ("", "<write/>", "", "error", "duplicate <write> element"), ("", "<notes><fn/></notes>", "", "error", "<fn> missing required id attribute"),
    ("", "<notes><x/></notes>", "", "warning", "unknown element <x> inside <notes>"), ("", "<style unit=\"in\"/>", "", "error", "duplicate <style> element"), ("", "", "version=\"2\"", "error", 'version must be "1.2.0", got "2"'),
    ("", "", "mode=\"odd\"", "error", 'mode must be "semantic" or "lossless", got "odd"'), ("", "", "policy=\"p\"", "error", 'policy must be "preserve-and-flag", got "p"'), ("", "", "fidelity=\"f\"", "error", 'fidelity must be "verbatim", got "f"'),
]


_EXPECTED = ", ".join(f"({k}, '{severity}', '{message.replace(chr(39), chr(39) * 2)}')" for k, (severity, message) in enumerate([*[f[1:] for f in _FINDINGS], *[f[3:] for f in _FRAMES]]))


@query(f"""
SELECT s_suppkey * 1000 + k AS doc_id, severity, replace(message, '%s', s_name) AS message, 0 AS ord FROM supplier, (VALUES {_EXPECTED}) v(k, severity, message)
""")
def verify_findings(spark, sf_dir):
    """One broken rule a text: its finding, and no other."""
    usual = {"version": "1.2.0", "mode": "semantic", "fidelity": "verbatim", "policy": "preserve-and-flag"}

    def whole(body: str, before: str = "", after: str = "", root: str = "") -> str:
        about = {k: v for k, v in usual.items() if not root.startswith(k)}
        listed = " ".join([root, *(f'{k}="{v}"' for k, v in about.items())])
        return f'<words xmlns="urn:words:v1" {listed}>{before}<style unit="in"/><write>{body}</write>{after}</words>'

    texts = [whole(body) for body, *_ in _FINDINGS] + [whole("<p>x</p>", before, after, root) for before, after, root, *_ in _FRAMES]
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.posexplode(F.array(*map(F.lit, texts))).alias("k", "text"))
    return packages.diagnostics(s.select((F.col("s_suppkey") * 1000 + F.col("k")).alias("doc_id"), F.replace("text", F.lit("%s"), F.col("s_name")).alias("words_xml")))


@query("""
SELECT p_partkey AS doc_id, 'S' || p_size AS style_id, p_brand AS name, 'paragraph' AS type, 'Normal' AS based_on, CAST(CASE WHEN p_size % 4 = 1 THEN p_size % 9 + 1 ELSE 0 END AS INT) AS heading_level, 'Arial' AS family, p_size / 2.0::DOUBLE AS size_pt,
  p_size % 2 = 0 AS bold, p_size % 3 = 0 AS italic, CASE p_size % 5 WHEN 0 THEN 'double' ELSE '' END AS underline, 'center' AS align, round(p_size / 1440.0::DOUBLE, 9) AS ind_left,
  CASE p_size % 2 WHEN 0 THEN 1.5 ELSE round(360 / 1440.0::DOUBLE, 9) END::DOUBLE AS line_sp, CASE p_size % 2 WHEN 0 THEN 'auto' ELSE 'atLeast' END AS line_rule, CAST(p_size % 3 AS INT) AS n_tabs, round(p_size / 576.0::DOUBLE, 9) AS border_w FROM part
""")
def style_table(spark, sf_dir):
    """Styles as rows, with their own run, paragraph and table properties."""
    z, tab = F.col("p_size"), '<w:tab w:pos="1"/>'
    style = _x(
        '<w:style w:type="paragraph" w:styleId="S', z, '"><w:name w:val="', F.col("p_brand"), '"/><w:basedOn w:val="Normal"/><w:rPr><w:rFonts w:hAnsi="Arial"/><w:sz w:val="', z, '"/>',
        _if(z % 2 == 0, "<w:b/>"), _if(z % 3 == 0, '<w:i w:val="true"/>'), _if(z % 5 == 0, '<w:u w:val="double"/>'), '</w:rPr><w:pPr><w:jc w:val="center"/><w:ind w:left="', z, '"/><w:spacing w:line="360" w:lineRule="',
        F.when(z % 2 == 0, "auto").otherwise("atLeast"), '"/>', _if(z % 4 == 1, '<w:outlineLvl w:val="', z % 9, '"/>'), "<w:tabs>", _if(z % 3 > 0, tab), _if(z % 3 > 1, tab), '</w:tabs></w:pPr><w:tblPr><w:tblBorders><w:top w:val="single" w:sz="', z, '"/></w:tblBorders></w:tblPr></w:style>',
    )
    rows = packages.styles(_packages(read(spark, sf_dir, "part"), "p_partkey", F.lit("<w:p/>"), word___styles__xml=_styles(style)))
    same = ("doc_id", "style_id", "name", "type", "based_on", "heading_level", "family", "size_pt", "bold", "italic", "underline", "align", "line_rule")
    near = [F.round(c, 9).alias(c) for c in ("ind_left", "line_sp", "border_w")]
    return rows.select(*same, *near, F.size("tabs").alias("n_tabs"))
