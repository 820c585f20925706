"""Packages built from literals, read and rendered."""

import pytest

from quire.operators.render import render
from quire.operators.verify import verify
from quire.sources import docx
from quire.sources.packages import NS, document_part, package

REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def rendered(body, mode="semantic", **parts):
    names = {v: k for k, v in docx.PARTS.items()}
    body = document_part(body).replace("<w:document ", '<w:document xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" ')
    files = {"word/document.xml": body} | {names.get(k, f"word/{k}.xml"): v for k, v in parts.items()}
    return render(docx.read(package(files), mode))


def p(inner, props=""):
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{inner}</w:p>"


def t(text, props=""):
    return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}<w:t>{text}</w:t></w:r>"


def numbering(levels, nums='<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'):
    lvl = "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="{s}"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{x}"/></w:lvl>' for k, (f, x, s) in enumerate(levels))
    return f'<w:numbering xmlns:w="{NS}"><w:abstractNum w:abstractNumId="0">{lvl}</w:abstractNum>{nums}</w:numbering>'


def item(text, level=0, num=1):
    return p(t(text), f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>')


def test_minimal():
    out = rendered(p(t("one plain line")))
    assert "    <p>one plain line</p>\n" in out
    assert verify(out) == (True, [], [])


def test_marks_wrap_in_order_and_toggles_go_off():
    out = rendered(p(t("x", '<w:b/><w:i/><w:u w:val="single"/><w:strike/><w:vertAlign w:val="superscript"/>')) + p(t("y", '<w:b w:val="0"/>')))
    assert "<sup><s><u><i><b>x</b></i></u></s></sup>" in out
    assert "<p>y</p>" in out


def test_headings_are_demoted():
    style = '<w:pStyle w:val="Heading1"/>'
    out = rendered(p(t("a" * 61), style) + p(t("short"), style) + p(t("set"), style + '<w:jc w:val="both"/>'))
    assert "<h1>short</h1>" in out and out.count("<h1") == 1
    assert '<p align="both">set</p>' in out


def test_links_by_relationship_anchor_and_field():
    rels = f'<Relationships xmlns="{REL}"><Relationship Id="r1" Target="https://x.org/?a=1&amp;b=2"/><Relationship Id="r2" Target="media/i.png"/></Relationships>'
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> HYPERLINK "http://f.org" \\l "s" </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>'
    body = p('<w:hyperlink r:id="r1"><w:r><w:t>one</w:t></w:r></w:hyperlink><w:hyperlink w:anchor="top"><w:r><w:rPr><w:b/></w:rPr><w:t>two</w:t></w:r></w:hyperlink>')
    out = rendered(body + p(field + t("three") + '<w:r><w:fldChar w:fldCharType="end"/></w:r>' + t("four")), rels=rels)
    assert '<a href="https://x.org/?a=1&amp;b=2">one</a><a href="#top"><b>two</b></a>' in out
    assert '<a href="http://f.org#s">three</a>four' in out


def test_lists_nest_count_and_continue():
    body = item("a") + p(t("more")) + item("b") + item("c", 1) + item("d", 1) + item("e") + p(t("------- "))
    out = rendered(body, numbering=numbering([("decimal", "%1.", 3), ("lowerLetter", "%1.%2)", 1)]))
    assert '<ol type="decimal" start="3" format="%1.">' in out
    for marker in ("3.", "4.", "4.a)", "4.b)", "5."):
        assert f'<li marker="{marker}">' in out
    assert out.index("more") < out.index('<li marker="4.">')
    assert verify(out)[0]


def test_list_ends_at_headings_and_rules():
    body = item("a") + p(t("H"), '<w:pStyle w:val="Heading3"/>') + item("b") + p(t("--------- end"))
    out = rendered(body, numbering=numbering([("decimal", "%1.", 1)]))
    assert out.count("<ol") == 2 and '<ol type="decimal" start="2" format="%1.">' in out
    assert "    </ol>\n    <p>--------- end</p>" in out


def test_bullets_without_numbering_part():
    out = rendered(item("a") + item("b"))
    assert '<ul type="bullet">' in out and out.count("<li>") == 2


def test_tables_merge_span_and_nest():
    cell = lambda text, props="": f"<w:tc>{f'<w:tcPr>{props}</w:tcPr>' if props else ''}{p(t(text))}</w:tc>"
    inner = f"<w:tbl><w:tr>{cell('in')}</w:tr></w:tbl>"
    rows = [
        cell("r", '<w:vMerge w:val="restart"/>') + cell("wide", '<w:gridSpan w:val="2"/>'),
        cell("x", "<w:vMerge/>") + f"<w:tc>{inner}{p(t('y'))}</w:tc>" + cell("z"),
        cell("w", "<w:vMerge/>") + cell("u"),
    ]
    table = '<w:tbl><w:tblPr><w:tblW w:w="5000"/><w:jc w:val="center"/></w:tblPr><w:tblGrid><w:gridCol w:w="2500"/></w:tblGrid>' + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
    out = rendered(table)
    assert '<table id="1" width="3.472222" align="center">' in out
    assert '<td rowspan="3">r</td>' in out and '<td colspan="2">wide</td>' in out
    assert '<table id="2">' in out and ">x<" not in out
    assert '<s:col ref="1" w="1.736111"/>' in out


def test_notes_stand_in_document_order():
    foot = f'<w:footnotes xmlns:w="{NS}"><w:footnote w:id="-1" w:type="separator">{p(t("no"))}</w:footnote><w:footnote w:id="1">{p(t("one"))}</w:footnote><w:footnote w:id="2">{p(t("two"))}</w:footnote></w:footnotes>'
    comments = f'<w:comments xmlns:w="{NS}"><w:comment w:id="0" w:author="Reviewer 2">{p(t("hm"))}</w:comment></w:comments>'
    ref = lambda i: f'<w:r><w:footnoteReference w:id="{i}"/></w:r>'
    body = '<w:bookmarkStart w:id="7" w:name="B1"/>' + p(t("a") + ref(1)) + '<w:bookmarkStart w:id="8" w:name="B2"/>' + p(ref(2) + '<w:r><w:commentReference w:id="0"/></w:r>')
    out = rendered(body, footnotes=foot, comments=comments)
    tail = out[out.index("<notes>") :]
    places = [tail.index(x) for x in ('<bm id="B1"/>', '<fn id="1"', '<bm id="B2"/>', '<fn id="2"', '<comment id="0" author="Reviewer 2">')]
    assert places == sorted(places) and ">no<" not in out


def test_tracked_changes_by_mode():
    body = p(t("k") + '<w:ins w:author="A" w:date="D"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:author="A"><w:r><w:delText>old</w:delText></w:r></w:del>')
    assert "<p>knew</p>" in rendered(body)
    assert 'k<ins author="A" date="D">new</ins><del author="A">old</del>' in rendered(body, "lossless")


def test_styles_indents_tabs_and_cycles():
    style = lambda i, base, ppr: f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{i}"/><w:basedOn w:val="{base}"/><w:pPr>{ppr}</w:pPr></w:style>'
    tab = lambda pos, *more: f'<w:tab w:pos="{pos}" {" ".join(more)}/>'
    styles = f'<w:styles xmlns:w="{NS}">' + style("A", "B", "") + style("B", "A", f'<w:ind w:left="720"/><w:tabs>{tab(288)}{tab(7200, "w:val=\"right\"", "w:leader=\"dot\"")}</w:tabs>') + "</w:styles>"
    direct = f'<w:pStyle w:val="A"/><w:tabs>{tab(7200, "w:val=\"clear\"")}{tab(1800, "w:val=\"left\"")}</w:tabs>'
    out = rendered(p(t("x"), direct) + p(t("y"), '<w:pStyle w:val="A"/><w:ind w:right="144"/>'), styles=styles)
    assert '<p c="A" indentLeft="0.500000" tabs="0.200000 1.250000">x</p>' in out
    assert '<p c="A" indentRight="0.100000" tabs="0.200000 5.000000@right:dot">y</p>' in out


def test_code_and_quotes():
    styles = f'<w:styles xmlns:w="{NS}"><w:style w:styleId="Q"><w:name w:val="Quote"/></w:style></w:styles>'
    mono = '<w:rFonts w:ascii="Consolas"/>'
    out = rendered(p(t("a  b"), '<w:pStyle w:val="SourceCode"/>') + p(t("q"), '<w:pStyle w:val="Q"/>') + p(t("c", mono), '<w:pStyle w:val="my-code"/>') + p(t("d"), '<w:pStyle w:val="my-code"/>'), styles=styles)
    assert "<pre>a  b</pre>" in out and "<blockquote>q</blockquote>" in out and "<pre>c</pre>" in out and "<p>d</p>" in out


def test_breaks_keep_their_place():
    out = rendered(p("<w:r><w:tab/><w:t>a</w:t></w:r><w:r><w:t>b</w:t><w:br/></w:r>", "<w:pageBreakBefore/>"))
    assert '<br type="page"/><tab/>ab<br type="textWrapping"/>' in out


def test_stories_sections_and_meta():
    header = f'<w:hdr xmlns:w="{NS}">{p(t("top"))}</w:hdr>'
    core = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T&amp;T</dc:title></cp:coreProperties>'
    out = rendered(p(t("x")) + '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440"/></w:sectPr>', header2=header, header10=header.replace("top", "ten"), core=core)
    assert "<title>T&amp;T</title>" in out and '<s:page size="Letter" mt="1.000000"' in out
    assert out.index('<header id="1">\n    <p>ten') < out.index('<header id="2">\n    <p>top')


def test_bad_packages():
    for content in (b"", b"no zip", package({"a.txt": "x"}), package({"word/document.xml": "<w:p>"})):
        with pytest.raises(docx.PackageError):
            docx.read(content)


HEAD = '<words xmlns="urn:words:v1" version="1.2.0" mode="semantic" fidelity="verbatim" policy="preserve-and-flag"><style unit="in"/><write>{}</write></words>'


@pytest.mark.parametrize(
    ("body", "errors", "warns"),
    [
        ('<p align="both" tabs="0.5 1.0@right:dot">x</p>', 0, 0), ('<p align="left">x</p>', 1, 0), ('<p tabs="x">y</p>', 1, 0),
        ("<foo/>", 0, 1), ("<ul/>", 1, 0), ('<ul><li indentLeft="1"><p>x</p></li></ul>', 0, 1), ("<table><tr/></table>", 1, 0),
        ('<table id="x"><tr><td>y</td></tr></table>', 1, 0), ("<p><br/></p>", 1, 0), ('<p><img src="a" alt=""/></p>', 1, 0), ("<p><a/></p>", 1, 0),
        ('<p><span size="11">x</span></p>', 1, 0), ("<pre><b/></pre>", 0, 1), ('<p valign="bottom">x</p>', 1, 0), ("<p><ins>x</ins></p>", 0, 1),
    ],
)
def test_verifier(body, errors, warns):
    valid, e, w = verify(HEAD.format(body))
    assert (valid, len(e), len(w)) == (not errors, errors, warns)


def test_verifier_on_broken_input():
    assert verify(" ")[1] == ["empty input"]
    assert any("parse error" in e for e in verify("<words><write>")[1])
    assert 'version must be "1.2.0", got "2"' in verify(HEAD.format("").replace("1.2.0", "2"))[1]


def test_templates_are_read_once_and_left_as_they_are():
    style = lambda i, name, more="": f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{name}"/>{more}</w:style>'
    stops = '<w:pPr><w:outlineLvl w:val="1"/><w:tabs><w:tab w:pos="720"/></w:tabs></w:pPr>'
    one, two = (f'<w:styles xmlns:w="{NS}">{style("S", name, more)}</w:styles>' for name, more in (("Quote", ""), ("Other", stops)))
    own = p(t("x"), '<w:pStyle w:val="S"/><w:tabs><w:tab w:pos="1440"/><w:tab w:pos="720" w:val="clear"/></w:tabs>')
    read = lambda styles, body: docx.read(package({"word/document.xml": document_part(body), "word/styles.xml": styles}))
    for styles, heading, quote, tabs in ((one, 0, True, []), (two, 2, False, [0.5]), (one, 0, True, []), (two, 2, False, [0.5])):
        doc = read(styles, own + p(t("y"), '<w:pStyle w:val="S"/>'))
        assert [(b.heading, b.quote, [x[0] for x in b.tabs]) for b in doc.body] == [(heading, quote, [1.0]), (heading, quote, tabs)]
    assert read(one, own).styles["S"] is read(one, own).styles["S"]
    assert not read("<w:styles", own).styles


def test_archives_are_written_and_read_as_by_zipfile():
    import io
    import zipfile

    parts = {"word/document.xml": document_part(p(t("é"))), "wörd/ä.xml": "ü", "word/styles.xml": "", "word/header1.xml": "<h/>"}

    def by_zipfile(method=zipfile.ZIP_STORED, comment=b""):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in parts.items():
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, compress_type=method)
            z.comment = comment
        return out.getvalue()

    plain = by_zipfile()
    assert package(parts) == plain
    known = {"document": parts["word/document.xml"].encode(), "styles": b""}, {"word/header1.xml": b"<h/>"}
    for content in (plain, by_zipfile(zipfile.ZIP_DEFLATED), by_zipfile(zipfile.ZIP_BZIP2), by_zipfile(comment=b"c"), b"before" + plain):
        assert docx.unpack(content) == known
    damaged = bytearray(plain)
    damaged[plain.index(b"<h/>") + 1] ^= 1  # its sum is wrong: the part counts as absent
    assert docx.unpack(bytes(damaged)) == (known[0], {})
    with pytest.raises(docx.PackageError):
        docx.unpack(plain[:-1])


def test_deep_nesting_is_an_error_with_and_without_notes():
    for more in ("", '<w:bookmarkStart w:id="1" w:name="b"/>'):
        body = more + "<w:x>" * 1500 + "</w:x>" * 1500
        with pytest.raises(docx.PackageError, match="nested too deeply"):
            docx.read(package({"word/document.xml": document_part(body)}))
