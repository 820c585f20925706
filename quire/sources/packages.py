"""Packages as Spark rows: scans of package files, minimal packages made from texts, and
the tables that a package is parsed to.

The parser runs once per package in an Arrow-batched kernel: parsed() gives any of the
tables as arrays of one row per package, and only those that are asked for are built. A
package must fit one worker; batches are bounded by their bytes.

Defined results: a package that is null, empty, no ZIP file, malformed or nested too deeply
is a row of errors() and has no row elsewhere; rows that repeat a doc_id are read each for
itself; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from itertools import accumulate
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.operators import render, verify
from quire.sources import docx

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TABS = "array<struct<pos:double,align:string,leader:string>>"
_BORDERS = "array<struct<side:string,style:string,size:int,space:int,color:string>>"
RUN = (
    "struct<seq:int,kind:string,text:string,bold:boolean,italic:boolean,target:string,inserted:boolean,deleted:boolean,bold_cs:boolean,italic_cs:boolean,underline:string,strike:boolean,"
    "small_caps:boolean,caps:boolean,vert:string,font:string,font_ea:string,font_cs:string,size:double,size_cs:double,color:string,highlight:string,lang:string,hidden:boolean,rtl:boolean,"
    "note_id:int,alt:string,width:double,height:double,ins_author:string,ins_date:string,del_author:string,del_date:string>"
)
#: What a paragraph writes as it stands, by the name it is written with and by its column.
MORE = {
    "dir": "dir", "valign": "valign", "shd": "shading", "keepNext": "keep_next", "keepLines": "keep_lines", "widowControl": "widow_control", "sectionBreak": "section_break",
    "revisionAuthor": "rev_author", "revisionDate": "rev_date", "suppressAutoHyph": "suppress_auto_hyphens", "snapToGrid": "snap_to_grid", "kinsoku": "kinsoku", "wordWrap": "word_wrap",
    "overflowPunct": "overflow_punct", "topLinePunct": "top_line_punct", "autoSpaceDE": "auto_space_de", "autoSpaceDN": "auto_space_dn", "textDirection": "text_direction",
    "suppressOverlap": "suppress_overlap", "divID": "div_id", "cnfStyle": "cnf_style", "frame": "frame",
}
#: The tables a package is parsed to: their columns behind doc_id.
TABLES = {
    "blocks": "story string, story_id int, block_seq int, kind string, style_id string, style_name string, num_id int, level int, heading_level int, align string, is_quote boolean, is_code boolean, text string, "
    "sp_before double, sp_after double, line_sp double, line_rule string, ind_left double, ind_right double, ind_first double, ind_hanging double, "
    f"tabs {_TABS}, lang string, borders {_BORDERS}, {', '.join(f'{c} string' for c in MORE.values())}, table_id int",
    "runs": f"story string, story_id int, block_seq int, {RUN.removeprefix('struct<').removesuffix('>').replace(':', ' ')}",
    "tables": f"table_id int, style_name string, width double, indent double, align string, cell_spacing double, caption string, summary string, grid array<double>, borders {_BORDERS}, n_rows int",
    "cells": f"table_id int, row_idx int, cell_idx int, is_header boolean, grid_col int, grid_span int, row_span int, omitted boolean, text string, valign string, text_dir string, no_wrap boolean, lang string, borders {_BORDERS}",
    "notes": "note_seq int, type string, id int, name string, author string, date string, doc_order int, text string",
    "styles": "style_id string, name string, type string, based_on string, heading_level int, family string, size_pt double, align string, font_ea string, font_cs string, size_cs double, color string, "
    "bold boolean, italic boolean, underline string, strike boolean, small_caps boolean, uppercase boolean, sp_before double, sp_after double, line_sp double, line_rule string, "
    f"ind_left double, ind_right double, ind_first double, ind_hanging double, tabs {_TABS}, border_w double, border_color string, border_style string, cell_spacing double, width double",
    "levels": "num_id int, ilvl int, num_fmt string, lvl_text string, start_val int, has_override boolean, ind_left double, ind_hanging double, abstract_id int",
    "meta": "title string, subject string, author string, created string, modified string, keywords string, description string",
    "sections": "section_seq int, w_in double, h_in double, mt double, mr double, mb double, ml double, mh double, mf double, cols int, cols_space double",
    "theme": "font string, font_ea string, font_cs string, fg string, bg string, font_map map<string,string>",
    "rels": "rid string, target string",
    "defaults": "family string, font_ea string, font_cs string, size_pt double, color string",
}
#: Bytes of the largest part and package that are made: beyond, a ZIP file has 64-bit sizes.
_LARGEST = 2**31 - 1
#: Rows whose packages are made and read in one task.
TASK_ROWS = 2_000
#: Bytes of packages whose rows are held at once.
BATCH_BYTES = 4_000_000


def prepare(spark: SparkSession) -> None:
    """Workers import this package wherever the driver runs, and get few packages at a time."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")


def spread(rows: DataFrame) -> DataFrame:
    """rows of a narrow table over as many partitions as their packages keep busy: Spark cuts files
    by bytes and row groups, so a few megabytes, or millions of rows, would be one task's."""
    n = -(-rows.count() // TASK_ROWS)
    return rows.repartition(n) if n > 1 else rows


def scan(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), path, content of the .docx files below a path."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def write_files(packages: DataFrame, folder: str) -> DataFrame:
    """Write each package to folder as <doc_id>.docx; doc_id, path of what was written. A file is
    written under a name of its own and then renamed, so a task that runs again leaves the same."""
    prepare(packages.sparkSession)

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for i, content in zip(batch["doc_id"], batch["content"], strict=True):
                with system.open_output_stream(f"{base}/.{i}.{attempt}") as f:
                    f.write(content)
                system.move(f"{base}/.{i}.{attempt}", f"{base}/{i}.docx")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "path": [f"{folder}/{i}.docx" for i in batch["doc_id"]]})

    return packages.select("doc_id", "content").mapInPandas(write, "doc_id long, path string")


def package(parts: dict[str, str]) -> bytes:
    """A ZIP package of named parts, the same bytes for the same parts: those that zipfile
    writes, stored, for entries of Unix from 1 January 1980."""
    out, entries, at = [], [], 0
    for name, text in parts.items():
        raw, data = name.encode(), text.encode()
        if len(data) > _LARGEST or len(raw) > 0xFFFF:
            raise ValueError(f"part {name[:99]} is too large")
        about = struct.pack("<5H3L2H", 20, 0 if name.isascii() else 0x800, 0, 0, 33, zlib.crc32(data), len(data), len(data), len(raw), 0)
        out += [b"PK\3\4", about, raw, data]
        entries += [b"PK\1\2", struct.pack("<2B", 20, 3), about, struct.pack("<3H2L", 0, 0, 0, 0o600 << 16, at), raw]
        at += 30 + len(raw) + len(data)
    if at > _LARGEST or len(parts) >= 0xFFFF:
        raise ValueError("the package is too large")
    directory = b"".join(entries)
    return b"".join((*out, directory, b"PK\5\6", struct.pack("<4H2LH", 0, 0, len(parts), len(parts), len(directory), at, 0)))


def document_part(body: str) -> str:
    return f'<w:document xmlns:w="{NS}"><w:body>{body}</w:body></w:document>'


_HEADING = f'<w:styles xmlns:w="{NS}"><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>'


def from_texts(docs: DataFrame) -> DataFrame:
    """doc_id, content: each line of a text is a paragraph, the first one in style Heading1."""
    prepare(docs.sparkSession)

    def make(batches):
        for batch in batches:
            made = []
            for text in batch["text"]:
                paragraphs = []
                for k, line in enumerate((text or "").split("\n")):
                    style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if not k else ""
                    paragraphs.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>')
                made.append(package({"word/document.xml": document_part("".join(paragraphs)), "word/styles.xml": _HEADING}))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": made})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(make, "doc_id long, content binary")


def _per_package(packages: DataFrame, schema: str, rows_of) -> DataFrame:
    """rows_of(doc_id, content) gives the tuples of one package."""
    prepare(packages.sparkSession)
    names = StructType.fromDDL(schema).names

    def run(batches):
        for batch in batches:
            rows = [row for i, content in zip(batch["doc_id"], batch["content"], strict=True) for row in rows_of(i, content)]
            yield pd.DataFrame(rows, columns=names)

    return packages.select("doc_id", "content").mapInPandas(run, schema)


def _parsed(content: bytes, mode: str, compat: bool = True):
    """The document, or None if the package cannot be read: errors() tells why."""
    try:
        return docx.read(content, mode, compat)
    except docx.PackageError:
        return None


# --- rows of one document, table by table ------------------------------------------------


def _stops(tabs) -> list[dict]:
    return [{"pos": pos, "align": align, "leader": leader} for pos, align, leader in tabs]


def _sides(borders) -> list[dict]:
    return [{"side": side, "style": style, "size": size, "space": space, "color": color} for side, (style, size, space, color) in borders.items()]


def _stories(doc):
    yield "body", 0, doc.body
    for name, stories in (("header", doc.headers), ("footer", doc.footers)):
        for k, story in enumerate(stories, 1):
            yield name, k, story
    for n in doc.notes:
        if n.body:
            yield n.type, n.id, n.body


_NONE_OF_MORE = ("",) * len(MORE)


def _block_rows(doc):
    for story, k, own in _stories(doc):
        for seq, b in enumerate(own):
            yield (
                story, k, seq, b.kind, b.style_id, b.style_name, b.num_id, b.level, b.heading, b.align, b.quote, b.code, b.plain, *b.spacing, *b.indent,
                _stops(b.tabs) if b.tabs else [], b.lang, _sides(b.borders) if b.borders else [], *([b.more.get(name, "") for name in MORE] if b.more else _NONE_OF_MORE), b.id,
            )


def _run_rows(doc):
    for story, k, own in _stories(doc):
        for seq, b in enumerate(own):
            for n, r in enumerate(b.runs):
                yield (
                    story, k, seq, n, r.kind, r.text, r.b, r.i, r.target, r.inserted is not None, r.deleted is not None, r.bcs, r.ics, r.u, r.strike, r.smallcaps, r.caps, r.vert,
                    r.font, r.ea, r.cs, r.size, r.size_cs, r.color, r.highlight, r.lang, r.hidden, r.rtl, r.note_id, r.alt, r.width, r.height, *(r.inserted or (None, None)), *(r.deleted or (None, None)),
                )


def _cell_rows(doc):
    for t in doc.tables:
        for r, (header, own) in enumerate(t.rows):
            column = 0
            for k, c in enumerate(own):
                text = "\n".join(b.plain for b in c.content if b.kind != "table")
                yield t.id, r, k, header, column, max(c.span, 1), c.row_span, c.omitted, text, c.valign, c.direction, c.no_wrap, c.lang, _sides(c.borders)
                column += max(c.span, 1)


def _style_rows(doc):
    for key, s in doc.styles.items():
        r = s.run
        yield (
            key, s.name, s.type, s.based_on, s.heading, r.font, r.size, s.align, r.ea, r.cs, r.size_cs, r.color, r.b, r.i, r.u, r.strike, r.smallcaps, r.caps,
            *s.spacing, *s.indent, _stops(s.tabs), s.border[0], s.border[1], s.border[2], s.cell_spacing, s.width,
        )


def _level_rows(doc):
    for (num, k), x in doc.levels.items():
        yield num, k, x.fmt, x.text, x.start or 0, x.override, *(x.geometry or (0.0, 0.0)), doc.abstract.get(num, -1)


_ROWS = {
    "blocks": _block_rows,
    "runs": _run_rows,
    "tables": lambda doc: [(t.id, t.style_name, t.width, t.offset, t.align, t.cell_spacing, t.caption, t.summary, t.grid, _sides(t.borders), len(t.rows)) for t in doc.tables],
    "cells": _cell_rows,
    "notes": lambda doc: [(k, n.type, n.id, n.name, n.author, n.date, n.order, "\n".join(b.plain for b in n.body)) for k, n in enumerate(doc.notes)],
    "styles": _style_rows,
    "levels": _level_rows,
    "meta": lambda doc: [tuple(doc.meta.get(k, "") for k in ("title", "subject", "creator", "created", "modified", "keywords", "description"))] if doc.meta else [],
    "sections": lambda doc: [(k, *(x[c] for c in ("w", "h", "mt", "mr", "mb", "ml", "mh", "mf", "cols", "space"))) for k, x in enumerate(doc.sections)],
    "theme": lambda doc: [(*(doc.theme[k] for k in ("font", "fontEA", "fontCS", "fg", "bg")), list(doc.fonts.items()))] if doc.theme else [],
    "rels": lambda doc: list(doc.rels.items()),
    "defaults": lambda doc: [(doc.default.font, doc.default.ea, doc.default.cs, doc.default.size, doc.default.color)],
}


def _lists(rows: list[list[tuple]], kind, picked: list[int]):
    """The rows of each package as an Arrow array of lists of structs with the picked columns."""
    import pyarrow as pa

    flat, ends = [row for own in rows for row in own], [0, *accumulate(map(len, rows))]
    fields = list(kind.value_type)
    structs = pa.StructArray.from_arrays([pa.array([row[k] for row in flat], field.type) for k, field in zip(picked, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, type=kind)


def parsed(packages: DataFrame, tables: tuple[str, ...] = tuple(TABLES), mode: str = "semantic", compat: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per package, parsed once: doc_id, error (null if it could be read), and each
    asked table as an array of its rows. Write it to take several tables from one parse.
    columns: of the tables, only these are handed on, if any are named."""
    prepare(packages.sparkSession)
    whole = {name: StructType.fromDDL(TABLES[name]) for name in tables}
    fields = {name: StructType([x for x in struct if not columns or x.name in columns]) for name, struct in whole.items()}
    if any(not struct.fields for struct in fields.values()) or not {x.name for struct in fields.values() for x in struct} >= set(columns):
        raise ValueError(f"not all of {columns} are columns of {tables}")
    schema = "doc_id long, error string" + "".join(f", {name} array<{struct.simpleString()}>" for name, struct in fields.items())
    names = {name: [whole[name].names.index(x) for x in struct.names] for name, struct in fields.items()}
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        ids, errors, rows, size = [], [], {name: [] for name in names}, 0

        def flush():
            nonlocal ids, errors, rows, size
            if ids:
                own = [_lists(rows[name], kinds.field(name).type, picked) for name, picked in names.items()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(errors, pa.string()), *own], schema=kinds)
            ids, errors, rows, size = [], [], {name: [] for name in names}, 0

        for batch in batches:
            for i, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py()
                try:
                    doc, error = docx.read(content, mode, compat), None
                except docx.PackageError as e:
                    doc, error = None, str(e)
                ids.append(i)
                errors.append(error)
                for name, own in rows.items():
                    own.append(list(_ROWS[name](doc)) if doc else [])
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield from flush()
            yield from flush()

    return packages.select(F.col("doc_id").cast("long"), "content").mapInArrow(run, schema)


def table(parsed_packages: DataFrame, name: str) -> DataFrame:
    """One of the tables that parsed() holds, as flat rows."""
    return parsed_packages.select("doc_id", F.explode(name).alias("_row")).select("doc_id", "_row.*")


def errors(packages: DataFrame) -> DataFrame:
    """doc_id, stage, error of the packages that cannot be read."""
    return parsed(packages, ()).where("error is not null").select("doc_id", F.lit("parse").alias("stage"), "error")


def blocks(packages: DataFrame, mode: str = "semantic", compat: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of all stories in order, with all columns or those named; blocks of table cells are in cells()."""
    return table(parsed(packages, ("blocks",), mode, compat, columns), "blocks")


def runs(packages: DataFrame, mode: str = "semantic", compat: bool = True) -> DataFrame:
    """Inline atoms of the blocks of all stories."""
    return table(parsed(packages, ("runs",), mode, compat), "runs")


def cells(packages: DataFrame, mode: str = "semantic") -> DataFrame:
    return table(parsed(packages, ("cells",), mode), "cells")


def notes(packages: DataFrame, mode: str = "semantic") -> DataFrame:
    return table(parsed(packages, ("notes",), mode), "notes")


def styles(packages: DataFrame) -> DataFrame:
    return table(parsed(packages, ("styles",)), "styles")


def levels(packages: DataFrame) -> DataFrame:
    return table(parsed(packages, ("levels",)), "levels")


def rendered(packages: DataFrame, mode: str = "semantic", compat: bool = True) -> DataFrame:
    """doc_id, mode, words_xml; packages that cannot be read give no row."""

    def rows(i, content):
        doc = _parsed(content, mode, compat)
        if doc:
            yield i, mode, render.render(doc)

    return _per_package(packages, "doc_id long, mode string, words_xml string", rows)


def verified(texts: DataFrame) -> DataFrame:
    """texts: doc_id, words_xml. doc_id, valid, errors, warns."""
    prepare(texts.sparkSession)

    def run(batches):
        for batch in batches:
            got = [(i, *verify.verify(x or "")) for i, x in zip(batch["doc_id"], batch["words_xml"], strict=True)]
            yield pd.DataFrame(got, columns=["doc_id", "valid", "errors", "warns"])

    return texts.select("doc_id", "words_xml").mapInPandas(run, "doc_id long, valid boolean, errors array<string>, warns array<string>")


def diagnostics(texts: DataFrame) -> DataFrame:
    """texts: doc_id, words_xml. One row per finding: doc_id, severity, message, ord."""
    found = verified(texts)
    listed = lambda name, column: found.select("doc_id", F.lit(name).alias("severity"), F.posexplode(column).alias("ord", "message"))
    return listed("error", "errors").unionByName(listed("warning", "warns")).select("doc_id", "severity", "message", "ord")


def from_parts(parts: DataFrame) -> DataFrame:
    """parts: doc_id, parts (array of struct<name, text>). Packages with these parts."""
    prepare(parts.sparkSession)

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            made = [package({x["name"]: x["text"] or "" for x in own}) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    return parts.select(F.col("doc_id").cast("long").alias("doc_id"), "parts").mapInArrow(make, "doc_id long, content binary")


class DocxBlocks:
    """Table function docx_blocks(content): the body's blocks of one package, none if it cannot be read."""

    def eval(self, content: bytes):
        doc = _parsed(content, "semantic")
        for k, b in enumerate(doc.body if doc else ()):
            yield k, b.kind, b.heading, b.plain


def register(spark: SparkSession) -> None:
    """Make docx_blocks known to SQL: SELECT ... FROM packages, LATERAL docx_blocks(content)."""
    prepare(spark)
    spark.udtf.register("docx_blocks", F.udtf(DocxBlocks, returnType="block_seq int, kind string, heading_level int, text string"))


_NUMBERING = f'<w:numbering xmlns:w="{NS}"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="2"/><w:numFmt w:val="decimalZero"/><w:lvlText w:val="(%1)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'


def _text(s: str | None) -> str:
    return f'<w:r><w:t xml:space="preserve">{escape(s or "")}</w:t></w:r>'


def from_items(items: DataFrame) -> DataFrame:
    """items: doc_id, texts (array of strings in order). Packages with one numbered list."""
    prepare(items.sparkSession)

    def make(batches):
        for batch in batches:
            item = '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr>{}</w:p>'
            made = [package({"word/document.xml": document_part("".join(item.format(_text(t)) for t in texts)), "word/numbering.xml": _NUMBERING}) for texts in batch["texts"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": made})

    return items.select("doc_id", "texts").mapInPandas(make, "doc_id long, content binary")


def from_rows(tables: DataFrame) -> DataFrame:
    """tables: doc_id, rows (array of arrays of struct<text, span, merge>, merge one of
    restart, continue, none). Packages with one table."""
    prepare(tables.sparkSession)

    def cell(c) -> str:
        merge = {"restart": '<w:vMerge w:val="restart"/>', "continue": "<w:vMerge/>"}.get(c["merge"], "")
        return f'<w:tc><w:tcPr><w:gridSpan w:val="{c["span"]}"/>{merge}</w:tcPr><w:p>{_text(c["text"])}</w:p></w:tc>'

    def make(batches):
        for batch in batches:
            made = [package({"word/document.xml": document_part("<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows) + "</w:tbl>")}) for rows in batch["rows"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": made})

    return tables.select("doc_id", "rows").mapInPandas(make, "doc_id long, content binary")


def from_notes(noted: DataFrame) -> DataFrame:
    """noted: doc_id, ids (array of footnote ids in the order of their references). Packages
    with a paragraph for each reference; the notes themselves stand in ascending order."""
    prepare(noted.sparkSession)

    def make(batches):
        for batch in batches:
            made = []
            for ids in batch["ids"]:
                body = "".join(f'<w:p><w:r><w:footnoteReference w:id="{i}"/></w:r></w:p>' for i in ids)
                notes_part = "".join(f'<w:footnote w:id="{i}"><w:p>{_text(f"note {i}")}</w:p></w:footnote>' for i in sorted(set(ids)))
                made.append(package({"word/document.xml": document_part(body), "word/footnotes.xml": f'<w:footnotes xmlns:w="{NS}">{notes_part}</w:footnotes>'}))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": made})

    return noted.select("doc_id", "ids").mapInPandas(make, "doc_id long, content binary")
