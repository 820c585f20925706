"""One word-processing package, read and resolved: an ordered kernel over its XML parts.

Order among siblings and recursion (cells, text boxes, content controls) is what built-in
expressions cannot keep, so this part is Python; everything keyed or ordered by columns is
left to DataFrame operators. A package that is no ZIP file, has no main part, or whose main
part is malformed raises PackageError; any other malformed part counts as absent. A list
paragraph without a list id counts as plain.
"""

from __future__ import annotations

import contextlib
import functools
import io
import re
import struct
import zipfile
import zlib
from dataclasses import dataclass, field
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
PIC = "{http://schemas.openxmlformats.org/drawingml/2006/picture}"
DC, TERMS = "{http://purl.org/dc/elements/1.1/}", "{http://purl.org/dc/terms/}"
CORE = "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
OFFICE_HREF = "{urn:schemas-microsoft-com:office:office}href"
TWIPS, EMU = 1440.0, 914400.0

#: Part names and what they hold.
PARTS = {
    "word/document.xml": "document", "word/styles.xml": "styles", "word/numbering.xml": "numbering",
    "word/_rels/document.xml.rels": "rels", "word/theme/theme1.xml": "theme", "docProps/core.xml": "core",
    "word/footnotes.xml": "footnotes", "word/endnotes.xml": "endnotes", "word/comments.xml": "comments",
}
_STORY = re.compile(r"word/((?:header|footer)[^/]*)\.xml\Z")


class PackageError(ValueError):
    pass


def _with(x, **put):
    """A copy of a dataclass's instance with other values."""
    new = object.__new__(type(x))
    new.__dict__.update(x.__dict__, **put)
    return new


@dataclass
class Run:
    """An inline atom. kind: text, tab, br, note, link, img or sym."""

    kind: str = "text"
    text: str = ""
    b: bool = False
    i: bool = False
    bcs: bool = False
    ics: bool = False
    u: str = ""
    strike: bool = False
    smallcaps: bool = False
    caps: bool = False
    vert: str = ""
    font: str = ""
    ea: str = ""
    cs: str = ""
    size: float = 0.0
    size_cs: float = 0.0
    color: str = ""
    highlight: str = ""
    lang: str = ""
    hidden: bool = False
    rtl: bool = False
    target: str = ""  # a link's address, a break's type, a note's type, an image's source, a symbol's code
    note_id: int = 0
    alt: str = ""
    width: float = 0.0  # an image's, in inches
    height: float = 0.0
    inserted: tuple[str, str] | None = None
    deleted: tuple[str, str] | None = None


@dataclass
class Style:
    name: str = ""
    type: str = ""
    based_on: str = ""
    heading: int = 0
    align: str = ""
    run: Run = field(default_factory=Run)
    spacing: tuple[float, float, float, str] = (0.0, 0.0, 0.0, "")
    indent: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    tabs: list[tuple[float, str, str]] = field(default_factory=list)
    border: tuple[float, str, str] = (0.0, "", "")
    cell_spacing: float = 0.0
    width: float = 0.0


@dataclass
class Resolved:
    """What a paragraph takes from its style and that one's ancestors; spacing and indent are None where none has any."""

    heading: int
    spacing: tuple[float, float, float, str] | None
    indent: tuple[float, float, float, float] | None
    tabs: list[tuple[float, str, str]]
    quote: bool


@dataclass
class Block:
    """A paragraph, a list item or a table. spacing: before, after, line, rule; indent: left, right, first, hanging."""

    kind: str
    style_id: str = ""
    style_name: str = ""
    num_id: int = 0
    level: int = 0
    heading: int = 0
    align: str = ""
    quote: bool = False
    code: bool = False
    spacing: tuple[float, float, float, str] = (0.0, 0.0, 0.0, "")
    indent: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    tabs: list[tuple[float, str, str]] = field(default_factory=list)
    lang: str = ""
    borders: dict[str, tuple[str, int, int, str]] = field(default_factory=dict)
    more: dict[str, str] = field(default_factory=dict)  # further attributes as they are written
    runs: list[Run] = field(default_factory=list)
    # of a table
    id: int = 0
    width: float = 0.0
    offset: float = 0.0
    cell_spacing: float = 0.0
    caption: str = ""
    summary: str = ""
    grid: list[float] = field(default_factory=list)
    rows: list[tuple[bool, list[Cell]]] = field(default_factory=list)

    @property
    def plain(self) -> str:
        return "".join(r.text for r in self.runs)


@dataclass
class Cell:
    span: int = 0
    merge: str = ""
    row_span: int = 0
    omitted: bool = False
    valign: str = ""
    direction: str = ""
    no_wrap: bool = False
    lang: str = ""
    borders: dict[str, tuple[str, int, int, str]] = field(default_factory=dict)
    content: list[Block] = field(default_factory=list)


@dataclass
class Level:
    fmt: str | None = None
    text: str | None = None
    start: int | None = None
    override: bool = False
    geometry: tuple[float, float] | None = None  # left, hanging


@dataclass
class Note:
    type: str
    id: int
    name: str = ""
    author: str = ""
    date: str = ""
    order: int = 0
    body: list[Block] = field(default_factory=list)


@dataclass
class Document:
    mode: str
    compat: bool = True
    meta: dict[str, str] = field(default_factory=dict)
    theme: dict[str, str] | None = None
    fonts: dict[str, str] = field(default_factory=dict)
    styles: dict[str, Style] = field(default_factory=dict)
    resolved: dict[str, Resolved] = field(default_factory=dict)
    default: Run = field(default_factory=lambda: Run(font="Times New Roman", size=11.0))
    levels: dict[tuple[int, int], Level] = field(default_factory=dict)
    abstract: dict[int, int] = field(default_factory=dict)
    rels: dict[str, str] = field(default_factory=dict)
    sections: list[dict[str, float]] = field(default_factory=list)
    headers: list[list[Block]] = field(default_factory=list)
    footers: list[list[Block]] = field(default_factory=list)
    body: list[Block] = field(default_factory=list)
    notes: list[Note] = field(default_factory=list)
    tables: list[Block] = field(default_factory=list)

    def chain(self, style_id: str):
        """A style and its ancestors, nearest first, each once."""
        seen = set()
        while style_id and style_id not in seen and style_id in self.styles:
            seen.add(style_id)
            yield self.styles[style_id]
            style_id = self.styles[style_id].based_on

    def resolve(self, style_id: str) -> Resolved:
        """Worked out once for each style of the styles part."""
        if not style_id or style_id not in self.styles:
            return _unstyled(style_id)
        if (got := self.resolved.get(style_id)) is None:
            chain = list(self.chain(style_id))
            got = self.resolved[style_id] = Resolved(
                heading_of(style_id) or next((s.heading for s in chain if s.heading > 0), 0), next((s.spacing for s in chain if max(s.spacing[:3]) > 0), None),
                next((s.indent for s in chain if max(s.indent) > 0), None), next((s.tabs for s in chain if s.tabs), []), any(s.name in QUOTES for s in chain),
            )
        return got


# --- reading XML ------------------------------------------------------------------------


def _get(e, path: str, name: str = "val", default: str = "") -> str:
    """Attribute of the first descendant on a path, or default."""
    for step in path.split("/") if path else ():
        e = e.find(W + step) if e is not None else None
    return default if e is None else e.get(W + name, default)


def _first(e) -> dict:
    """The first child of each tag."""
    return {} if e is None else {c.tag: c for c in reversed(e)}


def _val(own: dict, tag: str, name: str = "val") -> str:
    """Attribute of one of _first's children, or nothing."""
    return "" if (e := own.get(W + tag)) is None else e.get(W + name, "")


def _int(e, path: str, name: str = "val") -> int:
    return int(_get(e, path, name).strip() or 0)


def _on(e, path: str) -> bool:
    got = e.find(W + path) if e is not None else None
    return got is not None and got.get(W + "val", "") not in ("0", "false")


def _inch(e, path: str, name: str) -> float:
    return _int(e, path, name) / TWIPS


def _borders(e) -> dict[str, tuple[str, int, int, str]]:
    if e is None:
        return {}
    return {side: (_get(b, ""), _int(b, "", "sz"), _int(b, "", "space"), _get(b, "", "color")) for side in ("top", "bottom", "left", "right") if (b := e.find(W + side)) is not None}


def _tabs(own) -> list[tuple[float, str, str]] | None:
    """None where the paragraph has no tab element of its own."""
    return None if own is None else [(_inch(t, "", "pos"), _get(t, "") or "left", _get(t, "", "leader") or "none") for t in own.findall(W + "tab")]


def _spacing(s) -> tuple[float, float, float, str] | None:
    if s is None:
        return None
    line, rule = _int(s, "", "line"), _get(s, "", "lineRule")
    return _inch(s, "", "before"), _inch(s, "", "after"), *((line / (240.0 if rule == "auto" else TWIPS), rule) if line > 0 else (0.0, ""))


def _indent(i) -> tuple[float, float, float, float] | None:
    return None if i is None else tuple(_inch(i, "", name) for name in ("left", "right", "firstLine", "hanging"))


def _fonts(rpr, theme: dict[str, str]) -> dict[str, str]:
    """font, ea and cs that an rFonts element names; a theme keyword without a typeface names none."""
    f = rpr.find(W + "rFonts") if rpr is not None else None
    if f is None:
        return {}
    at = lambda name: f.get(W + name, "")
    out = {
        "font": at("ascii") or at("hAnsi") or theme.get(at("asciiTheme") or at("hAnsiTheme"), ""),
        "ea": at("eastAsia") or theme.get(at("eastAsiaTheme"), ""),
        "cs": at("cs") or theme.get(at("cstheme"), ""),
    }
    return {k: v for k, v in out.items() if v}


#: A run's properties: the toggles, and what is taken as it stands.
_TOGGLES = {W + tag: name for name, tag in (("b", "b"), ("bcs", "bCs"), ("i", "i"), ("ics", "iCs"), ("smallcaps", "smallCaps"), ("caps", "caps"), ("strike", "strike"), ("strike", "dstrike"))}
_PLAIN = {W + name: name for name in ("u", "color", "highlight", "lang")}


def overlay(run: Run, rpr, theme: dict[str, str], vanish_clears: bool, **put) -> Run:
    """run with the properties of an rPr element over it, and over put."""
    if rpr is None:
        return _with(run, **put) if put else run
    if not len(rpr):
        return _with(run, rtl=False, **put, **({"hidden": False} if vanish_clears else {}))
    own = {}
    for e in rpr:
        own.setdefault(e.tag, e.get(W + "val", ""))
    if W + "rFonts" in own:
        put |= _fonts(rpr, theme)
    for tag, value in own.items():
        if tag in _TOGGLES:
            if value not in ("0", "false"):
                put[_TOGGLES[tag]] = True
        elif tag in _PLAIN:
            put[_PLAIN[tag]] = value
    if own.get(W + "vertAlign") in ("superscript", "subscript"):
        put["vert"] = own[W + "vertAlign"]
    for name, tag in (("size", W + "sz"), ("size_cs", W + "szCs")):
        if tag in own:
            put[name] = int(own[tag].strip() or 0) / 2.0
    vanish = own.get(W + "vanish", "0") not in ("0", "false")
    if vanish_clears or vanish:
        put["hidden"] = vanish
    put["rtl"] = own.get(W + "rtl", "0") not in ("0", "false")
    return _with(run, **put)


@functools.lru_cache(maxsize=1024)
def _fonts_alone(font: str, ea: str, cs: str) -> Run:
    """A run with these fonts; all that have them start from the same, which is only copied."""
    return Run(font=font, ea=ea, cs=cs)


_HEADING = re.compile(r"heading\+?0*([1-9])\Z")


@functools.lru_cache(maxsize=4096)
def heading_of(style_id: str) -> int:
    s = style_id.lower()
    if m := _HEADING.match(s):
        return int(m[1])
    return {"title": 1, "heading": 1, "subtitle": 2}.get(s, 0)


@functools.lru_cache(maxsize=4096)
def _unstyled(style_id: str) -> Resolved:
    return Resolved(heading_of(style_id), None, None, [], False)


def hyperlink_target(instruction: str) -> str:
    """Address of a HYPERLINK field, empty if it has none."""
    s = instruction.strip()
    if not s.startswith("HYPERLINK"):
        return ""
    rest = s[len("HYPERLINK") :].strip()
    if rest.startswith("\\l"):
        anchor = rest[2:].strip().strip('"')
        return f"#{anchor}" if anchor else ""
    if m := re.match(r'"([^"]*)"\s*(?:\\l(.*))?', rest, re.S):
        anchor = (m[2] or "").strip().strip('"')
        return m[1] + (f"#{anchor}" if anchor else "")
    return rest.split(" \\", 1)[0].strip()


def clean_space(text: str) -> str:
    text = re.sub(" +", " ", text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " "))
    return text.lstrip("\n").rstrip("\n ")


# --- paragraphs and tables ---------------------------------------------------------------

#: Style names and ids of code, and names of quotations.
CODE_NAMES = {"code", "code block", "codeblock", "plain text", "plaintext", "source code", "sourcecode", "preformatted", "preformatted text", "source", "output"}
CODE_IDS = {"code", "codeblock", "codeblock1", "codeblock2", "plaintext", "sourcecode", "preformatted", "source", "output"}
QUOTES = {"Quote", "IntenseQuote", "BlockText"}
MONOSPACE = {"courier new", "courier", "consolas", "lucida console", "menlo", "monaco", "monospace"}


def _monospace(font: str) -> bool:
    f = font.strip().lower()
    return f in MONOSPACE or "mono" in f or "courier" in f


def _names_code(s: str) -> bool:
    """Whether the first occurrence of a code word stands alone in a style's name or id."""
    s = f" {s.lower()} "
    return any((at := s.find(word)) > 0 and s[at - 1] in " -_" and s[at + len(word)] in " -_" for word in ("code", "source", "output"))


@functools.lru_cache(maxsize=4096)
def _code_style(name: str, style_id: str) -> tuple[bool, bool]:
    """Whether a style is one of code, and whether it is where all its runs are monospaced."""
    return name.lower() in CODE_NAMES or style_id.lower() in CODE_IDS, _names_code(name) or _names_code(style_id)


#: What stands in a paragraph beside its properties; what a run of words alone holds; what few paragraphs have.
_KINDS = ("r", "ins", "del", "hyperlink", "dir", "bdo")
_WORDS = {W + "rPr", W + "t"}
_FURTHER = {
    W + tag for tag in (
        "bidi", "textAlignment", "shd", "keepNext", "keepLines", "widowControl", "suppressAutoHyphens", "snapToGrid", "kinsoku", "wordWrap", "overflowPunct", "topLinePunct", "autoSpaceDE", "autoSpaceDN",
        "suppressOverlap", "sectPr", "pPrChange", "textDirection", "cnfStyle", "divId", "framePr",
    )
}


class Reader:
    def __init__(self, doc: Document):
        self.doc = doc

    def blocks(self, parent, top: bool = False, paragraphs_only: bool = False) -> list[Block]:
        """Blocks of a story in order. Notes have paragraphs only."""
        out: list[Block] = []
        for e in parent:
            if e.tag == W + "p":
                out += self.paragraph(e, top, paragraphs_only)
            elif e.tag == W + "tbl" and not paragraphs_only:
                out.append(self.table(e))
            elif e.tag == W + "sdt" and not paragraphs_only and (content := e.find(W + "sdtContent")) is not None:
                out += self.blocks(content)
        return out

    def paragraph(self, p, top: bool, note: bool) -> list[Block]:
        ppr = p.find(W + "pPr")
        own = _first(ppr)
        num = _int(own[W + "numPr"], "numId") if W + "numPr" in own else 0
        boxes = [b for d in p.findall(W + "drawing") if (c := d.find(W + "txbxContent")) is not None for b in self.blocks(c)]
        if num:
            block = Block("list", num_id=num, level=_int(own[W + "numPr"], "ilvl"))
            self._name(block, own)
            self._layout(block, own)
            block.runs, inner = self.runs(p, own, block.style_id if ppr is not None else None, False, None, top)
            return [*inner, block, *([] if note else boxes)]
        block, defaults = self._plain(p, ppr, own)
        block.runs, inner = self.runs(p, own, block.style_id if ppr is not None else None, block.code, defaults, top)
        block.lang = block.lang or next((r.lang for r in block.runs if r.lang), "")
        if block.heading and not block.code and (len(block.plain.encode()) > 60 or block.align == "both"):
            block.heading = 0
        return [block, *inner, *boxes]

    def _name(self, block: Block, own: dict) -> None:
        block.style_id = _val(own, "pStyle")
        if block.style_id in self.doc.styles:
            block.style_name = self.doc.styles[block.style_id].name

    def _layout(self, block: Block, own: dict) -> None:
        """A paragraph's own spacing or indent replaces its style's as a whole; list items
        inherit neither. Tab stops inherit, are replaced by position, and cleared."""
        style, inherits = self.doc.resolve(block.style_id), block.kind != "list"
        spacing, indent = _spacing(own.get(W + "spacing")), _indent(own.get(W + "ind"))
        if spacing is None and inherits:
            spacing = style.spacing
        if indent is None and inherits:
            indent = style.indent
        block.spacing, block.indent = spacing or block.spacing, indent or block.indent
        block.tabs = style.tabs
        if (stops_of_its_own := _tabs(own.get(W + "tabs"))) is not None:
            stops = {t[0]: t for t in block.tabs}
            for t in stops_of_its_own:
                stops.pop(t[0], None)
                if t[1] != "clear":
                    stops[t[0]] = t
            block.tabs = [stops[x] for x in sorted(stops)]

    def _plain(self, p, ppr, own: dict) -> tuple[Block, Run | None]:
        block, defaults, doc = Block("paragraph"), None, self.doc
        if ppr is not None:
            self._name(block, own)
            block.heading = doc.resolve(block.style_id).heading
            if not block.heading and W + "outlineLvl" in own and 0 <= (outline := _int(own[W + "outlineLvl"], "")) <= 8:
                block.heading = outline + 1
            block.align, block.lang = _val(own, "jc"), _val(own, "lang")
            self._layout(block, own)
            block.borders = _borders(own.get(W + "pBdr"))
            if not _FURTHER.isdisjoint(own):
                self._further(block, ppr)
            if (rpr := own.get(W + "rPr")) is not None:
                seed = doc.styles[block.style_id].run if block.style_id in doc.styles else Run()
                defaults = overlay(_with(seed), rpr, doc.fonts, False)
        block.quote = block.style_name in QUOTES or doc.resolve(block.style_id).quote
        block.code, if_mono = _code_style(block.style_name, block.style_id)
        if if_mono and not block.code:
            fonts = [r.find(f"{W}rPr/{W}rFonts") for r in p.findall(W + "r")]
            block.code = bool(fonts) and all(f is not None and (_monospace(f.get(W + "ascii", "")) or _monospace(f.get(W + "hAnsi", ""))) for f in fonts)
        return block, defaults

    def _further(self, block: Block, ppr) -> None:
        put = block.more
        put["dir"] = "rtl" if _on(ppr, "bidi") else ""
        put["valign"], put["shd"] = _get(ppr, "textAlignment"), _get(ppr, "shd", "fill")
        for tag in ("keepNext", "keepLines", "widowControl", "suppressAutoHyphens", "snapToGrid", "kinsoku", "wordWrap", "overflowPunct", "topLinePunct", "autoSpaceDE", "autoSpaceDN", "suppressOverlap"):
            put[tag.replace("Hyphens", "Hyph")] = "true" if _on(ppr, tag) else ""
        section = ppr.find(W + "sectPr")
        if section is not None:
            put["sectionBreak"] = _get(section, "type") if section.find(W + "type") is not None else "nextPage"
        put["revisionAuthor"], put["revisionDate"] = _get(ppr, "pPrChange", "author"), _get(ppr, "pPrChange", "date")
        put["textDirection"], put["cnfStyle"] = _get(ppr, "textDirection"), _get(ppr, "cnfStyle")
        put["divID"] = str(_int(ppr, "divId")) if _int(ppr, "divId") > 0 else ""
        f = ppr.find(W + "framePr")
        if f is not None:
            length = lambda name: f"{_inch(f, '', name):.6f}" if _int(f, "", name) > 0 else ""
            parts = {
                "dropCap": _get(f, "", "dropCap"), "lines": str(max(_int(f, "", "lines"), 0) or ""), "width": length("w"), "height": length("h"),
                "vSpace": length("vSpace"), "hSpace": length("hSpace"), "wrap": _get(f, "", "wrap"), "hAnchor": _get(f, "", "hAnchor"),
                "vAnchor": _get(f, "", "vAnchor"), "x": length("x"), "xAlign": _get(f, "", "xAlign"), "y": length("y"), "yAlign": _get(f, "", "yAlign"),
                "hRule": _get(f, "", "hRule"), "anchorLock": "true" if f.find(W + "anchorLock") is not None else "",
            }
            put["frame"] = " ".join(f"{k}='{v}'" for k, v in parts.items() if v)

    def runs(self, p, own: dict, style_id: str | None, code: bool, defaults: Run | None, top: bool) -> tuple[list[Run], list[Block]]:
        """Runs come before tracked insertions, deletions, links and directed spans, as each
        of these kinds is gathered in turn (without compat: all in order); blocks of text
        boxes come apart."""
        doc = self.doc
        style = doc.styles.get(style_id)
        seed = _fonts_alone(style.run.font, style.run.ea, style.run.cs) if style is not None else _fonts_alone("", "", "")
        if (rpr := own.get(W + "rPr")) is not None:
            seed = overlay(seed, rpr, doc.fonts, False)
            seed = _fonts_alone(seed.font, seed.ea, seed.cs)
        out, boxes, state = [], [], {"target": "", "shown": False}
        if W + "pageBreakBefore" in own and _val(own, "pageBreakBefore") not in ("0", "false"):
            out.append(Run("br", target="page"))
        parts = [e for e in p if e.tag.removeprefix(W) in _KINDS]
        if all(e.tag == W + "r" and e.find(W + "ins") is None and e.find(W + "del") is None for e in parts):
            for r in parts:
                got, inner = self._atoms(r, seed, defaults, code, state, top)
                out += got
                boxes += inner
            return out, boxes

        def atoms(r, ordered: bool = False) -> list[Run]:
            got, inner = self._atoms(r, seed, defaults, code, state, ordered)
            boxes.extend(inner)
            return got

        def tracked(parent, rtl: bool = False) -> list[Run]:
            found = []
            for tag, name in (("ins", "inserted"), ("del", "deleted")):
                for e in [c for c in parent if c.tag == W + tag][-1:]:
                    keep = len(boxes)
                    found += [_with(a, rtl=a.rtl or rtl, **{name: (_get(e, "", "author"), _get(e, "", "date"))}) for r in e.findall(W + "r") for a in atoms(r)]
                    del boxes[keep:]
            return found

        def changed(e, name: str) -> list[Run]:
            keep = len(boxes)
            found = [_with(a, **{name: (_get(e, "", "author"), _get(e, "", "date"))}) for r in e.findall(W + "r") for a in atoms(r)]
            del boxes[keep:]
            return found

        def directed(e) -> list[Run]:
            rtl = _get(e, "") == "rtl"
            return [a for r in e.findall(W + "r") for a in [_with(x, rtl=x.rtl or rtl) for x in atoms(r)] + tracked(r, rtl)]

        kinds = {  # all of _KINDS, in its order
            "r": lambda e: atoms(e, top) + tracked(e), "ins": lambda e: changed(e, "inserted"), "del": lambda e: changed(e, "deleted"),
            "hyperlink": self._link, "dir": directed, "bdo": directed,
        }
        if doc.compat:
            parts.sort(key=lambda e: _KINDS.index(e.tag.removeprefix(W)))
        for e in parts:
            out += kinds[e.tag.removeprefix(W)](e)
        return out, boxes

    def _special(self, r, tags: set[str], state: dict) -> tuple[list[Run], list[Block]] | None:
        """Atoms of a run that has a field's part, a picture or a symbol; None if it has none of them."""
        doc = self.doc
        if W + "fldChar" in tags:
            kind = _get(r.findall(W + "fldChar")[-1], "", "fldCharType")
            if kind == "separate":
                state["shown"] = True
            elif kind in ("begin", "end"):
                state.update(target="", shown=False)
            return [], []
        if W + "instrText" in tags:
            state["target"] = state["target"] or hyperlink_target("".join(i.text or "" for i in r.findall(W + "instrText")))
            return [], []
        if W + "pict" in tags:
            rid = next((v for e in r.find(W + "pict").iter() for k, v in e.attrib.items() if k in (R + "id", R + "embed", OFFICE_HREF) and v), "")
            return ([Run("img", target=doc.rels.get(rid) or rid)] if rid else []), []
        if W + "drawing" in tags:
            drawing = r.find(W + "drawing")
            if (box := drawing.find(W + "txbxContent") if doc.compat else next(drawing.iter(W + "txbxContent"), None)) is not None:
                return [], self.blocks(box)
            return self._image(drawing), []
        if W + "sym" in tags:
            return [Run("sym", target=_get(r, "sym", "char"))], []
        return None

    def _atoms(self, r, seed: Run, defaults: Run | None, code: bool, state: dict, ordered: bool) -> tuple[list[Run], list[Block]]:
        doc, rpr, tags = self.doc, r.find(W + "rPr"), {e.tag for e in r}
        if not tags <= _WORDS and (special := self._special(r, tags, state)) is not None:
            return special
        texts = r.findall(W + "t") or r.findall(W + "delText")
        text = "".join([t.text or "" for t in texts])
        if doc.mode == "semantic" and not code and not any(t.get(XML_SPACE) == "preserve" for t in texts):
            text = clean_space(text)
        base = _with(defaults) if defaults is not None and rpr is None else seed
        if tags <= _WORDS:
            only = overlay(base, rpr, doc.fonts, True, text=text)
            return ([_with(only, kind="link", target=state["target"]) if state["shown"] and state["target"] else only] if text else []), []
        order = [e.tag.removeprefix(W) for e in r]
        worded = bool(texts)
        first_text = next((k for k, tag in enumerate(order) if tag in ("t", "delText")), len(order))
        before = lambda *tags: not worded or ordered and any(tag in tags for tag in order[:first_text])
        tab, cr, br = "tab" in order, "cr" in order, r.findall(W + "br")
        kind_of_break = (_get(br[-1], "", "type") or "textWrapping") if br else ""
        out = []
        if tab and before("tab"):
            out.append(_with(base, kind="tab"))
            base = Run()
        if br and before("br", "cr"):
            out.append(_with(base, kind="br", target=kind_of_break))
            base = Run()
        if cr and before("br", "cr"):
            out.append(Run("br", target="textWrapping"))
        worded_run = overlay(_with(base, text=text), rpr, doc.fonts, True)
        for tag, sign in (("noBreakHyphen", "¬" if doc.compat else "\u2011"), ("softHyphen", "\xad")):
            if tag in order:
                return out + ([worded_run] if text else []) + [overlay(Run(text=sign), rpr, doc.fonts, True)], []
        for tag, kind in (("footnoteReference", "footnote"), ("endnoteReference", "endnote")):
            if (ref := r.find(W + tag)) is not None:
                return out + ([worded_run] if text else []) + [Run("note", target=kind, note_id=_int(ref, "", "id"))], []
        if not text:
            return out, []
        if state["shown"] and state["target"]:
            worded_run = _with(worded_run, kind="link", target=state["target"])
        out.append(worded_run)
        if tab and not before("tab"):
            out.append(overlay(Run("tab"), rpr, doc.fonts, True))
        if br and not before("br", "cr"):
            out.append(Run("br", target=kind_of_break))
        if cr and not before("br", "cr"):
            out.append(Run("br", target="textWrapping"))
        return out, []

    def _link(self, link) -> list[Run]:
        rid, anchor = link.get(R + "id", ""), _get(link, "", "anchor")
        target = self.doc.rels.get(rid, "") or (f"#{anchor}" if anchor else "") or _get(link, "", "id")
        out = []
        for r in link.findall(W + "r"):
            text, rpr = "".join(t.text or "" for t in r.findall(W + "t")), r.find(W + "rPr")
            u = _get(rpr, "u")
            like = Run("link", target=target, b=_on(rpr, "b"), i=_on(rpr, "i"), u="" if u == "none" else u, strike=_on(rpr, "strike") or _on(rpr, "dstrike"))
            after = []
            if r.find(W + "tab") is not None:
                after.append(_with(like, kind="tab"))
            if br := r.findall(W + "br"):
                after.append(_with(like, kind="br", target=_get(br[-1], "", "type") or "textWrapping"))
            if r.find(W + "cr") is not None:
                after.append(_with(like, kind="br", target="textWrapping"))
            out += ([_with(like, text=text)] if text else []) + after
        return out

    def _image(self, drawing) -> list[Run]:
        names = [W + "inline", W + "anchor"] + ([] if self.doc.compat else [WP + "inline", WP + "anchor"])
        place = next((e for name in names if (e := drawing.find(name)) is not None), None)
        pic = place.find(f"{A}graphic/{A}graphicData/{PIC}pic") if place is not None else None
        if pic is None:
            return []
        blip, about = pic.find(f"{PIC}blipFill/{A}blip"), place.find(WP + "docPr")
        embed = blip.get(R + "embed", "") if blip is not None else ""
        alt = (about.get(WP + "descr", "") or ("" if self.doc.compat else about.get("descr", ""))) if about is not None else ""
        size = place.find(WP + "extent")
        width, height = (int(size.get(k, "").strip() or 0) / EMU for k in ("cx", "cy")) if size is not None else (0.0, 0.0)
        return [Run("img", target=self.doc.rels.get(embed) or embed, alt=alt, width=width, height=height)]

    def table(self, e) -> Block:
        t, pr = Block("table"), e.find(W + "tblPr")
        if pr is not None:
            style = _get(pr, "tblStyle")
            t.style_name = self.doc.styles[style].name or style if style in self.doc.styles else style
            t.width, t.offset, t.cell_spacing = _inch(pr, "tblW", "w"), _inch(pr, "tblInd", "w"), _inch(pr, "tblCellSpacing", "w")
            t.align, t.caption, t.summary = _get(pr, "jc"), _get(pr, "tblCaption"), _get(pr, "tblDescription")
            t.borders = _borders(pr.find(W + "tblBorders"))
        t.grid = [_inch(c, "", "w") for c in e.findall(f"{W}tblGrid/{W}gridCol")]
        for row in e.findall(W + "tr"):
            t.rows.append((_on(row.find(W + "trPr"), "tblHeader"), [self._cell(c) for c in row.findall(W + "tc")]))
        _merge(t)
        return t

    def _cell(self, e) -> Cell:
        pr, cell = e.find(W + "tcPr"), Cell()
        if pr is not None:
            cell.span, cell.valign, cell.direction = _int(pr, "gridSpan"), _get(pr, "vAlign"), _get(pr, "textDirection")
            if (m := pr.find(W + "vMerge")) is not None:
                cell.merge = "restart" if _get(m, "") == "restart" else "continue"
            cell.no_wrap, cell.borders = _on(pr, "noWrap"), _borders(pr.find(W + "tcBorders"))
        cell.content = self.blocks(e)
        cell.lang = next((r.lang for b in cell.content if b.kind == "paragraph" for r in b.runs if r.lang), "")
        return cell


def _merge(table: Block) -> None:
    """A continuing cell joins the latest restart above it in its grid column. Of a row's
    restarts only the last can be joined."""
    open_at: dict[int, Cell] = {}
    for _, cells in table.rows:
        column, opened = 0, {}
        for cell in cells:
            if cell.merge == "restart":
                opened = {column: cell}
            elif cell.merge == "continue":
                if (above := open_at.get(column)) is not None:
                    above.row_span = max(above.row_span, 1) + 1
                    cell.omitted = True
                else:
                    cell.row_span = 2
            column += max(cell.span, 1)
        open_at |= opened


# --- parts ---------------------------------------------------------------------------------


def _theme(root) -> tuple[dict[str, str] | None, dict[str, str]]:
    face = lambda group, tag: (e.get("typeface", "") if (e := root.find(f"{A}themeElements/{A}fontScheme/{A}{group}/{A}{tag}")) is not None else "")
    color = lambda tag: (e.get("val", "") if (e := root.find(f"{A}themeElements/{A}clrScheme/{A}{tag}/{A}srgbClr")) is not None else "")
    out = {"font": face("minorFont", "latin"), "fontEA": face("minorFont", "ea"), "fontCS": face("minorFont", "cs"), "fg": color("dk1"), "bg": color("lt1")}
    if not out["font"] and not out["fg"]:
        return None, {}
    names = {"HAnsi": "latin", "Ascii": "latin", "EastAsia": "ea", "Bidi": "cs"}
    fonts = {size + name: face(f"{size}Font", tag) for size in ("minor", "major") for name, tag in names.items()}
    return out, {k: v for k, v in fonts.items() if v}


def _style(e, fonts: dict[str, str]) -> Style:
    s, rpr, ppr, table = Style(_get(e, "name"), _get(e, "", "type"), _get(e, "basedOn")), e.find(W + "rPr"), e.find(W + "pPr"), e.find(W + "tblPr")
    if rpr is not None:
        full = overlay(Run(), rpr, fonts, False)
        s.run = Run(font=full.font, ea=full.ea, cs=full.cs, size=full.size, size_cs=full.size_cs, color=full.color, b=full.b, i=full.i, u=full.u, strike=_on(rpr, "strike"), smallcaps=full.smallcaps, caps=full.caps)
    if ppr is not None:
        if ppr.find(W + "outlineLvl") is not None:
            s.heading = _int(ppr, "outlineLvl") + 1
        s.align, s.spacing, s.indent = _get(ppr, "jc"), _spacing(ppr.find(W + "spacing")) or s.spacing, _indent(ppr.find(W + "ind")) or s.indent
        s.tabs = _tabs(ppr.find(W + "tabs")) or []
    if table is not None:
        if (b := _borders(table.find(W + "tblBorders")).get("top")) is not None:
            s.border = (b[1] / 576.0, b[3], b[0])
        s.cell_spacing, s.width = _inch(table, "tblCellSpacing", "w"), _inch(table, "tblW", "w")
    s.heading = s.heading or heading_of(e.get(W + "styleId", ""))
    return s


def _numbering(root, doc: Document) -> None:
    kinds: dict[int, dict[int, Level]] = {}
    for e in root.findall(W + "abstractNum"):
        levels = kinds[_int(e, "", "abstractNumId")] = {}
        for lvl in e.findall(W + "lvl"):
            had = levels.setdefault(_int(lvl, "", "ilvl"), Level())
            had.fmt = _get(lvl, "numFmt") if lvl.find(W + "numFmt") is not None else had.fmt
            had.text = _get(lvl, "lvlText") if lvl.find(W + "lvlText") is not None else had.text
            had.start = _int(lvl, "start") if lvl.find(W + "start") is not None else had.start
            if lvl.find(f"{W}pPr/{W}ind") is not None:
                had.geometry = _inch(lvl, "pPr/ind", "left"), _inch(lvl, "pPr/ind", "hanging")
    for e in root.findall(W + "num"):
        num = _int(e, "", "numId")
        doc.abstract[num] = _int(e, "abstractNumId") if e.find(W + "abstractNumId") is not None else -1
        for k, level in kinds.get(doc.abstract[num], {}).items():
            doc.levels[num, k] = _with(level)
        for o in e.findall(W + "lvlOverride"):
            if o.find(W + "startOverride") is not None:
                level = doc.levels.setdefault((num, _int(o, "", "ilvl")), Level())
                level.start, level.override = _int(o, "startOverride"), True


#: So few elements cannot be nested too deeply for the walk below.
SHALLOW = 500


def _note_places(body) -> tuple[dict[int, int], dict[tuple[str, int], int]]:
    """Places of bookmarks and of the first reference to each note, counted over block
    starts at any depth; references in tracked changes do not count."""
    marks, refs, place = {}, {}, 0
    kinds = {W + "footnoteReference": "footnote", W + "endnoteReference": "endnote", W + "commentReference": "comment"}

    def walk(e, own: int | None, changed: bool) -> None:
        nonlocal place
        for c in e:
            mine = own
            if c.tag == W + "bookmarkStart":
                if (i := c.get(W + "id", "")).isdigit():
                    marks[int(i)] = place
                place += 1
            elif c.tag == W + "p":
                mine, place = place, place + 1
            elif c.tag in (W + "tbl", W + "sdt", W + "sectPr"):
                place += 1
            elif c.tag in kinds and own is not None and not changed and (i := c.get(W + "id", "")).isdigit():
                refs.setdefault((kinds[c.tag], int(i)), own)
            walk(c, mine, changed or c.tag in (W + "ins", W + "del"))

    walk(body, None, False)
    return marks, refs


def _root(parts: dict[str, bytes], kind: str):
    """Root of a part, None if it is absent or malformed."""
    try:
        return ElementTree.fromstring(parts[kind]) if kind in parts else None
    except ElementTree.ParseError:
        return None


_END, _ENTRY, _LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")


def _plain_parts(content: bytes) -> list[tuple[str, bytes]] | None:
    """Names and bytes of the parts that are read, in order, of an archive of the plainest kind:
    no comments, extra fields, encryption or 64-bit sizes, ASCII names, entries in the order of
    the directory, all sums right. None for any other, which zipfile reads or refuses."""
    end = len(content) - _END.size
    if end < 0:
        return None
    sign, disk, first_disk, here, count, size, at, comment = _END.unpack_from(content, end)
    if sign != b"PK\5\6" or disk or first_disk or here != count or comment or at + size != end:
        return None
    listed = []
    for _ in range(count):
        if at + _ENTRY.size > end:
            return None
        sign, _, version, flags, method, _, _, crc, packed, full, named, extra, comment, disk, _, _, local = _ENTRY.unpack_from(content, at)
        raw = content[at + _ENTRY.size : at + _ENTRY.size + named]
        if sign != b"PK\1\2" or version > 63 or flags & ~0x80E or method not in (0, 8) or extra or comment or disk or not raw.isascii() or b"\0" in raw or len(raw) != named:
            return None
        listed.append((raw, method, crc, packed, full, local))
        at += _ENTRY.size + named
    if at != end:
        return None
    found, stops = [], [*(x[-1] for x in listed[1:]), end - size]
    for (raw, method, crc, packed, full, local), stop in zip(listed, stops, strict=True):
        start = local + _LOCAL.size
        if start > stop:
            return None
        sign, *_, named, extra = _LOCAL.unpack_from(content, local)
        begin = start + named + extra
        if sign != b"PK\3\4" or content[start : start + named] != raw or begin + packed > stop:
            return None
        name = raw.decode().replace("\\", "/")
        if name in PARTS or _STORY.match(name):
            data = content[begin : begin + packed]
            if method:
                stream = zlib.decompressobj(-15)
                try:
                    data = stream.decompress(data, full + 1)
                except zlib.error:
                    return None
                if not stream.eof or stream.unused_data:
                    return None
            if len(data) != full or zlib.crc32(data) != crc:
                return None
            found.append((name, data))
    return found


def unpack(content: bytes) -> tuple[dict[str, bytes], dict[str, bytes]]:
    """Parts by what they hold, and header and footer parts by name."""
    known, stories = {}, {}
    if (plain := _plain_parts(content)) is not None:
        for name, data in plain:
            if name in PARTS:
                known[PARTS[name]] = data
            else:
                stories[name] = data
        return known, stories
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                name = info.filename.replace("\\", "/")
                if name in PARTS or _STORY.match(name):
                    try:
                        data = z.read(info)
                    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError):
                        continue
                    if name in PARTS:
                        known[PARTS[name]] = data
                    else:
                        stories[name] = data
    except (zipfile.BadZipFile, ValueError, TypeError) as e:
        raise PackageError(f"no ZIP file: {e}") from None
    return known, stories


def _core(root, doc: Document) -> None:
    names = {"title": DC, "creator": DC, "created": TERMS, "modified": TERMS, "keywords": CORE, "subject": DC, "description": DC}
    doc.meta = {k: root.findtext(ns + k) or "" for k, ns in names.items()}


def _set_theme(root, doc: Document) -> None:
    doc.theme, doc.fonts = _theme(root)


@functools.lru_cache(maxsize=32)
def _style_part(data: bytes, fonts: tuple[tuple[str, str], ...]) -> tuple[Run, dict[str, Style], dict[str, Resolved]]:
    """Defaults and styles of a part, and room for what paragraphs take from them. Packages made from
    one template have the same part, which a worker reads once: nothing of it may be changed."""
    root, fonts, default = ElementTree.fromstring(data), dict(fonts), Document("").default
    rpr = root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr")
    default = _with(default, **_fonts(rpr, fonts), color=_get(rpr, "color"))
    if rpr is not None and rpr.find(W + "sz") is not None:
        default.size = _int(rpr, "sz") / 2.0
    return default, {s.get(W + "styleId", ""): _style(s, fonts) for s in root.findall(W + "style")}, {}


#: Bytes of the largest styles part that a worker keeps.
KEPT_STYLES = 200_000


def _styles(data: bytes, doc: Document) -> None:
    read_part = _style_part if len(data) <= KEPT_STYLES else _style_part.__wrapped__
    doc.default, doc.styles, doc.resolved = read_part(data, tuple(doc.fonts.items()))


def _set_numbering(root, doc: Document) -> None:
    own = Document(doc.mode)
    _numbering(root, own)
    doc.levels, doc.abstract = own.levels, own.abstract


def _rels(root, doc: Document) -> None:
    for e in root:
        if e.tag.rpartition("}")[2] == "Relationship":
            target = e.get("Target", "")
            doc.rels[e.get("Id", "")] = target if target.startswith(("http://", "https://", "mailto:")) else f"word/{target}"


def _sections(body) -> list[dict[str, float]]:
    out = []
    for s in body.findall(W + "sectPr"):
        sizes = {k: _inch(s, "pgSz", k) for k in ("w", "h")} | {f"m{k[0]}": _inch(s, "pgMar", k) for k in ("top", "bottom", "left", "right", "header", "footer")}
        wide = _int(s, "cols", "num") > 1
        out.append(sizes | {"cols": _int(s, "cols", "num") if wide else 0, "space": _inch(s, "cols", "space") if wide else 0.0})
    return out


def _notes(root, kind: str, refs, reader: Reader) -> list[Note]:
    out = []
    for e in root.findall(W + kind):
        if kind == "comment" or _get(e, "", "type") in ("normal", ""):
            i = _int(e, "", "id")
            about = {"author": _get(e, "", "author"), "date": _get(e, "", "date")} if kind == "comment" else {}
            out.append(Note(kind, i, order=refs.get((kind, i), 0), body=reader.blocks(e, paragraphs_only=True), **about))
    return out


def _number(blocks: list[Block], tables: list[Block]) -> None:
    for b in blocks:
        if b.kind == "table":
            tables.append(b)
            b.id = len(tables)
            for _, cells in b.rows:
                for cell in cells:
                    _number(cell.content, tables)


def read(content: bytes, mode: str = "semantic", compat: bool = True) -> Document:
    """compat keeps known gaps: links and changes behind a paragraph's plain runs, a plain
    sign for the non-breaking hyphen, pictures and text boxes of DrawingML left out."""
    try:
        return _read(content, mode, compat)
    except RecursionError:
        raise PackageError("main part: nested too deeply") from None


def _read(content: bytes, mode: str, compat: bool) -> Document:
    parts, stories = unpack(content or b"")
    if "document" not in parts:
        raise PackageError("the package has no main part")
    try:
        main = ElementTree.fromstring(parts["document"])
    except ElementTree.ParseError as e:
        raise PackageError(f"main part: {e}") from None
    doc = Document(mode, compat=compat)
    for kind, load in (("core", _core), ("theme", _set_theme), ("styles", _styles), ("numbering", _set_numbering), ("rels", _rels)):
        if kind == "styles":
            with contextlib.suppress(ElementTree.ParseError, ValueError, OverflowError):
                if kind in parts:
                    load(parts[kind], doc)
        elif (root := _root(parts, kind)) is not None:
            with contextlib.suppress(ValueError, OverflowError):  # a number that is none: the part counts as absent
                load(root, doc)
    body = main.find(W + "body")
    body = ElementTree.Element(W + "body") if body is None else body
    reader = Reader(doc)
    for name in sorted(stories):
        try:
            story = reader.blocks(ElementTree.fromstring(stories[name]))
        except (ElementTree.ParseError, ValueError, OverflowError):
            continue
        (doc.headers if name.startswith("word/header") else doc.footers).append(story)
    noted = body.find(W + "bookmarkStart") is not None or any(f"{kind}s" in parts for kind in ("footnote", "endnote", "comment"))
    few = sum(1 for _ in body.iter()) <= SHALLOW  # else the walk also finds what is nested too deeply
    marks, refs = ({}, {}) if few and not noted else _note_places(body)
    for kind in ("footnote", "endnote", "comment"):
        if (root := _root(parts, f"{kind}s")) is not None:
            with contextlib.suppress(ValueError, OverflowError):
                doc.notes += _notes(root, kind, refs, reader)
    try:
        doc.sections, doc.body = _sections(body), reader.blocks(body, top=True)
        for e in body.findall(W + "bookmarkStart"):
            if name := _get(e, "", "name"):
                i = _int(e, "", "id")
                doc.notes.append(Note("bm", i, name, order=marks.get(i, -1)))
    except (ValueError, OverflowError) as e:  # a number that is none
        raise PackageError(f"main part: {e}") from None
    doc.notes.sort(key=lambda n: n.order)
    for story in (doc.body, *doc.headers, *doc.footers):
        _number(story, doc.tables)
    return doc
