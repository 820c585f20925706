"""A resolved document as compact XML: manifest, meta, styles, stories, body and notes."""

from __future__ import annotations

import re
from dataclasses import replace

from quire.sources.docx import Block, Cell, Document, Level, Note, Run

_CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84]")
#: Fixed values, as in functions.numbers.
BORDER_CODES = {"single": "s", "double": "d", "dashed": "ds", "dashSmallGap": "ds", "dotted": "dt", "none": "n", "nil": "n"}
PAGES = {
    "A3": (842, 1191), "A4": (595, 842), "A5": (420, 595), "A6": (298, 420), "B5": (516, 729), "Letter": (612, 792),
    "Legal": (612, 1008), "Tabloid": (792, 1224), "Executive": (540, 720), "Statement": (396, 612), "Folio": (612, 936),
}
#: Style ids that are never listed as custom.
BUILT_IN = {
    "Normal", "DefaultParagraphFont", *(f"Heading{k}" for k in range(1, 10)), "Title", "Subtitle", "Quote", "IntenseQuote", "BlockText",
    "ListParagraph", "ListBullet", "ListNumber", "Caption", "TOCHeading", "Hyperlink", "FootnoteText", "EndnoteText",
    "FootnoteReference", "EndnoteReference", "CommentText", "Header", "Footer",
}


def escape(s: str) -> str:
    return _CONTROLS.sub("", s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _num(x: float) -> str:
    return f"{x:.6f}" if x > 0 else ""


def _pt(x: float) -> str:
    return f"{x:.6f}".rstrip("0").removesuffix(".") + "pt" if x > 0 else ""


def attributes(pairs) -> str:
    """Attributes of the pairs that have a value."""
    return "".join(f' {k}="{escape(str(v))}"' for k, v in pairs if v)


def borders(sides: dict[str, tuple[str, int, int, str]]) -> str:
    return "; ".join(f"b{side[0]} {size / 576.0:.6f} {BORDER_CODES.get(style, 's')}{space} #{color}" for side, (style, size, space, color) in sides.items() if style not in ("", "none"))


def letters(n: int) -> str:
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(97 + k) + out
    return out


def roman(n: int) -> str:
    out = ""
    for unit, names in ((1000, "m"), (100, "cdm"), (10, "xlc"), (1, "ivx")):
        n, digit = n % unit, n // unit
        one, five, ten = names if len(names) == 3 else (names, "", "")
        out += one * digit if not five else ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten][digit]
    return out


def counter(n: int, fmt: str | None) -> str:
    n = max(n, 1)
    plain = {"lowerLetter": letters, "lowerRoman": roman, "upperLetter": lambda k: letters(k).upper(), "upperRoman": lambda k: roman(k).upper(), "decimalZero": "{:02d}".format, "bullet": lambda k: ""}
    return plain.get(fmt or "", str)(n)


class Renderer:
    def __init__(self, doc: Document):
        self.doc, self.out = doc, []
        self.next: dict[tuple[int, int], int] = {}  # the running counters of lists

    # --- inline ---------------------------------------------------------------------------

    def inline(self, runs: list[Run], code: bool = False) -> str:
        return "".join(self._atom(r, code) for r in runs if self.doc.mode == "lossless" or r.deleted is None)

    def _atom(self, r: Run, code: bool) -> str:
        match r.kind:
            case "tab":
                core = "\t" if code else "<tab/>"
            case "br":
                core = "\n" if code else f'<br type="{escape(r.target)}"/>'
            case "note":
                core = f'<fn-ref id="{r.note_id}" type="{r.target}"/>'
            case "link":
                core = escape(r.text)
                for tag, on in (("b", r.b), ("i", r.i), ("u", r.u), ("s", r.strike)):
                    core = f"<{tag}>{core}</{tag}>" if on else core
                core = f'<a href="{escape(r.target)}">{core}</a>'
            case "img":
                core = f"<img{attributes([('alt', r.alt)])}/>"
            case "sym":
                try:
                    core = chr(int(r.target, 16))
                except (ValueError, OverflowError):
                    core = ""
            case _:
                if not r.text:
                    return ""
                core = escape(r.text) if code else self._marked(r)
        if self.doc.mode == "lossless":
            for tag, who in (("ins", r.inserted), ("del", r.deleted)):
                if who is not None:
                    core = f"<{tag}{attributes([('author', who[0]), ('date', who[1])])}>{core}</{tag}>"
        return core

    def _marked(self, r: Run) -> str:
        d = self.doc.default
        unless = lambda x, usual: "" if x == usual else x
        span = attributes([
            ("font", unless(r.font, d.font)), ("fontEA", unless(r.ea, d.ea)), ("fontCS", unless(r.cs, d.cs)),
            ("size", _pt(r.size) if r.size != d.size else ""), ("sizeCS", _pt(r.size_cs) if r.size_cs != d.size_cs else ""),
            ("color", unless(r.color, d.color).removeprefix("#")), ("highlight", unless(r.highlight, "none")), ("lang", r.lang),
            ("hidden", "true" if r.hidden else ""), ("dir", "rtl" if r.rtl else ""),
        ])
        other_cs = r.cs not in ("", r.font)
        marks = (
            ("smallcaps", r.smallcaps), ("uppercase", r.caps), ("b", r.b), ("bcs", r.bcs and not r.b and other_cs), ("i", r.i),
            ("ics", r.ics and not r.i and other_cs), ("u", r.u), ("s", r.strike), ("sup", r.vert == "superscript"), ("sub", r.vert == "subscript"),
        )
        core = escape(r.text)
        core = f"<span{span}>{core}</span>" if span else core
        for tag, on in marks:
            core = f"<{tag}>{core}</{tag}>" if on else core
        return core

    # --- blocks -----------------------------------------------------------------------------

    def block_attributes(self, b: Block) -> str:
        m, (left, right, first, hanging), (before, after, line, rule) = b.more, b.indent, b.spacing
        stop = lambda t: f"{t[0]:.6f}" + ("" if t[1:] == ("left", "none") else f"@{t[1]}" + (f":{t[2]}" if t[2] != "none" else ""))
        further = ("suppressAutoHyph", "snapToGrid", "kinsoku", "wordWrap", "overflowPunct", "topLinePunct", "autoSpaceDE", "autoSpaceDN", "textDirection", "suppressOverlap", "divID")
        return attributes([
            ("c", _custom_name(b)), ("align", b.align if b.align != "left" else ""),
            ("indentLeft", _num(left)), ("indentHanging", _num(hanging)), ("indentRight", _num(right)), ("indentFirst", _num(first)),
            ("tabs", " ".join(map(stop, b.tabs))),
            ("spacingBefore", _num(before)), ("spacingAfter", _num(after)), ("lineSpacing", _num(line)), ("lineRule", rule if rule != "auto" else ""),
            ("dir", m.get("dir")), ("lang", b.lang), ("valign", m.get("valign")), ("shd", m.get("shd")),
            *((k, m.get(k)) for k in ("keepNext", "keepLines", "widowControl", "sectionBreak")),
            ("revisionAuthor", m.get("revisionAuthor")), ("revisionDate", m.get("revisionDate")),
            *((k, m.get(k)) for k in further), ("cnfStyle", m.get("cnfStyle")), ("frame", m.get("frame")), ("at", borders(b.borders)),
        ])

    def paragraph(self, b: Block, pad: str) -> None:
        if b.code:
            self.out.append(f"{pad}<pre>{self.inline(b.runs, True)}</pre>\n")
            return
        tag = f"h{b.heading}" if 0 < b.heading <= 9 else "blockquote" if b.quote else "p"
        self.out.append(f"{pad}<{tag}{self.block_attributes(b)}>{self.inline(b.runs)}</{tag}>\n")

    def block(self, b: Block, pad: str) -> None:
        """A block outside the body, where each list item is a list of its own."""
        if b.kind == "table":
            self.table(b, pad)
        elif b.kind == "paragraph":
            self.paragraph(b, pad)
        else:
            tag, _, opening = self._list_opening(b)
            number = self.next.get((b.num_id, b.level), 0) or self._start(b)
            self.out.append(f"{pad}<{opening}>\n{pad}  {self._item_tag(b, number)}\n")
            self._first_paragraph(b, pad + "    ")
            self.out.append(f"{pad}  </li>\n{pad}</{tag}>\n")

    def table(self, t: Block, pad: str) -> None:
        about = attributes([("c", t.style_name), ("width", _num(t.width)), ("align", t.align), ("indent", _num(t.offset)), ("cellSpacing", _num(t.cell_spacing)), ("caption", t.caption), ("summary", t.summary), ("at", borders(t.borders))])
        self.out.append(f'{pad}<table id="{t.id}"{about}>\n')
        for header, cells in t.rows:
            self.out.append(f"{pad}  <tr>\n")
            for cell in cells:
                if not cell.omitted:
                    self._cell(cell, "th" if header else "td", pad)
            self.out.append(f"{pad}  </tr>\n")
        self.out.append(f"{pad}</table>\n")

    def _cell(self, c: Cell, tag: str, pad: str) -> None:
        spans = [("colspan", c.span if c.span > 1 else ""), ("rowspan", c.row_span if c.row_span > 1 else "")]
        about = attributes([*spans, ("valign", c.valign), ("textDir", c.direction), ("lang", c.lang), ("noWrap", "true" if c.no_wrap else ""), ("at", borders(c.borders))])
        self.out.append(f"{pad}    <{tag}{about}>")
        for b in c.content:
            if b.kind == "table":
                self.table(b, pad + "    ")
            elif b.kind == "paragraph":
                self.out.append(self.inline(b.runs))
            else:
                left, right, first, hanging = b.indent
                if left <= 0 and hanging <= 0:
                    left, hanging = self._level(b).geometry or (left, hanging)
                if left <= 0 < hanging:
                    left = hanging
                name, kind, _ = self._list_opening(b)
                own = replace(b, indent=(left, right, first, hanging))
                self.out.append(f'<{name} type="{kind}"><li><p{self.block_attributes(own)}>{self.inline(b.runs)}</p></li></{name}>')
        self.out.append(f"</{tag}>\n")

    # --- lists --------------------------------------------------------------------------------

    def _level(self, b: Block) -> Level:
        return self.doc.levels.get((b.num_id, b.level)) or Level()

    def _start(self, b: Block) -> int:
        start = self._level(b).start or 0
        return start if start > 0 else 1

    def _list_opening(self, b: Block, start: int = 0) -> tuple[str, str, str]:
        """Tag, type, and the opening tag's inside."""
        level = self._level(b)
        ordered = level.fmt not in (None, "", "bullet")
        tag = "ol" if ordered else "ul"
        kind = level.fmt if ordered else (level.text or "bullet") if level.fmt == "bullet" else "bullet"
        about = attributes([("start", start if ordered and start > 1 else ""), ("format", level.text if level.text and "%" in level.text else "")])
        return tag, escape(kind), f'{tag} type="{escape(kind)}"{about}'

    def _seed(self, b: Block) -> int:
        """The number a list group starts at; its counter is set unless it runs already."""
        key = b.num_id, b.level
        if self._level(b).override or self.next.get(key, 0) <= 0:
            self.next[key] = self._start(b)
        return self.next[key]

    def _item_tag(self, b: Block, number: int) -> str:
        template, marker = self._level(b).text, ""
        for piece in re.split(r"(%\d+)", template or ""):
            k = int(piece[1:]) - 1 if re.fullmatch(r"%\d+", piece) else -1
            if k < 0:
                marker += "" if re.fullmatch(r"%0+", piece) else piece
                continue
            other = self.doc.levels.get((b.num_id, k)) or Level()
            value = number if k == b.level else self.next.get((b.num_id, k), 0)
            marker += counter(value if k == b.level or value > 0 else max(other.start or 0, 0) or 1, other.fmt)
        return f'<li marker="{escape(marker)}">' if marker else "<li>"

    def _first_paragraph(self, b: Block, pad: str) -> None:
        """An item's own paragraph; its marker's geometry comes from the level."""
        left, right, first, hanging = b.indent
        level_left, level_hanging = self._level(b).geometry or (0.0, 0.0)
        left = left if left > 0 else level_left
        if level_left > 0 or level_hanging > 0:
            hanging = max(left - max(level_left - level_hanging, 0.0), 0.0)
        if left <= 0 < hanging:
            left = hanging
        own = replace(b, indent=(left, right, first, hanging))
        self.out.append(f"{pad}<p{self.block_attributes(own)}>{self.inline(b.runs)}</p>\n")

    def _comes_again(self, at: int, num_id: int) -> bool:
        """Whether the next list item is of this list, near enough and before any heading."""
        for k, b in enumerate(self.doc.body[at : at + 52]):
            if b.kind == "list":
                return b.num_id == num_id
            if b.kind == "paragraph" and b.heading > 0 or k > 50:
                return False
        return False

    def body(self) -> None:
        at = 0
        while at < len(self.doc.body):
            b = self.doc.body[at]
            if b.kind == "list":
                start = self._seed(b) if self._list_opening(b)[0] == "ol" else 0
                tag, _, opening = self._list_opening(b, start)
                self.out.append(f"    <{opening}>\n")
                at = self._items(at, b.num_id, b.level, "      ")
                self.out.append(f"    </{tag}>\n")
            else:
                self.block(b, "    ")
                at += 1

    def _items(self, at: int, num_id: int, level: int, pad: str) -> int:
        """Items of one level from `at` on; returns where the list ends."""
        first, body = at, self.doc.body
        while at < len(body):
            b = body[at]
            if b.kind != "list" or b.num_id != num_id:
                if not self._comes_again(at, num_id):
                    break
                if b.kind == "table":
                    self.table(b, "")
                at += 1
            elif b.level != level or at != first and self._level(b).override:
                break
            else:
                at = self._item(at, num_id, level, pad)
        return at

    def _item(self, at: int, num_id: int, level: int, pad: str) -> int:
        b, body, key = self.doc.body[at], self.doc.body, (num_id, level)
        self.out.append(f"{pad}{self._item_tag(b, self.next.get(key, 0))}\n")
        self._first_paragraph(b, pad + "  ")
        at += 1
        while at < len(body) and body[at].kind == "paragraph" and body[at].heading <= 0:
            if _ends_section(body[at]) and not self._comes_again(at, num_id):
                break
            self.out.append(f"{pad}  <p{self.block_attributes(body[at])}>{self.inline(body[at].runs)}</p>\n")
            at += 1
        while at < len(body) and body[at].kind == "list" and body[at].num_id == num_id and body[at].level > level:
            nested = body[at]
            ordered = self._list_opening(nested)[0] == "ol"
            tag, _, opening = self._list_opening(nested, self._start(nested) if ordered else 0)
            if ordered:
                self._seed(nested)
            self.out.append(f"<{opening}>\n")
            at = self._items(at, num_id, nested.level, pad + "    ")
            self.out.append(f"</{tag}>")
        self.next[key] = self.next.get(key, 0) + 1
        self.out.append(f"{pad}</li>\n")
        return at

    # --- styles and the whole ------------------------------------------------------------------

    def styles(self) -> None:
        doc, put = self.doc, self.out.append
        put('  <style unit="in">\n')
        for s in doc.sections:
            if s["w"] <= 0 and s["h"] <= 0:
                continue
            size = int(s["w"] * 72), int(s["h"] * 72)
            preset = next((name for name, (w, h) in PAGES.items() if size in ((w, h), (h, w))), "")
            sides = "".join(f' {k}="{s[k]:.6f}"' for k in ("mt", "mb", "ml", "mr", "mh", "mf"))
            whole = f' size="{preset}"' if preset else f' w="{s["w"]:.6f}" h="{s["h"]:.6f}"'
            put(f"    <s:page{whole}{sides}/>\n")
            if s["cols"] > 1:
                put(f'    <s:cols n="{s["cols"]}"{attributes([("space", _num(s["space"]))])}/>\n')
        heads = [(name, doc.styles[name]) for k in range(1, 10) if (name := f"Heading{k}") in doc.styles]
        normal = [("", doc.styles["Normal"])] if "Normal" in doc.styles else []
        for name, s in heads + normal:
            gap = attributes([("c", name), ("before", _num(s.spacing[0])), ("after", _num(s.spacing[1]))])
            if max(s.spacing[:2]) > 0:
                put(f'    <s:gap el="{"h" if name else "p"}"{gap}/>\n')
        for name, s in normal + heads:
            of = attributes([("c", name)])
            if max(s.indent) > 0:
                left, right, first, hanging = map(_num, s.indent)
                put(f'    <s:indent el="p"{of}{attributes([("left", left), ("right", right), ("firstLine", first), ("hanging", hanging)])}/>\n')
            if s.align:
                put(f'    <s:align el="p"{of} value="{escape(s.align)}"/>\n')
            if s.spacing[2] > 0:
                put(f'    <s:line el="p"{of} value="{s.spacing[2]:.6f}"{attributes([("rule", s.spacing[3])])}/>\n')
        for t in doc.tables:
            self.out += [f'    <s:col ref="{t.id}" w="{w:.6f}"/>\n' for w in t.grid]
        element = lambda heading: f"h{heading}" if heading > 0 else "p"
        stops = [(b.heading, b.tabs) for story in (doc.body, *doc.headers, *doc.footers) for b in story if b.kind == "paragraph"]
        stops += [(s.heading, s.tabs) for _, s in sorted(doc.styles.items())]
        lines = [f'    <s:tab el="{element(h)}" pos="{pos:.6f}" align="{escape(align)}" leader="{escape(leader)}"/>\n' for h, tabs in stops for pos, align, leader in tabs]
        self.out += dict.fromkeys(lines)
        for key, s in sorted(doc.styles.items()):
            name = s.name or key
            if key in BUILT_IN or name in ("Normal", "Default Paragraph Font"):
                continue
            r, yes, (before, after, line, rule), (left, right, first, hanging) = s.run, lambda on: "true" if on else "", s.spacing, s.indent
            put("    <s:custom" + attributes([
                ("name", name), ("type", s.type), ("basedOn", s.based_on), ("font", r.font), ("fontEA", r.ea), ("fontCS", r.cs),
                ("size", _pt(r.size)), ("sizeCS", _pt(r.size_cs)), ("color", r.color.removeprefix("#")), ("bold", yes(r.b)), ("italic", yes(r.i)), ("underline", r.u),
                ("strikethrough", yes(r.strike)), ("smallCaps", yes(r.smallcaps)), ("uppercase", yes(r.caps)), ("alignment", s.align),
                ("spacingBefore", _num(before)), ("spacingAfter", _num(after)), ("lineSpacing", _num(line)), ("lineRule", rule),
                ("indentLeft", _num(left)), ("indentRight", _num(right)), ("indentFirst", _num(first)), ("indentHanging", _num(hanging)),
                ("borderWidth", _num(s.border[0])), ("borderColor", s.border[1].removeprefix("#")), ("borderStyle", s.border[2]),
                ("cellSpacing", _num(s.cell_spacing)), ("width", _num(s.width)),
            ]) + "/>\n")
        if doc.theme is not None:
            put("    <s:theme" + attributes(doc.theme.items()) + "/>\n")
        own = [b for b in doc.body if b.kind == "paragraph" and b.align and (b.style_id not in doc.styles or doc.styles[b.style_id].align != b.align)]
        self.out += dict.fromkeys(f'    <s:align el="{element(b.heading)}" value="{escape(b.align)}"/>\n' for b in own)
        put("  </style>\n")

    def note(self, n: Note) -> None:
        put = self.out.append
        if n.type == "bm":
            put(f'    <bm id="{escape(n.name)}"/>\n')
            return
        if n.type == "comment":
            put(f'    <comment id="{n.id}"{attributes([("author", n.author), ("date", n.date)])}>')
        else:
            put(f'    <fn id="{n.id}" type="{n.type}"' + (">\n" if n.body else "/>\n"))
        for b in n.body:
            self.block(b, "    ")
            if b.kind == "paragraph" and n.type != "comment":
                put("\n")
        if n.type == "comment":
            put("</comment>\n")
        elif n.body:
            put("    </fn>\n")

    def render(self) -> str:
        doc, put = self.doc, self.out.append
        put(f'<words xmlns="urn:words:v1" xmlns:s="urn:words:v1:style" version="1.2.0" mode="{doc.mode or "semantic"}" fidelity="verbatim" policy="preserve-and-flag">\n')
        names = (("title", "title"), ("author", "creator"), ("created", "created"), ("modified", "modified"), ("keywords", "keywords"))
        meta = [f"    <{tag}>{escape(doc.meta[k])}</{tag}>\n" for tag, k in names if doc.meta.get(k)]
        self.out += ["  <meta>\n", *meta, "  </meta>\n"] if meta else []
        self.styles()
        for tag, stories in (("header", doc.headers), ("footer", doc.footers)):
            for k, story in enumerate(stories, 1):
                put(f'  <{tag} id="{k}">\n')
                for b in story:
                    self.block(b, "    ")
                put(f"  </{tag}>\n")
        put("  <write>\n")
        self.body()
        put("  </write>\n")
        if doc.notes:
            put("  <notes>\n")
            for n in doc.notes:
                self.note(n)
            put("  </notes>\n")
        put("</words>\n")
        return "".join(self.out)


def _custom_name(b: Block) -> str:
    """Style name worth writing: none for the styles that the tag already tells."""
    name = b.style_name.strip().lower()
    if b.heading > 0:
        usual = (f"heading {b.heading}", "title", "subtitle")
    elif b.quote:
        usual = ("quote", "intense quote", "blocktext", "block text")
    else:
        usual = ("normal", "default paragraph font", "list paragraph")
    return "" if name in usual else b.style_name


def _ends_section(b: Block) -> bool:
    text = b.plain.strip()
    return bool(b.runs) and (not text or text.startswith(("--------", "------ ")) or b.heading > 0)


def render(doc: Document) -> str:
    return Renderer(doc).render()
