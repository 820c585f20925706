"""Rules of the rendered XML: errors make it invalid, warnings do not. The texts of both are fixed values."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field


@dataclass
class Node:
    name: str
    attrs: dict[str, str]
    children: list[Node] = field(default_factory=list)
    closed: bool = False


def _integer(v: str) -> bool:
    return v.lstrip("+-").isdigit() and v.isascii() and len(v) - len(v.lstrip("+-")) <= 1


def _number(v: str) -> bool:
    try:
        float(v)
    except ValueError:
        return False
    return v == v.strip() and "_" not in v


def _points(v: str) -> bool:
    return v.endswith("pt") and _number(v[:-2])


def _stops(v: str) -> bool:
    return all(_number(stop.partition("@")[0]) for stop in v.split())


#: What attributes may hold.
HEADINGS = tuple(f"h{k}" for k in range(1, 10))
MARKS = ("b", "i", "u", "s", "sup", "sub", "smallcaps", "uppercase", "hidden", "bcs", "ics")
TRUE_ONLY = ("keepNext", "keepLines", "widowControl", "suppressAutoHyph", "snapToGrid", "kinsoku", "wordWrap", "overflowPunct", "topLinePunct", "autoSpaceDE", "autoSpaceDN", "suppressOverlap")
NUMBERS = ("indentLeft", "indentHanging", "indentRight", "indentFirst", "spacingBefore", "spacingAfter", "lineSpacing")
CHOICES = {
    "dir": "ltr|rtl", "align": "center|both|right", "lineRule": "auto|exact|atLeast", "valign": "top|center|bottom|baseline",
    "sectionBreak": "nextPage|continuous|evenPage|oddPage", "textDirection": "lr|rl|lrV|rlV|vert|vertR|of|on",
}
RULES = (
    {k: (v, lambda x, v=v: x in v.split("|")) for k, v in CHOICES.items()}
    | {k: ("true", "true".__eq__) for k in TRUE_ONLY}
    | {k: ("number", _number) for k in NUMBERS}
    | {k: ("a number followed by pt (e.g., 11pt)", _points) for k in ("size", "sizeCS")}
    | {"divID": ("number", _integer), "tabs": ("space-separated stops (pos or pos@align[:leader])", _stops)}
)
TABLE_RULES = {"id": ("integer", _integer), "width": ("number", _number), "align": ("left|center|right", lambda v: v in ("left", "center", "right")), "cellSpacing": ("number", _number)}
CELL_RULES = {"colspan": ("integer", _integer), "rowspan": ("integer", _integer), "valign": ("top|center|bottom", lambda v: v in ("top", "center", "bottom")), "noWrap": ("true|false", lambda v: v in ("true", "false"))}
META = ("title", "author", "created", "modified", "keywords", "subject", "description")
STYLE = ("page", "gap", "custom", "col", "cols", "align", "line", "tab", "theme", "indent")
NOT_ON_ITEMS = ("indentLeft", "indentRight", "indentFirst", "indentHanging", "spacingBefore", "spacingAfter", "lineSpacing", "lineRule", "align", "keepNext", "keepLines", "widowControl", "shd", "at", "tabs")


_TOKEN = re.compile(r"<!--(?P<comment>.*?)-->|<!\[CDATA\[.*?\]\]>|<\?(?P<pi>.*?)\?>|<!(?P<directive>[^>]*)>|</(?P<end>[^\s>]+)\s*>|<(?P<start>[^\s/>!?][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>|(?P<bad><)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _tree(xml: str) -> tuple[list[Node | str], str | None]:
    """Top-level nodes (text and other tokens as strings) up to the first parse error.

    Not strict: values may stand without quotes, or be left out; signs that are no known
    entity are text; an end tag closes what is open within its element.
    """
    top, stack = [], []
    for m in _TOKEN.finditer(xml):
        kind = m.lastgroup if m["bad"] is None else "bad"
        if m["start"] is not None:
            pairs = [(k, html.unescape(quoted or single or bare or ("" if "=" in whole else k))) for whole, k, quoted, single, bare in ((a[0], *(x or "" for x in a.groups())) for a in _ATTRIBUTE.finditer(m["attrs"]))]
            node = Node(m["start"].rpartition(":")[2], {k if k == "xmlns" else k.rpartition(":")[2]: v for k, v in reversed(pairs)}, closed=bool(m["empty"]))
            (stack[-1].children if stack else top).append(node)
            if not m["empty"]:
                stack.append(node)
        elif m["end"] is not None:
            name = m["end"].rpartition(":")[2]
            if all(n.name != name for n in stack):
                return top, f"unexpected end element </{m['end']}>"
            while stack:
                n = stack.pop()
                n.closed = True
                if n.name == name:
                    break
        elif kind == "bad":
            return top, "a tag is not closed"
        elif not stack and (m["comment"] is not None or m["pi"] is not None):
            top.append("comment" if m["comment"] is not None else "declaration")
    return top, "unexpected end of input" if stack else None


class Verifier:
    def __init__(self):
        self.errors: list[str] = []
        self.warns: list[str] = []

    def check(self, xml: str) -> Verifier:
        if not (xml or "").strip():
            self.errors.append("empty input")
            return self
        top, failure = _tree(xml)
        if failure:
            self.errors.append(f"XML parse error: {failure}")
        if not top:
            self.errors.append("no XML tokens found")
            return self
        root = top[0]
        if not isinstance(root, Node):
            self.errors.append(f"root element must be <words>, got {root}")
            root = next((n for n in top if isinstance(n, Node)), Node("", {}))
        else:
            self._root(root)
        self._sections(root)
        return self

    def _root(self, n: Node) -> None:
        if n.name != "words":
            self.errors.append(f"root element must be <words>, got <{n.name}>")
        if n.attrs.get("xmlns") != "urn:words:v1":
            self.errors.append('missing xmlns="urn:words:v1"')
        for name, allowed in (("version", ("1.2.0",)), ("mode", ("semantic", "lossless")), ("fidelity", ("verbatim",)), ("policy", ("preserve-and-flag",))):
            got = n.attrs.get(name, "")
            if not got:
                (self.warns if name == "mode" else self.errors).append(f"missing {name} attribute on <words>")
            elif got not in allowed:
                self.errors.append(f"{name} must be {' or '.join(map(_quoted, allowed))}, got {_quoted(got)}")

    def _sections(self, root: Node) -> None:
        seen = set()

        def walk(parent: Node) -> None:
            for n in parent.children:
                if n.name in ("meta", "style", "write", "notes"):
                    if n.name in seen:
                        self.errors.append(f"duplicate <{n.name}> element")
                    seen.add(n.name)
                    getattr(self, f"_{n.name}")(n)
                elif n.name in ("header", "footer"):
                    self._numbered(n)
                else:
                    self.warns.append(f"unexpected top-level element <{n.name}>")
                    walk(n)  # what is known within it counts

        walk(root)
        if "write" not in seen:
            self.errors.append("missing required <write> element")
        if "style" not in seen:
            self.warns.append("missing <style> element")

    def _open(self, n: Node) -> bool:
        """Whether n has no end; then nothing within it is looked at."""
        if not n.closed:
            self.errors.append(f"<{n.name}> has no matching end tag")
        return not n.closed

    def _rules(self, n: Node, rules: dict, name: str | None = None) -> None:
        for k, v in n.attrs.items():
            if k in rules and not rules[k][1](v):
                self.errors.append(f"<{name or n.name}> {k} must be {rules[k][0]}, got {_quoted(v)}")
            if k == "valign" and v == "bottom" and rules is RULES and name == "p":
                self.errors.append(f"<p> valign must not be bottom (only top|center|baseline), got {_quoted(v)}")

    def _meta(self, n: Node) -> None:
        if not self._open(n):
            self.warns += [f"unknown <meta> child <{c.name}>" for c in _all(n) if c.name not in META]

    def _style(self, n: Node) -> None:
        unit = n.attrs.get("unit", "")
        if not unit:
            self.warns.append("<style> missing unit attribute")
        elif unit not in ("in", "cm", "pt", "px", "mm"):
            self.warns.append(f"<style> unit must be in|cm|pt|px|mm, got {_quoted(unit)}")
        if self._open(n):
            return
        for c in _all(n):
            if c.name not in STYLE:
                self.warns.append(f"unknown element <{c.name}> inside <style>")
            if c.name == "custom":
                self._rules(c, {k: RULES[k] for k in ("size", "sizeCS")}, "s:custom")

    def _write(self, n: Node) -> None:
        if not self._open(n):
            self._blocks(n, "write")

    def _notes(self, n: Node) -> None:
        if self._open(n):
            return
        for c in n.children:
            if c.name not in ("fn", "bm", "comment"):
                self.warns.append(f"unknown element <{c.name}> inside <notes>")
                continue
            if "id" not in c.attrs:
                self.errors.append(f"<{c.name}> missing required id attribute")
            if not self._open(c):
                self._blocks(c, c.name)

    def _numbered(self, n: Node) -> None:
        if "id" not in n.attrs:
            self.errors.append(f"<{n.name}> missing required id attribute")
        elif not _integer(n.attrs["id"]):
            self.errors.append(f"<{n.name}> id must be integer, got {_quoted(n.attrs['id'])}")
        if not self._open(n):
            self._blocks(n, n.name)

    def _blocks(self, parent: Node, context: str) -> None:
        for n in parent.children:
            if n.name == "p" or n.name in HEADINGS:
                self._rules(n, RULES, "p")
                if not self._open(n):
                    self._inline(n, n.name)
            elif n.name == "table":
                self._table(n)
            elif n.name in ("ul", "ol"):
                self._list(n)
            elif n.name == "pre":
                if not self._open(n):
                    self.warns += [f"unexpected element <{c.name}> inside <pre>" for c in _all(n)]
            elif n.name in ("blockquote", "figure"):
                if not self._open(n):
                    self._blocks(n, n.name)
            elif not self._atom(n) and n.name not in ("figcaption", "hr", "ins", "del"):
                self.warns.append(f"unknown element <{n.name}> in {context}")
                self._blocks(n, context)
            else:
                self._blocks(n, context)

    def _inline(self, parent: Node, context: str) -> None:
        for n in _all(parent):
            if not self._atom(n):
                self.warns.append(f"unknown inline element <{n.name}> in <{context}>")

    def _atom(self, n: Node) -> bool:
        """Check an inline element; whether it is one."""
        if n.name in MARKS or n.name == "span":
            self._rules(n, RULES)
        elif n.name == "a":
            if "href" not in n.attrs:
                self.errors.append("<a> missing required href attribute")
            elif not n.attrs["href"]:
                self.errors.append("<a> href must not be empty")
        elif n.name == "img":
            self.errors += [f"<img> must not have {k} attribute (only alt is allowed)" for k in n.attrs if k in ("src", "width", "height")]
            if "alt" not in n.attrs:
                self.errors.append("<img> missing required alt attribute")
        elif n.name == "br":
            kind = n.attrs.get("type")
            if kind is None:
                self.errors.append("<br> missing required type attribute")
            elif kind not in ("page", "textWrapping", "column", "clear"):
                self.errors.append(f"<br> type must be page|textWrapping|column|clear, got {_quoted(kind)}")
        else:
            return n.name in ("fn-ref", "bm", "tab", "sym")
        return True

    def _table(self, n: Node) -> None:
        self._rules(n, TABLE_RULES)
        if self._open(n):
            return
        for row in n.children:
            if row.name == "colspec":
                self.errors.append("<colspec> is not valid inside <table>; use <s:col> in <style> instead")
            elif row.name != "tr":
                self.warns.append(f"unexpected element <{row.name}> inside <table>")
            else:
                self._rules(row, {"span": ("integer", _integer)})
                if self._open(row):
                    continue
                cells = [c for c in row.children if c.name in ("td", "th")]
                for c in cells:
                    self._rules(c, CELL_RULES)
                    if not self._open(c):
                        self._blocks(c, c.name)
                if not cells:
                    self.errors.append("<tr> must contain at least one <td> or <th>")

    def _list(self, n: Node) -> None:
        if self._open(n):
            return
        for item in n.children:
            if item.name != "li":
                self.warns.append(f"unexpected element <{item.name}> inside <{n.name}>")
                continue
            self.warns += [f"<li> must not carry block attribute {k}: put it on the first <p> child" for k in item.attrs if k in NOT_ON_ITEMS]
            if not self._open(item):
                self._blocks(item, "li")
        if not any(c.name == "li" for c in n.children):
            self.errors.append(f"<{n.name}> must contain at least one <li>")


def _all(n: Node):
    for c in n.children:
        yield c
        yield from _all(c)


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def verify(xml: str) -> tuple[bool, list[str], list[str]]:
    """valid, errors, warnings."""
    v = Verifier().check(xml)
    return not v.errors, v.errors, v.warns
