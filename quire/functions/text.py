"""Scalar text functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.operators.render import BUILT_IN


def normalize_whitespace(s: Column) -> Column:
    """Line ends as \\n, tabs as spaces, runs of spaces as one, no line ends in front, no
    line ends or spaces behind. Null stays null."""
    s = F.regexp_replace(s, r"\r\n?", "\n")
    s = F.regexp_replace(F.regexp_replace(s, "\t", " "), " +", " ")
    return F.regexp_replace(F.regexp_replace(s, r"\A\n+", ""), r"[\n ]+\z", "")


def strip_controls(s: Column) -> Column:
    return F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x84]", "")


def xml_escape(s: Column) -> Column:
    """Control characters dropped, then the four entities; the ampersand comes first."""
    s = strip_controls(s)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(sign), F.lit(entity))
    return s


def word_at_boundary(s: Column, word: str) -> Column:
    """Whether the first occurrence of word stands between ends, spaces, hyphens or underscores."""
    at = F.instr(s, word)
    edge = lambda c: (c == "") | c.isin(" ", "-", "_")
    before = F.when(at > 1, F.substr(s, at - 1, F.lit(1))).otherwise("")
    after = F.substr(s, at + len(word), F.lit(1))
    return (at > 0) & edge(before) & edge(after)


#: Fonts that are monospaced by name.
MONOSPACE = ("courier new", "courier", "consolas", "lucida console", "menlo", "monaco", "monospace")


def is_monospace(font: Column) -> Column:
    f = F.lower(F.trim(font))
    return f.isin(*MONOSPACE) | f.rlike("mono|courier")


def heading_level(style_id: Column) -> Column:
    """Heading level a style id names, 0 if none."""
    s = F.lower(style_id)
    digit = F.regexp_extract(s, r"^heading\+?0*([1-9])$", 1)
    return F.when(digit != "", digit.cast("int")).when(s.isin("title", "heading"), 1).when(s == "subtitle", 2).otherwise(0)


def demoted(level: Column, text: Column, align: Column) -> Column:
    """A heading of more than 60 UTF-8 bytes, or one set justified, is none."""
    long = (F.octet_length(text) > 60) | F.coalesce(align == "both", F.lit(False))
    return F.when((level > 0) & long, 0).otherwise(level)


def is_section_break(text: Column, level: Column, has_runs: Column) -> Column:
    t = F.trim(F.translate(text, "\n\t\r", "   "))
    return has_runs & ((t == "") | t.startswith("--------") | t.startswith("------ ") | (level > 0))


def hyperlink_target(instruction: Column) -> Column:
    """Target of a HYPERLINK field instruction, null if it has none."""
    s = F.trim(instruction)
    rest = F.trim(F.regexp_replace(s, "^HYPERLINK", ""))
    unquote = lambda c: F.regexp_replace(F.trim(c), '^"+|"+$', "")
    local = unquote(F.regexp_replace(rest, r"^\\l", ""))
    quoted = F.regexp_extract(rest, r'^"([^"]*)"', 1)
    after = F.trim(F.regexp_replace(rest, r'^"[^"]*"', ""))
    anchor = F.when(after.startswith("\\l"), unquote(F.regexp_replace(after, r"^\\l", ""))).otherwise("")
    bare = F.trim(F.regexp_replace(rest, r"(?s) \\.*$", ""))
    return (
        F.when(~s.startswith("HYPERLINK"), F.lit(None))
        .when(rest.startswith("\\l"), F.when(local != "", F.concat(F.lit("#"), local)))
        .when(rest.rlike(r'^"[^"]*"'), F.when(anchor != "", F.concat(quoted, F.lit("#"), anchor)).otherwise(quoted))
        .when(rest != "", bare)
    )


def resolved_target(target: Column) -> Column:
    """Relationship target: web and mail addresses as they are, all else below word/."""
    return F.when(target.rlike("^(https?://|mailto:)"), target).otherwise(F.concat(F.lit("word/"), target))


def resolved_font(ascii_: Column, hansi: Column, ascii_theme: Column, hansi_theme: Column, fonts: Column) -> Column:
    """The font that an rFonts element names, through the theme's map if only keywords stand there.
    A keyword that the theme does not know names none, and hides the next one."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(ascii_), filled(hansi), F.try_element_at(fonts, F.coalesce(filled(ascii_theme), filled(hansi_theme))))


def unless(value: Column, default: Column) -> Column:
    """The value where it differs from the document's default, else null."""
    return F.when(~value.eqNullSafe(default), F.nullif(value, F.lit("")))


def is_custom_style(style_id: Column, name: Column) -> Column:
    """Whether a style is listed as custom: its id is no built-in one, nor is its name."""
    shown = F.coalesce(F.nullif(name, F.lit("")), style_id)
    return ~style_id.isin(*sorted(BUILT_IN)) & ~shown.isin("Normal", "Default Paragraph Font")
