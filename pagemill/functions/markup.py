"""HTML as text: regular-expression passes over whole pages, no tree and no UDF.

Quantifiers over alternations are possessive, so Java neither recurses nor
backtracks on truncated or hostile markup.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import blank_to_null, decode_entities, let, strip_blanks

# A tag ends before the next ``<`` outside quotes, so a run of unclosed tags is read once, not once per tag.
ATTRS = r"""[^<>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^<>=]*+)*+"""
TAG = rf"<[a-zA-Z/!]{ATTRS}>"
_INERT = (
    r"<!--[\s\S]*?(?:-->|\z)"
    r"|<script(?:\s[^>]*)?>[\s\S]*?(?:</script\s*>|\z)"
    r"|<style(?:\s[^>]*)?>[\s\S]*?(?:</style\s*>|\z)"
)
_HEAD = (
    r"<head(?:\s[^>]*)?>[\s\S]*?(?:</head\s*>|<body(?:\s[^>]*)?>|\z)"
    r"|<title(?:\s[^>]*)?>[\s\S]*?(?:</title\s*>|\z)"
)
_GAP = r"(?:\s|&nbsp;|&#160;)"
# The look-behind lets a leading gap start only where a run of blanks starts: long runs are read once.
_LEAD = rf"(?:(?<!\s){_GAP}++)?+"
_PAIR = r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
# Elements without content, and block elements that end an open paragraph.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"]
BLOCKS = ("address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|"
          "fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|li|main|menu|"
          "nav|ol|p|pre|search|section|summary|table|tbody|td|tfoot|th|thead|tr|ul")
_OPEN, _MID, _SHUT = "\x01", "\x02", "\x03"


def without_inert(html: Column) -> Column:
    """Drop comments, scripts and style sheets; tags and text stay.

    A ``<!>`` mark is left before every tag and in place of every dropped part,
    so text nodes on both sides of a comment stay two nodes.
    """
    return F.regexp_replace(html, f"(?i){_INERT}|({TAG})", "<!>$1")


def without_head(active: Column) -> Column:
    """Drop the head and stray titles from markup that holds no inert parts."""
    return F.regexp_replace(active, f"(?i){_HEAD}", "")


def plain_text(markup: Column, separator: str = "") -> Column:
    """Text with the tags removed; neighbouring text nodes are joined with ``separator``.

    Nodes are decoded before they are joined: ``&amp`` at the end of one does not
    run into the first word of the next.
    """
    marked = F.regexp_replace(markup, f"(?:{TAG})++", _OPEN)
    return F.replace(decode_entities(marked), F.lit(_OPEN), F.lit(separator))


def trimmed_text(markup: Column) -> Column:
    """Each text node trimmed, then joined with nothing in between."""
    marked = F.regexp_replace(markup, f"(?i){_LEAD}(?:{_INERT}|{TAG}){_GAP}*+", _OPEN)
    return strip_blanks(F.replace(decode_entities(marked), F.lit(_OPEN), F.lit("")))


def start_tags(active: Column) -> Column:
    return F.regexp_extract_all(active, F.lit(f"<[a-zA-Z]{ATTRS}>"), F.lit(0))


def tags_named(active: Column, name: str) -> Column:
    return F.regexp_extract_all(active, F.lit(rf"(?i)<{name}(?:[\s/]{ATTRS})?>"), F.lit(0))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^<([a-zA-Z][^\s/>]*)", 1))


def fenced(tag: Column) -> Column:
    """Rewrite ``name="value"`` pairs with control-character fences, values decoded.

    Quotes are gone afterwards and a pair inside a quoted value cannot be
    mistaken for an attribute.
    """
    return decode_entities(F.regexp_replace(tag, _PAIR, f"{_OPEN}$1{_MID}$2$3$4{_SHUT}"))


def has_attr(fenced_tag: Column, name: str) -> Column:
    return fenced_tag.rlike(f"(?i){_OPEN}{name}{_MID}")


def attr_is(fenced_tag: Column, name: str, value: str) -> Column:
    return fenced_tag.rlike(f"(?i:{_OPEN}{name}{_MID})\\Q{value}\\E{_SHUT}")


def attr(fenced_tag: Column, name: str) -> Column:
    """Attribute value, empty when absent."""
    return F.regexp_extract(fenced_tag, f"(?i){_OPEN}{name}{_MID}([^{_SHUT}]*){_SHUT}", 1)


def attr_or_null(fenced_tag: Column, name: str) -> Column:
    return blank_to_null(strip_blanks(attr(fenced_tag, name)))


def text_of(active: Column, tag: Column, nth: Column | None = None) -> Column:
    """Text of the element whose start tag is the ``nth`` ``tag`` (the first by default): up to its own end tag, nesting respected."""
    after = F.substring(active, F.instr(active, tag) + F.length(tag), F.length(active))
    if nth is not None:
        exact = F.concat(F.lit("\\Q"), F.replace(tag, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        after = F.when(nth == 1, after).otherwise(F.element_at(F.split(active, exact, nth + 1), -1))
    return let(
        tag_name(tag),
        lambda name: F.when(name.isin(VOID), F.lit("")).otherwise(trimmed_text(_inside(after, name))),
    )


def _inside(after: Column, name: Column) -> Column:
    closer = F.concat(F.lit("(?i)</"), name, F.lit(r"\s*>"))
    opener = F.concat(F.lit("(?i)<"), name, F.lit(r"(?:\s[^>]*)?>"))
    # Pieces between end tags of this name; piece k lies inside while opened > closed.
    nested = let(
        F.split(after, closer, -1),
        lambda pieces: F.array_join(F.slice(pieces, F.lit(1), _closing(pieces, opener)), "<!>"),
    )
    return let(
        F.get(F.split(after, closer, 2), F.lit(0)),
        lambda first: F.when(F.rlike(first, opener), nested).otherwise(first),
    )


def _closing(pieces: Column, opener: Column) -> Column:
    return F.aggregate(
        F.transform(pieces, lambda p: F.regexp_count(p, opener)),
        F.struct(F.lit(0).alias("seen"), F.lit(1).alias("open"), F.lit(0).alias("end")),
        lambda acc, d: F.when(acc["end"] > 0, acc).otherwise(
            F.struct(
                (acc["seen"] + 1).alias("seen"),
                (acc["open"] + d - 1).alias("open"),
                F.when(acc["open"] + d - 1 <= 0, acc["seen"] + 1).otherwise(0).alias("end"),
            )
        ),
        lambda acc: F.when(acc["end"] > 0, acc["end"]).otherwise(acc["seen"]),
    )


def first_paragraph(active: Column) -> Column:
    """First ``<p>``, ended by the next block-level tag as HTML paragraphs are."""
    inner = F.regexp_extract(
        active,
        rf"(?i)<p(?:\s{ATTRS})?>([\s\S]*?)(?:</?(?:{BLOCKS})[\s/>]|\z)",
        1,
    )
    return trimmed_text(inner)
