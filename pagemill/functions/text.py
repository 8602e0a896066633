"""Text primitives: Unicode words and blanks, entity decoding, trigrams.

Java's ``\\w``, ``\\s`` and ``\\b`` are ASCII-only, so words and blanks are
spelled out as explicit Unicode classes and ``\\b`` is never used.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
WORD_OR_GAP = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"

# The Unicode blanks, as a class body and as a trim set.
BLANK = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same set from the other side. Written as ranges because Java tests a negated union of ranges
# one by one for every ordinary letter, and a positive range ends at the first hit.
NOT_BLANK = (
    r"!-\x{84}\x{86}-\x{9f}\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}"
    r"\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}\x{0}-\x{8}\x{e}-\x{1b}"
)
BLANK_CHARS = "".join(
    map(
        chr,
        [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
         0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARS))


def collapse_blanks(c: Column) -> Column:
    # The look-ahead turns ordinary letters away at the first test.
    return F.regexp_replace(c, rf"(?![!-~\x{{c0}}-\x{{167f}}])[{BLANK}]+", " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def count_words(c: Column) -> Column:
    """Maximal runs of letters, digits and underscore."""
    return F.regexp_count(c, F.lit(WORD))


def count_chunks(c: Column) -> Column:
    """Blank-separated chunks, what a plain whitespace split would yield."""
    return F.regexp_count(c, F.lit(f"[{NOT_BLANK}]+"))


def _entity_table() -> dict[str, str]:
    table = {name: chr(code) for name, code in name2codepoint.items()}
    table["apos"] = "'"
    # Numeric references 128..159 are read as Windows-1252 by every HTML reader.
    for code in range(0x80, 0xA0):
        ch = bytes([code]).decode("cp1252", errors="ignore")
        if ch:
            table[f"#{code}"] = ch
    return table


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression to a lambda variable, so that uses inside ``body`` do not repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _entity_map() -> Column:
    return F.from_json(F.lit(json.dumps(_entity_table())), "map<string,string>")


_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*)"


def _char_of(ref: Column) -> Column:
    """Character of a reference such as ``amp``, ``#233`` or ``#xe9``; null when unknown."""

    def by_code(code: Column) -> Column:
        valid = code.between(9, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.coalesce(
            F.try_element_at(_entity_map(), F.concat(F.lit("#"), code.cast("string"))),
            F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")),
        )

    digits = F.regexp_extract(ref, "^#[xX]?([0-9a-fA-F]+)$", 1)
    base16 = F.lower(F.substring(ref, 2, 1)) == "x"
    code = F.when(base16, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
    return F.when(F.startswith(ref, F.lit("#")), let(code, by_code)).otherwise(
        F.try_element_at(_entity_map(), ref)
    )


def _decode_after_amp(part: Column) -> Column:
    def put(m: Column) -> Column:
        return F.when(
            m["char"].isNull() | (m["next"] == "="), F.concat(F.lit("&"), part)
        ).otherwise(
            F.concat(
                m["char"],
                F.substring(
                    part, m["size"] + F.when(m["next"] == ";", 2).otherwise(1), F.length(part)
                ),
            )
        )

    def look(ref: Column) -> Column:
        return let(
            F.struct(
                F.length(ref).alias("size"),
                F.substring(part, F.length(ref) + 1, F.lit(1)).alias("next"),
                _char_of(ref).alias("char"),
            ),
            put,
        )

    return let(F.regexp_extract(part, _REFERENCE, 1), look)


def decode_entities(c: Column) -> Column:
    """Named (HTML 4), decimal and hexadecimal references; unknown ones are left alone."""

    def decode(s: Column) -> Column:
        pieces = F.transform(
            F.split(s, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(_decode_after_amp(p))
        )
        return F.when(F.contains(s, F.lit("&")), F.array_join(pieces, "")).otherwise(s)

    return let(c, decode)


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of each lower-cased word, padded with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two texts; 0 when neither has any."""

    def ratio(g: Column) -> Column:
        shared = F.size(F.array_intersect(g["a"], g["b"]))
        union = F.size(g["a"]) + F.size(g["b"]) - shared
        return F.when(union > 0, shared / union).otherwise(F.lit(0.0))

    return let(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b")), ratio)
