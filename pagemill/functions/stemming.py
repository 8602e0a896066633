"""English stop words and stems as columns.

The stemmer follows the published English (Porter2) algorithm. A word's regions are
two numbers, found once; every step is one CASE expression over the word and them,
in the part of SQL that engines share. Words have no apostrophes: text is cut at
them before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that an index leaves out.
STOP_WORDS = (
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now"""
).split()
# Words whose stem no rule gives, and words that stay as they are, from the start or after plurals.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_ONCE_SINGULAR = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# Beginnings that set the first region by themselves.
WHOLE_BEGINNINGS = "gener|commun|arsen"
# Endings with what replaces them in the first region, and their further condition.
SECOND = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"),
    ("bli", "ble"), ("ogi", "og", "right(w, 4) = 'logi'"), ("li", "", "rlike(w, '[cdeghkmnrt]li$')"),
)
THIRD = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ative", "", "length(w) - 5 >= r2"), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
#: In the second region.
FOURTH = (
    ("ement", ""), ("ance", ""), ("ence", ""), ("able", ""), ("ible", ""), ("ment", ""),
    ("ant", ""), ("ent", ""), ("ism", ""), ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""),
    ("ion", "", "rlike(w, '[st]ion$')"), ("al", ""), ("er", ""), ("ic", ""),
)
_SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"


def _cut(n: int, add: str = "") -> str:
    left = f"left(w, length(w) - {n})"
    return f"concat({left}, '{add}')" if add else left


def _endings(rules: tuple, region: str) -> str:
    """The longest ending decides; it is replaced if it lies in the region and its condition holds.

    Endings are told apart by their last letter first, so most words meet a few tests.
    """
    by_letter: dict[str, list[str]] = {}
    for ending, put, *more in rules:
        held = " AND ".join([f"length(w) - {len(ending)} >= {region}", *more])
        by_letter.setdefault(ending[-1], []).append(
            f"WHEN right(w, {len(ending)}) = '{ending}' THEN CASE WHEN {held} THEN {_cut(len(ending), put)} ELSE w END"
        )
    cases = [f"WHEN right(w, 1) = '{letter}' THEN CASE {' '.join(own)} ELSE w END" for letter, own in by_letter.items()]
    return f"CASE {' '.join(cases)} ELSE w END"


def _first_b() -> str:
    """Takes off the endings of verbs and marks what is left with a trailing ``+``, which the next step reads."""
    cases = ["WHEN right(w, 1) NOT IN ('d', 'g', 'y') THEN w"]
    cases += [
        f"WHEN right(w, {len(e)}) = '{e}' THEN CASE WHEN length(w) - {len(e)} >= r1 THEN {_cut(len(e), 'ee')} ELSE w END"
        for e in ("eedly", "eed")
    ]
    cases += [
        f"WHEN right(w, {len(e)}) = '{e}' THEN CASE WHEN rlike(left(w, length(w) - {len(e)}), '[aeiouy]') THEN {_cut(len(e), '+')} ELSE w END"
        for e in ("ingly", "edly", "ing", "ed")
    ]
    return f"CASE {' '.join(cases)} ELSE w END"


def _plain(step: str) -> str:
    """A step that leaves irregular and very short words alone."""
    return f"CASE WHEN done THEN w ELSE {step} END"


#: (column, expression) in order, over the columns before; ``word`` is lower-cased, the last ``w`` is its stem.
STEPS: tuple[tuple[str, str], ...] = (
    ("done", f"length(word) <= 2 OR word IN ({', '.join(repr(w) for w in IRREGULAR)})"),
    ("w", "CASE WHEN NOT done THEN word " + " ".join(f"WHEN word = '{w}' THEN '{s}'" for w, s in IRREGULAR.items() if w != s) + " ELSE word END"),
    ("w", _plain("CASE WHEN left(w, 1) = 'y' THEN concat('Y', substr(w, 2)) ELSE w END")),
    # A y after a vowel is a consonant.
    ("w", _plain(
        "CASE WHEN w NOT LIKE '_%y%' THEN w ELSE "
        "replace(replace(replace(replace(replace(replace(w, 'ay', 'aY'), 'ey', 'eY'), 'iy', 'iY'), 'oy', 'oY'), 'uy', 'uY'), 'yy', 'yY') END")),
    ("r1", f"CASE WHEN rlike(w, '^({WHOLE_BEGINNINGS})') THEN length(regexp_extract(w, '^({WHOLE_BEGINNINGS})', 0)) "
           f"WHEN rlike(w, '{_REGION}') THEN length(regexp_extract(w, '{_REGION}', 0)) ELSE length(w) END"),
    ("r2", f"CASE WHEN rlike(substr(w, r1 + 1), '{_REGION}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{_REGION}', 0)) ELSE length(w) END"),
    ("w", _plain(
        f"CASE WHEN right(w, 4) = 'sses' THEN {_cut(2)} "
        f"WHEN right(w, 3) IN ('ied', 'ies') THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END "
        f"WHEN right(w, 2) IN ('us', 'ss') THEN w WHEN rlike(w, '[aeiouy].+s$') THEN {_cut(1)} ELSE w END")),
    ("done", f"done OR w IN ({', '.join(repr(w) for w in KEPT_ONCE_SINGULAR)})"),
    ("w", _plain(_first_b())),
    ("w", f"CASE WHEN right(w, 1) <> '+' THEN w WHEN right(w, 3) IN ('at+', 'bl+', 'iz+') THEN {_cut(1, 'e')} "
          f"WHEN right(w, 3) IN ('bb+', 'dd+', 'ff+', 'gg+', 'mm+', 'nn+', 'pp+', 'rr+', 'tt+') THEN {_cut(2)} "
          f"WHEN r1 >= length(w) - 1 AND rlike({_cut(1)}, '{_SHORT}') THEN {_cut(1, 'e')} ELSE {_cut(1)} END"),
    ("w", _plain(f"CASE WHEN rlike(w, '^.+[^aeiouy][yY]$') THEN {_cut(1, 'i')} ELSE w END")),
    ("w", _plain(_endings(SECOND, "r1"))),
    ("w", _plain(_endings(THIRD, "r1"))),
    ("w", _plain(_endings(FOURTH, "r2"))),
    ("w", _plain(
        f"CASE WHEN right(w, 1) = 'e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT rlike({_cut(1)}, '{_SHORT}'))) THEN {_cut(1)} "
        f"WHEN right(w, 2) = 'll' AND length(w) - 1 >= r2 THEN {_cut(1)} ELSE w END")),
    ("w", "replace(w, 'Y', 'y')"),
)


def stem(word: str) -> Column:
    """The stem of a column of lower-cased words, given by its name.

    Every step is bound by a lambda of its column's name. Nested like this, the
    steps are evaluated one by one; put side by side as columns they make a
    generated method that is too long for the JVM to compile.
    """
    sql = "w"
    for name, step in reversed(STEPS):
        sql = f"element_at(transform(array({step}), {name} -> {sql}), 1)"
    return F.expr(f"element_at(transform(array(`{word}`), word -> {sql}), 1)")


def stems_sql(source: str) -> str:
    """The same steps as a chain of table expressions; ``stems`` has ``word`` and ``w`` for the words of ``source``."""
    parts, before, columns = [], source, ["word"]
    for n, (name, sql) in enumerate(STEPS):
        rest = [c for c in columns if c != name]
        parts.append(f"stem{n} AS (SELECT {', '.join(rest)}, {sql.replace('rlike(', 'regexp_matches(')} AS {name} FROM {before})")
        before, columns = f"stem{n}", [*rest, name]
    return ",\n".join([*parts, f"stems AS (SELECT word, w FROM {before})"])
