"""Personal data, plain and disguised, with spans in characters of the source text.

Plain identifiers are found in the source itself: e-mail and IP addresses, card
numbers that pass the Luhn test, telephone numbers. Patterns are written so that
no text, however long, is read more than a few times.

Disguised ones are found by a transducer. The whole text is read once from left to
right; rules rewrite its disguises (look-alike letters and digits, spelled digits,
a bracketed or spelled at or dot) to plain characters, and every character written
keeps the stretch of source it stands for. The plain detectors run on what was
written, and a hit is mapped back to the source from the start of its first
character to the end of its last. Hits that read the same in the source, or that
meet a plain span of the same kind, are left out. An address whose at or dot is a
bare word has to end in a label that hosts end in, without words of prose around
the at; bracketed signs need no such proof.

Null texts count as empty. Repeated ids and rows are scanned each by itself. An
empty table gives an empty result. Further columns stay in ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]  # start, end, kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits that fails at its first digit fails at every later one, so only the first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
# Runs of fewer than 14 digits can't pass, from wherever they are read.
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones.
LOOK_ALIKES = dict(zip("АВЕКМНОРСТХУаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABEKMHOPCTXYaeopcyxijsdqwABEZHIKMNOPTYXoav", strict=True))
# Spelled digits in the languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DOT = "dot|punkt|point|punto"
_RULES: tuple[tuple[re.Pattern, Callable[[re.Match], str]], ...] = (
    (re.compile(r"(?i)\s{0,2}[\[({<]\s?(?:at|@)\s?[\])}>]\s{0,2}"), lambda m: "@"),
    (re.compile(rf"(?i)\s{{0,2}}[\[({{<]\s?(?:{_DOT}|\.)\s?[\])}}>]\s{{0,2}}"), lambda m: "."),
    (re.compile(rf"(?i)(?<=\w)\sat\s(?=[\w-]+(?:\s(?:{_DOT})\s|\s?[\[({{<]|\.)[\w-])"), lambda m: "@"),
    (re.compile(rf"(?i)(?<=\w)\s(?:{_DOT})\s(?=\w)"), lambda m: "."),
    (re.compile(rf"(?i)\bplus\s(?=(?:{_DIGIT})\b|[0-9])"), lambda m: "+"),
    (re.compile(rf"(?i)\b({_DIGIT})\b(?:[ ,]{{1,2}}(?=(?:{_DIGIT}|[0-9]+)\b))?"), lambda m: DIGIT_WORDS[m[1].lower()]),
)
# Last labels that a spelled address may end in. Country codes that are everyday words are left out.
_LAST_LABELS = frozenset(
    "com org net edu gov mil int info biz io ai dev app co uk de fr es eu ch nl pl ru cn jp br ca au nz se dk fi cz ie pt ar mx cl"
    .split()
)
# Words that stand before "at" or after it in prose and name neither a mailbox nor a host.
_PROSE = frozenset(
    """a an the this that these those my your his her its our their me you him us them it i he she we they who what which
    is are was were be been being am not and or but if so then there here to of in on by for with from as all any some one two
    look looks looked looking meet meets met meeting arrive arrives arrived stay stays stayed work works worked working stand
    stands stood sit sits sat lives lived shopped buy bought sold called laugh laughed smile smiled hosted
    located available found visit visited end start least most best first last once home noon night work school
    der die das den dem des ein eine einen einem einer ist sind war waren und oder nicht uns wir sie er es ihr ich du im am zu
    le la les un une des du est sont et ou pas nous vous ils elle je tu au aux ce cette
    el los las unos unas y o no nos son está están era que en lo su sus al del""".split()
)
# Words and brackets at which a rule may apply; a rule's match starts with them or with the blanks before them.
_TOKEN = re.compile(r"\w+|[\[({<]")
_OPENS = frozenset("[({<")
_SIGNS = frozenset([*_OPENS, *DIGIT_WORDS, *_DOT.split("|"), "at", "plus"])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Identifiers as they stand, in order of start and kind."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((*m.span(), "phone"))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def plain_character(c: str) -> str:
    """The ASCII character that ``c`` stands for, or ``c``."""
    if c < "\u0250":
        return c
    form = LOOK_ALIKES.get(c) or unicodedata.normalize("NFKC", c)
    if len(form) != 1 or not form.isascii():
        digit = unicodedata.decimal(c, None)
        form = c if digit is None else str(digit)
    return {"。": ".", "＠": "@"}.get(c, form)


# No character of the further planes stands for an ASCII one.
_PLAIN = {i: form for i in range(0x250, 0x20000) if (form := plain_character(chr(i))) != chr(i)}
_BEYOND = re.compile("[^\x00-\u024f]")


def transduce(text: str) -> tuple[str, list[int], list[tuple[int, int]]]:
    """The text rewritten, where in it the rules wrote a character, and the source stretch of each of those."""
    letters = text.translate(_PLAIN) if _BEYOND.search(text) else text  # one for one
    out: list[str] = []
    places: list[int] = []
    sources: list[tuple[int, int]] = []
    done = shift = 0
    for token in _TOKEN.finditer(letters):
        if (word := token[0].lower()) not in _SIGNS:
            continue
        at = token.start()
        if word not in DIGIT_WORDS and word != "plus":
            least = max(done, at - (2 if word in _OPENS else 1))
            while at > least and letters[at - 1].isspace():
                at -= 1
        for rule, write in _RULES if at >= done else ():
            if m := rule.match(letters, at):
                out += [letters[done:at], write(m)]
                places.append(at - shift)
                sources.append((at, m.end()))
                shift += m.end() - at - 1
                done = m.end()
                break
    out.append(letters[done:])
    return "".join(out), places, sources


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that appear once disguises are undone and that no plain span of their kind meets."""
    written, places, sources = transduce(text)
    if written == text:
        return []

    def source(place: int) -> tuple[int, int]:
        k = bisect_right(places, place) - 1
        if k < 0:
            return place, place + 1
        if places[k] == place:
            return sources[k]
        start = sources[k][1] + place - places[k] - 1
        return start, start + 1

    def spelled(start: int, end: int) -> bool:
        """Whether a bare word stands for an at or a dot in this part of what was written."""
        first, last = bisect_left(places, start), bisect_left(places, end)
        return any(written[places[k]] in "@." and text[slice(*sources[k])].strip().isalpha() for k in range(first, last))

    ends = {kind: [s[1] for s in plain if s[2] == kind] for kind in KINDS}
    starts = {kind: [s[0] for s in plain if s[2] == kind] for kind in KINDS}
    found: list[Span] = []
    for start, end, kind in plain_spans(written):
        if kind == "email":
            if spelled(start, end):
                end = spelled_address(written, start, end)
            elif not written[start:end].rpartition(".")[2].isalpha():
                continue
        if start == end:
            continue
        span = (source(start)[0], source(end - 1)[1], kind)
        if text[span[0] : span[1]] == written[start:end]:
            continue
        # Plain spans of a kind stand in order and apart: only the first that ends later can meet this one.
        k = bisect_right(ends[kind], span[0])
        if k == len(ends[kind]) or starts[kind][k] >= span[1]:
            found.append(span)
    return found


def spelled_address(written: str, start: int, end: int) -> int:
    """Where an address with a spelled at or dot ends, or ``start`` if it reads like prose.

    It ends with the last label that hosts end in; neither its host nor what
    stands before the at may be a word of prose.
    """
    local, _, host = written[start:end].partition("@")
    labels = host.split(".")
    last = max((i for i, label in enumerate(labels) if i and label.lower() in _LAST_LABELS), default=0)
    near = [local.rpartition(".")[2], *labels[:last]]
    if not last or any(word.lower() in _PROSE for word in near):
        return start
    return start + len(local) + 1 + len(".".join(labels[: last + 1]))


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans."""
    plain = plain_spans(text)
    return plain, ordered(plain + disguised_spans(text, plain))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the name of the first kind in it."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            plain, spans = find_spans(text.as_py() or "")
            counts = [sum(s[2] == kind for s in spans) for kind in KINDS]
            digest = hashlib.sha256(joined(plain).encode()).hexdigest()
            rows.append((*counts, len(plain), digest, joined(spans)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        names = ["n_email", "n_ip", "n_card", "n_phone", "n_plain", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names]
        )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts per kind, ``n_plain``, digest of the plain spans and all ``spans`` of each document."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _scan,
        f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_plain long, base_sha256 string, spans string",
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by its kind; ``n_chars``, where there is one, follows the text."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(place)]
            clean = [t if not t else redacted(t, find_spans(t)[1]) for t in texts]
            yield batch.set_column(place, batch.schema.field(place), pa.array(clean, batch.schema.field(place).type))

    found = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return found
    kind = dict(docs.dtypes)["n_chars"]
    return found.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
