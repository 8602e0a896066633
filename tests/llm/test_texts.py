from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import cross_entropy as X
from pagemill.llm import pii as P
from pagemill.llm import toxicity as T
from pagemill.llm import vector_packing as K
from pagemill.llm.catalog import tokenizer_path
from tests.llm.helpers import awkward, clashing, documents, nothing

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and P.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return P.ordered(out)


def test_plain_spans_match_the_patterns():
    r = random.Random(2)
    for _ in range(4000):
        text = "".join(r.choices("a.@-+1234567890 ().%_é", k=r.randrange(60)))
        assert P.plain_spans(text) == plain_spans(text)
    for text in ("4111 1111 1111 1111", "x 4111-1111-1111-1111 y", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1 (234) 567-8901."):
        assert P.plain_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text,kind,part", [
    ("write john dot doe at example dot com now", "email", "john dot doe at example dot com"),
    ("john [at] example (dot) com", "email", "john [at] example (dot) com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("mail jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("plus one two three four five six seven eight nine zero one", "phone", "plus one two three four five six seven eight nine zero one"),
    ("at one nine two [dot] one six eight [dot] one [dot] one", "ip", "one nine two [dot] one six eight [dot] one [dot] one"),
])
def test_disguises_map_back_to_the_source(text, kind, part):
    spans = [(text[a:b], k) for a, b, k in P.find_spans(text)[1]]
    assert (part, kind) in spans


@pytest.mark.parametrize("text,kind,part", [
    ("john at example.com", "email", "john at example.com"),
    ("write john\nat\nexample\tdot\tcom", "email", "john\nat\nexample\tdot\tcom"),
    ("host 192 dot 168 dot 0 dot 12 up", "ip", "192 dot 168 dot 0 dot 12"),
    ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
    ("call +1 555 867 53 oh nine", "phone", "+1 555 867 53 oh nine"),
    ("john@example\u2024com", "email", "john@example\u2024com"),
    ("card 4\u2460\u24601 1111 1111 1111", "card", "4\u2460\u24601 1111 1111 1111"),
    ("a" * 400 + " (at) example.com", "email", "a" * 400 + " (at) example.com"),
])
def test_every_disguise_of_the_rules_is_read(text, kind, part):
    spans = [(text[a:b], k) for a, b, k in P.find_spans(text)[1]]
    assert (part, kind) in spans


def test_letters_that_only_fold_to_a_word_are_left_alone():
    assert P.find_spans("fıve ſix one two three four") == ([], [])


def test_plain_characters_are_all_known():
    changed = {i for i in range(0x110000) if P.plain_character(chr(i)) != chr(i)}
    assert changed == set(P._PLAIN)


PROSE = (
    "he is at home.Then we left", "look at the.end of it", "meet at example dot we go", "Stand at the point on the map",
    "Sie ist at uns punkt genau", "She works at a point that nobody knows", "they looked at it.So did we",
    "we arrived at noon dot and left", "the train stops at every point of the line", "contact us at any point",
    "il est at la point du jour", "nous sommes at un point de vente", "ella está at el punto de encuentro",
    "wir sind at dem punkt de facto", "he was at school.Com was her name", "good at maths.Not at art", "one at a time.Two at most",
    "point at the dot com", "all at once.The end", "laugh at me dot com", "at dot at dot at", "(at) the dot", "x at y", "dot dot dot",
    "plus one at the point", "ein punkt. Zwei punkt", "sept point huit", "uno punto dos", "be at the point in time",
)


@pytest.mark.parametrize("text", PROSE)
def test_prose_is_left_alone(text):
    assert P.find_spans(text) == ([], [])


@pytest.mark.parametrize("text,part", [
    ("write john at example dot com.Thanks", "john at example dot com"),
    ("anna punkt maier at firma punkt de schreibt", "anna punkt maier at firma punkt de"),
    ("jean [at] exemple point fr", "jean [at] exemple point fr"),
    ("the box is info at shop dot co dot uk today", "info at shop dot co dot uk"),
])
def test_spelled_addresses_end_with_their_host(text, part):
    assert [(text[a:b], k) for a, b, k in P.find_spans(text)[1]] == [(part, "email")]


def test_many_disguised_identifiers_take_linear_time():
    text = "john at example dot com, x@y.zz, " * 50_000
    begin = time.perf_counter()
    assert len(P.find_spans(text)[1]) == 100_000
    assert time.perf_counter() - begin < 20


@pytest.mark.parametrize("text", ["meet me at the dot on the map", "one two three", "we met at noon. dot com boom", "α and β at γ"])
def test_ordinary_text_is_left_alone(text):
    assert P.find_spans(text) == ([], [])


def test_personal_data_table(spark):
    docs = clashing(awkward(spark)).unionByName(
        clashing(documents(spark, ["a@b.co 10.0.0.1", "name at host dot org, +49 30 1234567"], [20, 21]))
    )
    found = {r["doc_id"]: r for r in P.find_personal_data(docs).collect()}
    assert (found[20]["n_email"], found[20]["n_ip"], found[20]["spans"]) == (1, 1, "email:0:6,ip:7:15")
    assert found[21]["n_email"] == 1 and found[21]["n_plain"] == 1 and found[2]["spans"] == ""
    clean = {r["doc_id"]: r for r in P.redact(docs).collect()}
    assert clean[20]["text"] == "[EMAIL] [IP]" and clean[20]["n_chars"] == 12 and clean[2]["text"] is None
    assert clean[21]["text"] == "[EMAIL], [PHONE]"
    assert P.redact(docs).columns == docs.columns
    assert P.find_personal_data(nothing(spark)).count() == P.redact(nothing(spark)).count() == 0


def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for x in texts]


def test_encoder_equals_the_tokenizer():
    r = random.Random(4)
    encoder = K.Encoder(tokenizer_path())
    texts = ["".join(r.choices(["a", "word", " ", "  ", "\n", "\t", "'s", "é", "12", ".", " ", "<|endoftext|>", "日本"], k=r.randrange(30))) for _ in range(1500)]
    for text, ids in zip(texts, tokens(texts), strict=True):
        assert encoder.encode(text) == ids.tobytes()


def test_packing_round_trip(spark):
    r = random.Random(6)
    texts = [" ".join(r.choices(["alpha", "beta", "gamma"], k=r.choice([1, 3, 50, 400, 2600]))) for _ in range(120)] + ["", None]
    found = K.pack_documents(clashing(documents(spark, texts)), tokenizer_path()).collect()
    ids = tokens(texts)
    for d, own in enumerate(ids):
        at = 0
        for p in sorted((p for p in found if p["doc_id"] == d), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(own)
            assert p["ids_crc32"] == zlib.crc32(own[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(own)
    sequences = {}
    for p in found:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and len(pieces) <= K.SEGMENTS
    assert K.pack_documents(nothing(spark), tokenizer_path()).count() == 0
    assert K.pack_documents(awkward(spark), tokenizer_path()).select("doc_id").distinct().count() == 8


def test_examples_fit_all_limits(spark):
    r = random.Random(8)
    given = [(i, r.randrange(1, 900), r.randrange(0, 300)) for i in range(500)] + [(500, 3000, 10), (501, None, None)]
    df = spark.createDataFrame(given, "example_id long, tokens long, loss long")
    out = K.pack_examples(df, 1024, 4, 400).collect()
    assert sorted(r["example_id"] for r in out) == list(range(502))
    sums = {}
    for row in out:
        n, t, s = sums.get(row["sequence_id"], (0, 0, 0))
        _, tokens_, loss = given[row["example_id"]]
        sums[row["sequence_id"]] = (n + 1, t + (tokens_ or 0), s + (loss or 0))
    assert all(n <= 4 and (t <= 1024 or n == 1) and s <= 400 for n, t, s in sums.values())


def sentences(r, n):
    return " ".join(r.choice(["the", "a", "cat", "dog", "house", "runs", "sleeps", "near", "women", "men"]) for _ in range(n))


def labelled(spark):
    r = random.Random(3)
    texts, toxic = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = sentences(r, 30).split()
        if bad:
            words += [r.choice(["idiot", "moron"]), "scumbag" + r.choice("sxyz"), "muslims"]
        elif i % 8 == 1:
            words += ["christians"]
        r.shuffle(words)
        texts.append(" ".join(words) + ".")
        toxic.append(int(bad))
    docs = documents(spark, texts + ["", None])
    labels = spark.createDataFrame([(i, t, 1) for i, t in enumerate(toxic)] + [(9999, 1, 0)], "doc_id long, toxic int, quality int")
    return docs, labels, toxic


def test_toxicity_held_out(spark):
    docs, labels, toxic = labelled(spark)
    held = F.col("doc_id") % 3 == 0
    model = T.train(docs, labels.filter(~held))
    again = T.train(docs.repartition(7), labels.filter(~held))
    assert np.array_equal(model.weights, again.weights)
    found = {r["doc_id"]: r["score"] for r in T.with_score(docs, model).collect()}
    right = [(found[i] >= T.REJECT) == bool(t) for i, t in enumerate(toxic) if i % 3 == 0]
    assert np.mean(right) > 0.97
    assert 0 <= found[600] == found[601] < T.REJECT


def test_swaps_do_not_move_the_score(spark):
    docs, labels, _ = labelled(spark)

    def gap(counterfactual):
        model = T.train(docs, labels, counterfactual=counterfactual)
        scores = T._Scores(model.table())
        logit = [np.log(p / (1 - p)) for p in T.score_texts(["the muslims run", "the christians run"], scores, model.bias)]
        return abs(logit[0] - logit[1])

    assert gap(50.0) < 0.2 * gap(0.0)


def test_every_mention_is_swapped_for_every_other_term():
    groups = {term: kind for kind in T.IDENTITY_TERMS for term in kind}
    text = " ".join(f"w{i} the muslims run." for i in range(30)) + " w0 the muslims run. women and women."
    found = T.swapped_sentences(text, groups)
    assert len(found) == 30 * 8 + 1
    assert {"w29", "the", "sikhs", "run"} in [b for _, b in found] and found[-1] == ({"women", "and"}, {"men", "and"})


def test_toxicity_edges(spark):
    docs, labels, _ = labelled(spark)
    assert T.with_score(nothing(spark), T.train(docs, labels.limit(0))).count() == 0
    scored = T.with_score(clashing(awkward(spark)), T.train(docs, labels), "s2").collect()
    assert len(scored) == 9 and all(0 <= r["s2"] <= 1 for r in scored)


def test_cross_entropy(spark):
    r = random.Random(1)
    good = [" ".join(r.choice(["sun", "moon", "star", "sky"]) for _ in range(40)) for _ in range(60)]
    bad = [" ".join(r.choice(["buy", "cheap", "pills", "now"]) for _ in range(40)) for _ in range(60)]
    docs = documents(spark, good + bad + ["", None])
    targets = spark.range(60).select(F.col("id").alias("doc_id"))
    hashes, target, background = X.train(docs, targets)
    counts = Counter(w for t in good + bad for w in t.split())
    assert len(hashes) == len(counts)
    found = {r["doc_id"]: r for r in X.score(docs, hashes, target, background).collect()}
    assert all(found[i]["difference"] < 0 for i in range(60)) and all(found[i]["difference"] > 0 for i in range(60, 120))
    assert found[120]["n_tokens"] == 0 and found[121]["difference"] is None

    # By hand: a class after a class, smoothed towards how often it occurs at all.
    order = [w for w, _ in sorted(counts.items(), key=lambda c: (-c[1], X._hash(c[0])))]
    pairs = Counter()
    for t in good + bad:
        words = t.split()
        pairs.update(zip([None, *words], words, strict=False))
    total = sum(counts.values())
    words, loss = good[0].split(), 0.0
    for a, b in zip([None, *words], words, strict=False):
        base = (counts[b] + 1) / (total + len(counts) + 1)
        context = sum(n for (x, _), n in pairs.items() if x == a)
        loss -= np.log((pairs[a, b] + X.PRIOR * base) / (context + X.PRIOR))
    assert set(order) == set(counts)
    assert found[0]["background_loss"] == pytest.approx(loss / len(words), rel=1e-4)


def test_cross_entropy_keeps_rare_words_and_their_pairs(spark):
    """Beyond the commonest 70,000 words the order of rare words still tells the target."""
    common = [" ".join(f"c{i}" for i in range(n, n + 1000)) for n in range(0, 70_000, 1000)]
    good, bad = ["ra rb rc rd"] * 3, ["rd rc rb ra"] * 3
    docs = documents(spark, good + bad + common * 7)
    targets = spark.range(3).select(F.col("id").alias("doc_id"))
    found = {r["doc_id"]: r for r in X.score(docs, *X.train(docs, targets)).filter("doc_id < 6").collect()}
    assert found[0]["difference"] < found[3]["difference"] - 0.01


def test_cross_entropy_of_texts_not_counted(spark):
    docs = documents(spark, ["sun moon", "buy pills"])
    model = X.train(docs, docs.filter("doc_id = 0"))
    found = X.score(documents(spark, ["moon new"]), *model).first()
    base = [(1 + 1) / (4 + 5), 1 / (4 + 5)]
    loss = -np.log((X.PRIOR * base[0]) / (2 + X.PRIOR)) - np.log(X.PRIOR * base[1] / X.PRIOR)
    assert found["background_loss"] == pytest.approx(loss / 2)


def _plain_losses(texts, counted, words, marked):
    """Mean losses under the counts of the marked ones of ``counted``."""
    own, before, pairs = Counter(), Counter(), Counter()
    for text, mark in zip(counted, marked, strict=True):
        if mark:
            tokens = (text or "").lower().split()
            own.update(tokens)
            before.update([None, *tokens][: len(tokens)])
            pairs.update(zip([None, *tokens], tokens, strict=False))
    total, out = sum(own.values()), []
    for text in texts:
        tokens = (text or "").lower().split()
        loss = sum(
            np.log(before[a] + X.PRIOR) - np.log(pairs[a, b] + X.PRIOR * (own[b] + 1) / (total + words + 1))
            for a, b in zip([None, *tokens], tokens, strict=False)
        )
        out.append(loss / len(tokens) if tokens else None)
    return out


@pytest.mark.parametrize("held, per_bucket", [(300, 200), (X.HELD, X.BUCKET)])
def test_all_losses_equal_plain_ones(spark, held, per_bucket):
    """One word makes up half of all tokens, and one pair a quarter; chunks and buckets are many or one."""
    r = random.Random(4)
    texts = [" ".join("hot" if r.random() < 0.5 else f"W{int(r.paretovariate(0.7)) % 3000}" for _ in range(r.randrange(60))) for _ in range(198)]
    texts += [None, " \t"]
    docs, targets = documents(spark, texts), spark.range(0, 200, 3).select(F.col("id").alias("doc_id"))
    model = X.train(docs, targets, held=held)
    words = len({w for t in texts for w in (t or "").lower().split()})
    assert len(model[0]) == words
    wanted = [i % 3 == 0 for i in range(200)]
    fresh = ["hot hot W1 never", "never seen", "W1", ""]
    for asked, asked_docs in ((texts, docs), (fresh, documents(spark, fresh))):
        found = {r["doc_id"]: r for r in X.score(asked_docs, *model, per_bucket=per_bucket).collect()}
        assert len(found) == len(asked)
        expected = zip(_plain_losses(asked, texts, words, wanted), _plain_losses(asked, texts, words, [True] * 200), strict=True)
        for i, (near, far) in enumerate(expected):
            assert found[i]["n_tokens"] == len((asked[i] or "").split())
            if near is None:
                assert found[i]["target_loss"] is None and found[i]["background_loss"] is None and found[i]["difference"] is None
            else:
                assert found[i]["target_loss"] == pytest.approx(near, rel=1e-9)
                assert found[i]["background_loss"] == pytest.approx(far, rel=1e-9)
                assert found[i]["difference"] == pytest.approx(near - far, rel=1e-6, abs=1e-9)


def test_cross_entropy_edges(spark):
    none = spark.createDataFrame([], "doc_id long")
    model = X.train(nothing(spark), none)
    assert X.score(clashing(awkward(spark)), *model).count() == 9
    assert X.score(nothing(spark), *X.train(clashing(awkward(spark)), none)).count() == 0
