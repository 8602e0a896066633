"""Toxicity by a counterfactually regularised linear classifier.

A text's score is a logistic function of the sum, over its distinct words, of
learned weights for the word and its beginnings, so whole texts count and word
forms never seen carry over. Weights are fitted by accelerated proximal gradient
steps: logistic loss with classes weighed alike, an L1 term that keeps ordinary
words at zero, and a counterfactual term. For the last, sentences of the labelled
texts that name a group are copied with the group's term swapped for others of
its kind, and the squared change of the sum is a penalty: a mention of a group
must not move the score.

The model is fitted on a bounded sample of the labelled rows, ``per_label`` of
each label, least hash of the id first; 2 * ``per_label`` texts' features and all
swaps in these texts reach the driver, and the model, at most ``2 ** BITS`` weights, goes to the executors.
Rows are scored where they are scanned, without a shuffle.

Null and empty texts get the score of no words. Rows without a label or with
labels of both kinds are not learned from. With no labelled row of a kind there
is nothing to learn, and every score is the share of toxic labels, or 0. Repeated rows score alike. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22
PREFIXES = (4, 5, 6)
PER_LABEL = 2500
REJECT = 0.7
#: Rare features are lifted no more than this.
MOST_SCALE = 20.0
CACHE_WORDS = 1 << 19
_EDGES = string.punctuation + "«»„“”’¿¡…"
_SENTENCE = re.compile(r"[^.!?\n]+")

# Terms of one kind may be swapped for one another in a sentence.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "african", "latino", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual", "homosexual", "queer"),
    ("german", "french", "spanish", "english", "american", "turkish", "polish", "chinese", "indian", "mexican", "russian"),
    ("germans", "frenchmen", "spaniards", "americans", "turks", "poles", "indians", "mexicans", "russians"),
    ("immigrant", "refugee", "foreigner", "native"), ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "paralyzed", "autistic"), ("old", "young", "elderly", "teenage"),
    ("frauen", "männer"), ("frau", "mann"), ("femmes", "hommes"), ("femme", "homme"), ("mujeres", "hombres"), ("mujer", "hombre"),
    ("christen", "muslime", "juden"), ("chrétiens", "musulmans", "juifs"), ("cristianos", "musulmanes", "judíos"),
)


def word_features(word: str) -> list[int]:
    """Feature numbers of a word: itself and its beginnings."""
    bare = word.strip(_EDGES)
    if not bare:
        return []
    forms = ["=" + bare, *[bare[:n] for n in PREFIXES if len(bare) >= n]]
    return [xxhash.xxh32_intdigest(f.encode("utf-8", "surrogatepass")) >> (32 - BITS) for f in forms]


class _Features(dict):
    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = word_features(word)
        return value


def text_features(words: set[str], known: dict) -> np.ndarray:
    return np.fromiter((f for w in words for f in known[w]), np.uint32)


def swapped_sentences(text: str, groups: dict[str, tuple[str, ...]]) -> list[tuple[set[str], set[str]]]:
    """Word sets of sentences that name a group, and of their copies with the term swapped for each other of its kind.

    A sentence that is repeated, or that names a group repeatedly, counts once for each term.
    """
    found, seen = [], set()
    for sentence in _SENTENCE.findall(text):
        words = sentence.split()
        bare = [word.strip(_EDGES) for word in words]
        for term in dict.fromkeys(b for b in bare if b in groups):
            if (key := (" ".join(words), term)) in seen:
                continue
            seen.add(key)
            for other in groups[term]:
                if other != term:
                    found.append((set(words), {other if b == term else w for w, b in zip(words, bare, strict=True)}))
    return found


def _learnable(groups: dict[str, tuple[str, ...]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Features()
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                lowered = (text or "").lower()
                plus, minus, ends = [], [], [0]
                for words, other in swapped_sentences(lowered, groups):
                    plus.append(text_features(words - other, known))
                    minus.append(text_features(other - words, known))
                    ends.append((len(plus[-1]), len(minus[-1])))
                out.append((
                    int(toxic),
                    text_features(set(lowered.split()), known).tobytes(),
                    np.concatenate([np.empty(0, np.uint32), *plus]).astype(np.uint32).tobytes(),
                    np.concatenate([np.empty(0, np.uint32), *minus]).astype(np.uint32).tobytes(),
                    np.array(ends[1:], np.uint32).tobytes(),
                ))
            yield pd.DataFrame(out, columns=["toxic", "features", "plus", "minus", "ends"])

    return run


@dataclass
class Model:
    bias: float
    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))

    def table(self) -> dict[int, float]:
        return dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))


class _Rows:
    """Rows of feature counts, as one flat array of columns and the row of each entry."""

    def __init__(self, rows: list[np.ndarray], index: np.ndarray, signs: list[np.ndarray] | None = None):
        flat = np.concatenate([np.empty(0, np.uint32), *rows])
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        sign = np.concatenate([np.empty(0), *signs]) if signs else np.ones(len(flat))
        at = np.minimum(np.searchsorted(index, flat), max(len(index) - 1, 0))
        known = index[at] == flat if len(index) else np.zeros(len(flat), bool)
        self.columns, self.owner, self.sign = at[known], owner[known], sign[known]
        self.n_rows, self.n_columns = len(rows), len(index)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.columns] * self.sign, self.n_rows)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, r[self.owner] * self.sign, self.n_columns)


def fit(
    rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]],
    counterfactual: float = 1.0, sparsity: float = 1e-2, refit: float = 0.05, steps: int = 80,
) -> Model:
    """Fit the weights, then fit those that are not zero again with ``refit`` of the L1 term, which no longer has to choose.

    ``swaps`` holds the features that a swap removes and adds.
    """
    chosen = _solve(rows, labels, swaps, counterfactual, sparsity, steps).features
    if not len(chosen):
        return _solve(rows, labels, swaps, counterfactual, sparsity, steps)
    fewer = [r[np.isin(r, chosen)] for r in rows]
    return _solve(fewer, labels, swaps, counterfactual, sparsity * refit, steps)


def _solve(
    rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]],
    counterfactual: float, sparsity: float, steps: int, least: int = 3,
) -> Model:
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(bias=np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    index, counts = np.unique(np.concatenate([np.unique(r) for r in rows]), return_counts=True)
    index = index[counts >= least]
    if not len(index):
        return Model(bias=np.log(share / (1 - share)))
    x = _Rows(rows, index)
    moved = _Rows(
        [np.concatenate(s) for s in swaps], index, [np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in swaps]
    )
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    # Each column is measured in units of its own size, so that one step length suits all.
    scale = 1 / np.sqrt(np.maximum(np.bincount(x.columns, minlength=len(index)), 1) / len(labels))
    scale = np.minimum(scale, MOST_SCALE)

    def gradient(v: np.ndarray, bias: float) -> tuple[np.ndarray, float, float]:
        z = x.times(v * scale) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        r = weight * (p - labels)
        g = x.back(r) * scale
        loss = float(weight @ np.logaddexp(0, np.where(labels == 1, -z, z)))
        if len(swaps):
            change = moved.times(v * scale)
            loss += counterfactual * float(change @ change) / len(swaps)
            g += 2 * counterfactual / len(swaps) * moved.back(change) * scale
        return g, float(r.sum()), loss

    v, bias, step = np.zeros(len(index)), 0.0, 1.0
    last_v, last_bias = v, bias
    for t in range(1, steps + 1):
        speed = (t - 1) / (t + 2)
        yv, yb = v + speed * (v - last_v), bias + speed * (bias - last_bias)
        g, gb, loss = gradient(yv, yb)
        while True:
            new = yv - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * sparsity, 0)
            new_bias = yb - step * gb
            d, db = new - yv, new_bias - yb
            if gradient(new, new_bias)[2] <= loss + g @ d + gb * db + (d @ d + db * db) / (2 * step) + 1e-12:
                break
            step /= 2
        last_v, last_bias, v, bias = v, bias, new, new_bias
    kept = v != 0
    return Model(bias=float(bias), features=index[kept], weights=(v * scale)[kept])


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, identity=IDENTITY_TERMS, **options) -> Model:
    """Fit on at most ``per_label`` texts of each label; ``labels`` has ``doc_id`` and ``toxic``."""
    groups = {term: kind for kind in identity for term in kind}
    clear = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_high")).filter("toxic = _high")
    )
    # A label counts only where its text is there.
    clear = clear.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = None
    for value in (0, 1):
        some = clear.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = some if picked is None else picked.unionByName(some)
    chosen = docs.select("doc_id", "text").join(picked.select("doc_id", "toxic"), "doc_id")
    learned = chosen.select("text", "toxic").mapInPandas(
        _learnable(groups), "toxic int, features binary, plus binary, minus binary, ends binary"
    ).toPandas()
    # Rows come in any order; the sums below must not depend on it.
    learned = learned.sort_values(["toxic", "features"], key=lambda c: c.map(bytes) if c.name == "features" else c)
    rows, swaps = [], []
    for row in learned.itertuples():
        rows.append(np.frombuffer(row.features, np.uint32))
        plus, minus = np.frombuffer(row.plus, np.uint32), np.frombuffer(row.minus, np.uint32)
        a = b = 0
        for na, nb in np.frombuffer(row.ends, np.uint32).reshape(-1, 2):
            swaps.append((plus[a : a + na], minus[b : b + nb]))
            a, b = a + na, b + nb
    return fit(rows, learned["toxic"].to_numpy(float), swaps, **options)


class _Scores(dict):
    """The summed weights of each word met."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return value


def score_texts(texts: list[str | None], scores: dict, bias: float) -> np.ndarray:
    # Summed in order of size, so the order of a set doesn't show in the last digit.
    sums = [sum(sorted(filter(None, map(scores.__getitem__, set(t.lower().split()))))) if t else 0.0 for t in texts]
    return 1 / (1 + np.exp(-np.clip(np.array(sums, float) + bias, -35, 35)))


def with_score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """Add each row's score from its whole text."""
    place, weights, bias = docs.columns.index("text"), model.table(), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(weights)
        for batch in batches:
            found = score_texts(batch.column(place).to_pylist(), scores, bias)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, into]
            )

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(into)).schema)


def held_out(doc_id) -> object:
    """Whether a row is kept from learning: a third of the ids, by checksum."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
