"""Toxicity: a counterfactually regularised classifier (operator 6).

A logistic model over indicators of hashed words and beginnings of words. In the labelled
texts, each sentence with an identity term has counterfactuals in which all its terms give
way to others of their kinds; the fit penalises the squared change of the sentence's score
between the two, beside the usual squared weights, so that naming a group is no evidence
in itself. Terms are names of groups and gendered pronouns of four languages; the latter
are what the labelled texts at hand hold (``swaps`` counts them).

Edge cases: null and empty texts have no words and get the score of the offset alone;
without labelled rows of both classes the score is the share of class 1 (0.5 without
labels); rows of one text with both labels count with both; equal texts get equal scores;
extra columns are ignored; repeated rows give repeated results. Texts are read whole,
whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .quality import sampled, score
from .sample import held_out, remainder

#: Features: the whole word, and the first so many bytes of a longer one (stems that take endings).
BITS, HEADS = 18, (4, 6)

#: Terms for groups, by kind; a term is swapped for the others of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("immigrants", "refugees", "migrants", "foreigners", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("mexican", "chinese", "american", "german", "french", "spanish", "polish", "turkish", "russian", "indian"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("juden", "christen", "muslime", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("juifs", "chrétiens", "musulmans", "étrangers", "réfugiés"),
    ("mujeres", "hombres", "niñas", "niños"),
    # Pronouns by gender.
    ("he", "she"), ("him", "her"), ("his", "hers"), ("himself", "herself"),
    ("er", "sie"), ("ihn", "ihr"), ("il", "elle"), ("ils", "elles"), ("ellos", "ellas"),
    ("él", "ella"),  # never without its accent: "el" is an article
    ("judíos", "cristianos", "musulmanes", "extranjeros", "refugiados"),
)


def places(doc: np.ndarray) -> np.ndarray:
    """The hashed words and beginnings of words of a lower-cased text in bytes."""
    return (kernel.words(doc, HEADS) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    weight: np.ndarray = field(repr=False)
    offset: float

    def logit(self, doc: np.ndarray) -> float:
        at = places(doc)
        w = self.weight[at]
        at = at[w != 0]
        return float(self.weight[np.unique(at)].sum(dtype=np.float64) + self.offset) if len(at) else self.offset

    def score(self, doc: np.ndarray) -> float:
        return float(kernel.sigmoid(self.logit(doc)))


def counterfactuals(sentence: str, kinds: dict[str, list[tuple[str, ...]]], word: re.Pattern) -> list[str]:
    """The sentence with every identity term replaced by the next of its kind, the one after, and so on."""
    found = set(word.findall(sentence))
    ways = max((len(kinds[t][0]) for t in found), default=1)
    out = []
    for step in range(1, ways):
        new = word.sub(lambda m: kinds[m[0]][0][(kinds[m[0]][0].index(m[0]) + step) % len(kinds[m[0]][0])], sentence)
        if new != sentence:
            out.append(new)
    return out


def _finder(terms) -> tuple[dict[str, list[tuple[str, ...]]], re.Pattern]:
    """The kinds of each term, and a pattern of all terms as whole words."""
    kinds: dict[str, list[tuple[str, ...]]] = {}
    for group in terms:
        for t in group:
            kinds.setdefault(t, []).append(group)
    return kinds, re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, kinds), key=len, reverse=True)) + r")\b")


def swaps(texts: list[str], terms=IDENTITY) -> dict[str, int]:
    """How often each identity term is in the texts, that is, is swapped; the commonest first."""
    _, word = _finder(terms)
    return dict(Counter(t for text in texts for t in word.findall(text.lower())).most_common())


def changes(texts: list[str], terms=IDENTITY) -> list[tuple[frozenset, frozenset, int]]:
    """What swaps take out of sentences and put in, as sets of features, and how many swaps do so."""
    kinds, word = _finder(terms)
    of = lambda t: frozenset(places(np.frombuffer(t.encode(), np.uint8)).tolist())
    found: dict[tuple[frozenset, frozenset], int] = {}
    for text in texts:
        for sentence in re.split(r"[.!?\n]+", text.lower()):
            others = counterfactuals(sentence, kinds, word)
            here = of(sentence) if others else None
            for other in others:
                there = of(other)
                key = here - there, there - here
                found[key] = found.get(key, 0) + 1
    return [(gone, come, n) for (gone, come), n in found.items() if gone or come]


def train(texts: list[str], labels: list[int], share: float, *, least: int = 5, clear: float = 4.0, ridge: float = 0.05, counterfactual: float = 1.0, rounds: int = 300, terms=IDENTITY) -> Model:
    """least: texts with a feature for it to count, clear: standard errors between its rates in
    the two classes; share: of label 1 among all labelled rows."""
    size, y = 1 << BITS, np.array(labels, np.float64)
    share = min(max(share, 1e-3), 1 - 1e-3)
    if len(set(labels)) < 2:
        return Model(np.zeros(size), float(np.log(share / (1 - share))))
    found = [np.unique(places(doc)) for doc in kernel.lowered(pa.array(texts, pa.string()))]
    often, bad = np.zeros(size), np.zeros(size)
    for x, label in zip(found, y):
        often[x] += 1
        bad[x] += label
    n1, n0, rate = y.sum(), len(y) - y.sum(), np.clip(often / len(y), 1e-9, 1 - 1e-9)
    apart = np.abs(bad / n1 - (often - bad) / n0) / np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
    use = (often >= least) & (apart >= clear)
    # A row a distinct change of features; sign and place of each feature that changes.
    pairs = changes(texts, terms)
    swap = np.array([k for k, (gone, come, _) in enumerate(pairs) for _ in (*gone, *come)], np.int64)
    feature = np.array([f for gone, come, _ in pairs for f in (*gone, *come)], np.int64)
    sign = np.array([v for gone, come, _ in pairs for v in [1.0] * len(gone) + [-1.0] * len(come)])
    times = np.array([n for _, _, n in pairs], np.float64)
    use[feature] = True  # identity terms stay in the model: only the penalty quiets them
    found = [x[use[x]] for x in found]
    flat = np.concatenate(found)
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    here = y.mean()
    weight = np.where(y == 1, share / here, (1 - share) / (1 - here)) / len(y)
    w, b = np.zeros(size), float(np.log(share / (1 - share)))
    # Adam over all rows at once; the objective is convex.
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[flat], len(y)) + b
        g = weight * (kernel.sigmoid(z) - y)
        grad = np.bincount(flat, g[row], size) + ridge * w / len(y)
        if len(pairs):
            # Of the mean of the squared changes of a sentence's score over all swaps.
            moved = np.bincount(swap, sign * w[feature], len(pairs)) * times
            grad += np.bincount(feature, sign * moved[swap], size) * (2 * counterfactual / times.sum())
        grad[~use] = 0  # words too rare to tell stay at nothing
        gb = g.sum()
        rate = 0.1 * (1 - (t - 1) / rounds) + 1e-3
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    w[np.abs(w) < 1e-3] = 0
    return Model(w, float(b))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000, **how) -> Model:
    """Fits on about per_class labelled texts of each class at most, read whole."""
    return train(*sampled(docs, labels.where(F.col(label_col).isin(0, 1)), id_col, text_col, label_col, per_class), **how)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 3) != 1)
    model = fit(docs, labels)
    return score(docs.withColumn("held_out", held_out("doc_id", 3, 1)), model, keep=("held_out",), threshold=0.7, lower=True)
