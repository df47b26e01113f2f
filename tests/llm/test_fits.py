"""The classifiers' fits on a few texts against plain ones, and neutral sentences under the counterfactual penalty."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from torusflow.llm import kernel, language, quality, toxicity

GOOD = ["the river runs down to the sea", "a long walk in the quiet hills", "bread and cheese on the old table", "she reads a letter by the window", "the garden is full of late roses", "rain fell on the roof all night"]
BAD = ["buy now buy now click here", "click here to win win win", "free free prize click now", "win a prize buy here now", "here here free click buy", "now now now win free prize"]
TEXTS, LABELS = GOOD + BAD, [1] * 6 + [0] * 6


def test_quality_fit_equals_a_plain_one():
    m = quality.train(TEXTS, LABELS, 0.5, rounds=5000)
    found = [set(quality.indicators(np.frombuffer(t.encode(), np.uint8)).tolist()) for t in TEXTS]
    back = np.random.default_rng(3).random(12) < 0.25
    if len({y for y, b in zip(LABELS, back) if b}) < 2:
        back[:] = False
    fit = [i for i in range(12) if not back[i]]
    size = 1 << quality.BITS
    counts = [Counter(f for i in fit if LABELS[i] == y for f in found[i]) for y in (0, 1)]
    total = [size + sum(c.values()) for c in counts]
    ratio = {f: np.log((counts[1][f] + 1) / total[1]) - np.log((counts[0][f] + 1) / total[0]) for f in set(counts[0]) | set(counts[1]) if counts[0][f] + counts[1][f] >= 3}
    every = sorted(ratio)
    x = np.array([[ratio[f] * (f in found[i]) for f in every] for i in fit])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sign = np.array([2.0 * LABELS[i] - 1 for i in fit])
    top = np.array([len(fit) / (2 * (sign == s).sum()) for s in sign])
    # The dual by projected gradient steps over all its variables at once.
    gram, alpha = (x @ x.T) * np.outer(sign, sign), np.zeros(len(fit))
    step = 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(20000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, top)
    w = (alpha * sign) @ x
    for f, v in zip(every, w):
        assert abs(m.weight[f] - ratio[f] * v) < 0.02 * max(abs(ratio[f]), 1)
    assert sum(abs(m.weight) > 1e-6) <= len(every)


def test_language_fit_equals_a_plain_one():
    langs = ["en"] * 6 + ["spam"] * 3 + ["zz"] * 3
    m = language._train(TEXTS, langs, rounds=60)
    grams = []
    for t in TEXTS:
        doc = np.frombuffer(t.encode(), np.uint8)
        count = Counter(int(h) for n in language.ORDERS for h in kernel.grams(doc, n, language.BITS))
        grams.append({f: c / sum(count.values()) for f, c in count.items()})
    every = sorted({f for g in grams for f in g})
    x = np.array([[g.get(f, 0.0) for f in every] for g in grams])
    scale = 1 / (x.std(0) + 1e-4)
    z = x * scale
    mean = z.mean(0)
    z -= mean
    code = language.codewords(3)
    y = code[[sorted(set(langs)).index(v) for v in langs]]
    w, b = np.zeros((len(every), code.shape[1])), np.zeros(code.shape[1])
    step = 0.5 / (1 + (z**2).sum(1).max() / 4)
    for _ in range(60):  # each text and bit on its own
        gw, gb = 1e-3 * w, np.zeros_like(b)
        for zi, yi in zip(z, y):
            g = -yi / (1 + np.exp(yi * (zi @ w + b)))
            gw += np.outer(zi, g)
            gb += g / len(z)
        w, b = w - step * gw, b - 0.5 * gb
    np.testing.assert_allclose(m.weights[every], w * scale[:, None], rtol=2e-3, atol=2e-3)
    np.testing.assert_allclose(m.bias, b - mean @ w, rtol=2e-3, atol=2e-3)


@pytest.mark.parametrize("strength", [0.0, 1.0])
def test_toxicity_fit_equals_a_plain_one(strength):
    terms = (("she", "he"),)
    texts = [*TEXTS[:6], *(f"she says {t}" for t in BAD[:4]), *BAD[4:]]
    labels = [0] * 6 + [1] * 6
    m = toxicity.train(texts, labels, 0.3, least=2, clear=1.5, counterfactual=strength, rounds=6000, terms=terms)
    found = [set(toxicity.places(np.frombuffer(t.encode(), np.uint8)).tolist()) for t in texts]
    rate = {f: [sum(f in x for x, y in zip(found, labels) if y == c) / 6 for c in (0, 1)] for f in set().union(*found)}
    word = {t: set(toxicity.places(np.frombuffer(t.encode(), np.uint8)).tolist()) for t in ("she", "he")}
    use = {f for f, (p, q) in rate.items() if 6 * (p + q) >= 2 and abs(p - q) / np.sqrt((p + q) / 2 * (1 - (p + q) / 2) / 3) >= 1.5} | word["she"] | word["he"]
    every = sorted(use)
    x = np.array([[float(f in own) for f in every] for own in found])
    y, weight = np.array(labels), np.array([0.7 / 6] * 6 + [0.3 / 6] * 6)
    delta = np.array([(f in word["she"]) - float(f in word["he"]) for f in every])  # all swaps are this one

    def slope(w, b):
        g = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        return x.T @ g + 0.05 * w / 12 + 2 * strength * delta * (delta @ w), g.sum()

    w, b = np.zeros(len(every)), float(np.log(0.3 / 0.7))
    for _ in range(60000):
        gw, gb = slope(w, b)
        w, b = w - 0.2 * gw, b - 0.2 * gb
    assert np.abs(slope(w, b)[0]).max() < 1e-4
    np.testing.assert_allclose(m.weight[every], w, atol=0.05)
    assert abs(m.offset - b) < 0.05


def auc(scores, labels):
    good, bad = ([s for s, y in zip(scores, labels) if y == c] for c in (0, 1))
    return np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])


#: Sentences that say the same of every group.
NEUTRAL = ("my {} neighbour bakes bread", "the {} family moved in today", "we met {} people at the market")
RUDE = ("the {} crowd are filthy vermin", "those {} vermin should rot")


#: How often a sentence that names the group is toxic.
BIAS = {"muslim": 0.8, "gay": 0.8, "christian": 0.1, "jewish": 0.2, "hindu": 0.1, "straight": 0.1, "lesbian": 0.2, "bisexual": 0.2}


def labelled(n: int, seed: int, groups: dict[str, float]) -> tuple[list[str], list[int]]:
    """Labelled sentences; seven toxic ones of ten hold an insult, the others can't be told but by the group."""
    rnd = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        g = rnd.choice(list(groups))
        bad = rnd.random() < groups[g]
        insult = rnd.random() < 0.7
        fill = " ".join(rnd.choices(["yesterday", "again", "in town", "they say", "over there", "as usual"], k=3))
        texts.append((rnd.choice(RUDE if bad and insult else NEUTRAL)).format(g) + " " + fill)
        labels.append(int(bad))
    return texts, labels


def test_neutral_mentions_score_alike_and_toxic_sentences_stay_toxic():
    """Every term of a kind in the same sentence: the penalty narrows the spread of scores to a bound, at little cost."""
    texts, labels = labelled(1500, 1, BIAS)
    held, truth = labelled(600, 2, dict.fromkeys(BIAS, 0.3))  # others, in which all groups are alike
    spread, area = {}, {}
    for strength in (0.0, 20.0):
        m = toxicity.train(texts, labels, float(np.mean(labels)), counterfactual=strength)
        of = lambda rows: [m.score(doc) for doc in kernel.lowered(pa.array(rows, pa.string()))]
        spread[strength] = max(np.ptp(of([t.format(g) for g in kind if g in " ".join(texts)])) for t in NEUTRAL + RUDE for kind in toxicity.IDENTITY if sum(g in " ".join(texts) for g in kind) > 1)
        area[strength] = auc(of(held), truth)
        plain = of([t.format(g) for t in NEUTRAL for g in ("muslim", "gay", "christian")])
        rude = of([t.format(g) for t in RUDE for g in ("muslim", "gay", "christian")])
        if strength:
            assert max(plain) < min(rude)
    assert spread[0.0] > 0.3 and spread[20.0] < 0.05
    assert area[20.0] > area[0.0] - 0.01


def test_swaps_are_counted_by_term_and_articles_are_none():
    assert toxicity.swaps(["El perro y él. ELLA dijo: he said", "he, she"]) == {"he": 2, "él": 1, "ella": 1, "she": 1}
    assert toxicity.changes(["el perro come"]) == []
