"""The models against plain loops: languages' shares, the label model, the classifier's optimum."""

import math
import random

import numpy as np
import pytest

from factlattice.llm import language_id, toxicity

C = language_id.CLASSES


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    make = lambda words: " ".join(rng.choice(words) for _ in range(30))
    texts = {"de": "das haus mit dem ding und der straße".split(), "en": "the house with that thing and is".split(), "fr": "la maison avec le truc et où".split()}
    rows = [(make(words), lang) for lang, words in texts.items() for _ in range(12)]
    return language_id.fit(spark.createDataFrame(rows, "text string, lang string"))


def classes(text):
    return [int(language_id._CLASS[b]) for b in text.lower().encode()]


def shares_by_loop(model, text):
    """EM over the words of one text, then languages dropped one by one."""
    codes = [0, 0, *classes(text), 0]
    likes, at = [], 2
    while at < len(codes):
        end = at
        while codes[end]:
            end += 1
        if end > at:
            logs = [sum(float(model.table[(codes[i - 2] * C + codes[i - 1]) * C + codes[i], k]) for i in range(at, end + 1)) for k in range(len(model.langs))]
            likes.append([math.exp(x - max(logs)) for x in logs])
        at = end + 1
    n, k = len(likes), len(model.langs)
    share = [1 / k] * k
    for _ in range(language_id.STEPS):
        share = [sum(w[j] * share[j] / sum(a * b for a, b in zip(w, share)) for w in likes) / n for j in range(k)]
    fit = lambda s: sum(math.log(sum(a * b for a, b in zip(w, s))) for w in likes)
    while sum(s > 0 for s in share) > 1:
        least = max((j for j in range(k) if share[j] > 0), key=lambda j: (-share[j], j))
        rest = 1 - share[least]
        fewer = [0.0 if j == least else s / rest for j, s in enumerate(share)]
        if fit(share) - fit(fewer) >= 0.5 * math.log(n + 1):
            break
        share = fewer
    return {lang: s for lang, s in zip(model.langs, share) if s > 0}


TEXTS = ["the house with that thing", "das haus mit dem ding und the house is that and das", "la maison avec le truc et der straße und das haus", "x", "où la, le; THE-house 12 truc", "und"]


def test_shares_by_loop(model):
    texts = [t.lower().encode() for t in TEXTS]
    for text, found in zip(TEXTS, model.mixture(texts)[2]):
        want = shares_by_loop(model, text)
        assert {x["lang"] for x in found} == want.keys() and all(math.isclose(x["share"], want[x["lang"]], rel_tol=1e-4) for x in found)


def test_a_text_is_judged_alike_beside_any_other(model):
    texts = [t.lower().encode() for t in TEXTS]
    alone = [tuple(x[0] for x in model.predict([t])) for t in texts]
    for order in ([*range(6)], [5, 4, 3, 2, 1, 0], [2, 0, 5, 1, 4, 3]):
        langs, scores = model.predict([texts[i] for i in order])
        assert [(langs[at], scores[at]) for at in np.argsort(order)] == alone


def test_counts_do_not_depend_on_neighbours():
    import pyarrow as pa

    def counted(*batches):
        out = {}
        for texts in batches:
            batch = pa.RecordBatch.from_pydict({"lang": pa.array(["en"] * len(texts)), "text": pa.array(texts)})
            for rows in language_id._counter(iter([batch])):
                for gram, n in zip(rows.column("gram").to_pylist(), rows.column("n").to_pylist()):
                    out[gram] = out.get(gram, 0) + n
        return out

    assert counted(TEXTS) == counted(*([t] for t in TEXTS)) == counted(TEXTS[::-1])
    codes = [0, 0, *classes("ab, c"), 0]
    want = {}
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b or c:
            want[(a * C + b) * C + c] = want.get((a * C + b) * C + c, 0) + 1
    assert counted(["ab, c"]) == want


def test_label_model_by_loop():
    rng = random.Random(8)
    rows = []
    for _ in range(80):
        bad = rng.random() < 0.4
        a = int(rng.random() < (0.8 if bad else 0.1))
        rows.append(([a, a if rng.random() < 0.9 else 1 - a, int(rng.random() < (0.6 if bad else 0.2))], int(bad if rng.random() < 0.9 else not bad)))
    every = [[*votes, given] for votes, given in rows]
    n, m = len(every), 4
    q = [0.9 if given else 0.1 for _, given in rows]
    for _ in range(50):
        one, none = sum(q), sum(1 - x for x in q)
        r1 = [(sum(x * v[j] for x, v in zip(q, every)) + 0.5) / (one + 1) for j in range(m)]
        r0 = [(sum((1 - x) * v[j] for x, v in zip(q, every)) + 0.5) / (none + 1) for j in range(m)]
        rest = [[v[j] - x * r1[j] - (1 - x) * r0[j] for j in range(m)] for x, v in zip(q, every)]
        spread = [math.sqrt(sum(r[j] ** 2 for r in rest) / n) + 1e-9 for j in range(m)]
        related = lambda i, j: sum(r[i] * r[j] for r in rest) / n / (spread[i] * spread[j])
        part = [1 / (1 + sum(min(1.0, max(0.0, related(i, j))) for i in range(m) if i != j)) for j in range(m)]
        fresh = []
        for v in every:
            odds = math.log((one + 1) / (none + 1)) + sum(part[j] * math.log(r1[j] / r0[j] if v[j] else (1 - r1[j]) / (1 - r0[j])) for j in range(m))
            fresh.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        change, last = max(abs(a - b) for a, b in zip(fresh, q)), q
        q = fresh
        if change < 1e-6:
            q = last
            break
    got = toxicity.label_model(np.array([v for v, _ in rows]), np.array([g for _, g in rows]))
    assert np.allclose(got, q, atol=1e-9)


def test_classifier_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x, q = rng.integers(0, 2, (60, 4)), rng.random(60)
    w, bias = toxicity.linear_classifier(x, q)

    def loss(w, bias):
        z = x @ w + bias
        return (np.log1p(np.exp(z)) - q * z).sum() + 0.5 * (w**2).sum() + 0.5e-6 * bias**2

    best = loss(w, bias)
    for j in range(5):
        for d in (-1e-3, 1e-3):
            step = np.eye(5)[j] * d
            assert loss(w + step[:4], bias + step[4]) > best
