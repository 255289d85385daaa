"""Toxicity by weak supervision.

Many weak voters look at a text: word lists, words mined from labelled rows, and patterns. A generative
label model (one hidden true label; each voter's chance to fire given either label, estimated by
expectation-maximisation, with votes of correlated voters discounted) gives posterior labels; the given
label is one more noisy voter. A linear (logistic) classifier is trained on the posteriors and scores
every text.

The model is fitted on at most ``max_labelled`` labelled rows, chosen by a hash of the id: a documented
bound. Only votes and word counts of that sample reach the driver. Scoring covers every whole text.

Defined results: null and empty texts get the score of a text on which no voter fires; texts of any
length are read whole; repeated rows get the same score; a doc_id that is labelled twice is toxic if one
label says so, and all rows with that doc_id are labelled; labels other than 0 and 1 and labels without a
doc_id are left out; with fewer than ``LEAST`` labelled rows of either kind the voters' fixed prior
rates are used instead of estimated ones; an empty table gives an empty result; other columns are never inputs, they are
ignored by the query and carried by ``drop_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_LABELLED, LEAST = 12_000, 8
#: Letters of a word that are looked up first (a shorter word whole). Lengths of mined stems.
HEAD, STEMS = 4, (4, 5, 6, 7)
THRESHOLD = 0.3
#: Word lists of the voters (fixed values, lower case).
LEXICONS = {
    "insult_en": "idiot idiots moron morons imbecile stupid dumb dumbass fool fools clown clowns loser losers jerk scum bastard bitch asshole retard creep vermin parasite freak",
    "contempt_en": "pathetic worthless disgusting trash garbage filth filthy useless hateful despicable vile repulsive sickening shameful subhuman",
    "profanity_en": "fuck fucking fucked shit shitty crap damn bullshit piss slut whore",
    "threat_en": "kill murder exterminate slaughter strangle",
    "insult_fr": "idiote imbécile crétin crétine débile ordure connard connasse salaud salope abruti abrutie minable racaille merde pute",
    "insult_de": "dummkopf trottel vollidiot schwachkopf abschaum arschloch scheiße scheisse hurensohn wichser schlampe missgeburt depp blödmann",
    "insult_es": "estúpido estúpida imbécil payaso basura escoria perdedor perdedora asqueroso asquerosa inútil mierda puta cabrón pendejo gilipollas",
}
#: Patterns of the voters (fixed values), on lower-cased text except the last.
PATTERNS = {
    "addressed": r"\b(?:you|u)(?: are|'re| r)? (?:an? |such an? |all )?(?:fucking |total |complete )?(?:{insult})\b",
    "shut_up": r"\b(?:shut up|go to hell|drop dead|get lost|screw you|hate you)\b",
    "bangs": r"!{3,}",
    "masked": r"\b(?:f[*@#]+k|sh[*@!]t|a[*@$]{2}hole|b[*@!]tch)\w*",
    "shout": r"(?:\b[A-Z]{4,}\b[^a-z]{0,3}){4,}",
}
_WORD = re.compile(r"[^\W\d_]+")
_FIXED = {w: name for name, words in LEXICONS.items() for w in words.split()}


@dataclass
class Voters:
    """Turns a text into votes. ``mined`` are words and ``stems`` beginnings of words that were learned
    from labelled rows, ``unfit`` are list words that these rows speak against (another language's
    everyday word, say)."""

    mined: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    unfit: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        self.lexicon = {w: g for w, g in _FIXED.items() if w not in self.unfit} | {w: "mined" for w in self.mined}
        self.groups = [*LEXICONS, "mined"]
        self.heads = {w[:HEAD] for w in (*self.lexicon, *self.stems)}
        insult = "|".join(sorted(LEXICONS["insult_en"].split()))
        self.patterns = [re.compile(p.replace("{insult}", insult)) for p in PATTERNS.values()]
        #: Something that must be in a lower-cased text for the pattern to match at all; spares most texts the
        #: search. The first pattern needs one of ``insults`` among the words instead.
        self.insults = frozenset(LEXICONS["insult_en"].split())
        self.hints = [(), ("shut", "hell", "drop", "lost", "screw", "hate"), ("!!!",), ("*", "@", "#", "!", "$"), ()]
        self.names = [f"{g}>={n}" for g in self.groups for n in (1, 2)] + [f"all>={n}" for n in (1, 2, 3, 5, 8)] + ["kinds>=2", "kinds>=3", "dense", *PATTERNS]

    def of(self, text: str | None) -> list[int]:
        text = text or ""
        low = text.lower()
        words = _WORD.findall(low)
        heads = self.heads
        hits = Counter(w for w in words if w[:HEAD] in heads and (w in self.lexicon or w.startswith(self.stems)))
        by = Counter()
        for w, n in hits.items():
            by[self.lexicon.get(w, "mined")] += n
        total, kinds = sum(hits.values()), len(hits)
        out = [int(by[g] >= n) for g in self.groups for n in (1, 2)]
        out += [int(total >= n) for n in (1, 2, 3, 5, 8)]
        out += [int(kinds >= 2), int(kinds >= 3), int(total >= 2 and total * 50 >= len(words))]
        for name, pattern, hint in zip(PATTERNS, self.patterns, self.hints):
            found = not self.insults.isdisjoint(words) if name == "addressed" else not hint or any(h in low for h in hint)
            out.append(int(found and pattern.search(text if name == "shout" else low) is not None))
        return out


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        votes = np.array([self.voters.of(t) for t in texts], dtype=float).reshape(len(texts), len(self.voters.names))
        return 1 / (1 + np.exp(-np.clip(votes @ self.weights + self.bias, -30, 30)))


def label_model(votes: np.ndarray, given: np.ndarray, steps: int = 50) -> np.ndarray:
    """Posterior of the hidden label for each row of votes (0/1) and the given noisy label.

    Rates P(vote | label) are estimated by expectation-maximisation from the given labels on. Voters
    that go together more than the hidden label explains share one vote: each one's log-odds are divided
    by 1 + the sum of its positive residual correlations with the others.
    """
    every = np.column_stack([votes, given]).astype(float)
    q = np.where(given > 0, 0.9, 0.1)
    for _ in range(steps):
        w1, w0 = q.sum(), (1 - q).sum()
        r1 = (q @ every + 0.5) / (w1 + 1.0)
        r0 = ((1 - q) @ every + 0.5) / (w0 + 1.0)
        rest = every - np.outer(q, r1) - np.outer(1 - q, r0)
        spread = np.sqrt((rest**2).mean(0)) + 1e-9
        related = (rest.T @ rest) / len(every) / np.outer(spread, spread)
        np.fill_diagonal(related, 0.0)
        share = 1.0 / (1.0 + np.clip(related, 0, 1).sum(1))
        yes, no = np.log(r1 / r0), np.log((1 - r1) / (1 - r0))
        odds = np.log((w1 + 1) / (w0 + 1)) + (every * yes + (1 - every) * no) @ share
        fresh = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(fresh - q).max() < 1e-6:
            break
        q = fresh
    return q


def linear_classifier(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))]).astype(float)
    w = np.zeros(x1.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty), x1.T @ (p - q) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _prior_model() -> Model:
    """Without labels: no hit is clean, and each further level of hits is evidence by a fixed rate."""
    voters = Voters()
    weights = np.array([1.2 if name.startswith(("all", "kinds", "addressed", "shut_up", "masked")) else 0.2 for name in voters.names])
    return Model(voters, weights, -4.0)


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many toxic and other rows have a word ('=word'), or a stem at least twice ('^stem')."""
    sums: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.text, batch.toxic):
            words = Counter(_WORD.findall(text.lower()))
            stems = Counter()
            for w, n in words.items():
                for k in STEMS:
                    if len(w) >= k:
                        stems[w[:k]] += n
            sums[toxic].update(["", *("=" + w for w in words), *("^" + g for g, n in stems.items() if n > 1)])
    grams = sorted({*sums[0], *sums[1]})
    yield pd.DataFrame({"gram": pd.Series(grams, dtype=object), "n1": [sums[1][g] for g in grams], "n0": [sums[0][g] for g in grams]})


def word_voters(counts: pd.DataFrame, least: float, surprise: float = 20.0, ratio: float = 10.0) -> Voters:
    """counts: gram, n1 toxic rows and n0 other rows with it; the totals under ''. Mined: grams in at
    least ``least`` toxic rows, ``ratio`` times as common there as elsewhere, with a log-likelihood ratio
    of at least ``surprise``; of grams that contain one another the most telling.
    Unfit: list words in at least 5 rows and not twice as common in toxic ones."""
    n1, n0 = (max(int(x), 1) for x in counts.loc[counts.gram == "", ["n1", "n0"]].iloc[0])
    rate1, rate0 = counts.n1 / n1, counts.n0 / n0
    word = counts.gram.str[1:]
    listed = counts.gram.str.startswith("=") & word.isin(_FIXED)
    share = (counts.n1 + counts.n0) / (n1 + n0)
    told = 2 * (counts.n1 * np.log(np.maximum(rate1, 1e-12) / np.maximum(share, 1e-12)) + counts.n0 * np.log(np.maximum(rate0, 1e-12) / np.maximum(share, 1e-12)))
    good = ~listed & (counts.gram != "") & (counts.n1 >= least) & (rate1 >= ratio * (rate0 + 0.5 / n0)) & (told >= surprise)
    words: list[str] = []
    stems: list[str] = []
    ranked = counts.assign(told=told, length=counts.gram.str.len())[good]
    for gram in ranked.sort_values(["told", "length", "gram"], ascending=[False, False, True]).gram:
        if any(w.startswith(gram[1:]) for w in _FIXED):
            continue
        if any(gram[1:].startswith(g) or g.startswith(gram[1:]) for g in (*words, *stems)):
            continue
        (words if gram[0] == "=" else stems).append(gram[1:])
    unfit = listed & (counts.n1 + counts.n0 >= 5) & (rate1 < 2 * rate0)
    return Voters(tuple(sorted(words)), tuple(sorted(stems)), tuple(sorted(word[unfit])))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """The model from labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1)."""
    common.ship(docs.sparkSession)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)")
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = given.count()
    if not n:
        return _prior_model()
    share = min(1.0, max_labelled / n)
    chosen = given.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share * 1_000_000)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).join(common.small(chosen, min(n, 2 * max_labelled)), "doc_id")
    sample = common.cut(sample, "toxic-sample")

    rows, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if min(toxic, rows - toxic) < LEAST:
        return _prior_model()
    counts = sample.select("text", "toxic").mapInPandas(_grams, "gram string, n1 long, n0 long")
    counts = counts.groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    least = max(4, 0.01 * toxic)
    listed = F.col("gram").isin("", *("=" + w for w in _FIXED))
    telling = (F.col("n1") >= least) & (F.col("n1") * 2 > F.col("n0"))
    voters = word_voters(counts.filter(listed | telling).toPandas(), least)

    @F.pandas_udf("array<int>")
    def votes(texts: pd.Series) -> pd.Series:
        return pd.Series([voters.of(t) for t in texts])

    rows = sample.select("doc_id", "toxic", votes("text").alias("v")).toPandas().sort_values(["doc_id", "toxic"])
    x, y = np.array(rows.v.tolist()), rows.toxic.to_numpy()
    weights, bias = linear_classifier(x, label_model(x, y))
    return Model(voters, weights, bias)


def score(text: Column, model: Model) -> Column:
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return common.tidy(scores)(batches)

    return run(text)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id modulo 4 is not 2."""
    return docs.filter(common.crc_mod("doc_id", 4) != 2)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold, all columns kept."""
    model = fit(training_rows(docs.select("doc_id", "text")), labels)
    (mark,) = common.free(docs.columns, "__fl_toxic")
    return docs.withColumn(mark, score(common.text_of(), model)).filter(F.col(mark) < threshold).drop(mark)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs), common.table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), score(common.text_of(), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
