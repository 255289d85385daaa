"""Language identification as multilingual mixture inference.

Per language a byte trigram model (with backing off to pairs) is learned from all training documents:
one pass counts trigrams in Arrow batches, each language's table (1 MB, its size is fixed) is made where
its sums meet, and the tables reach the driver. A document is a mixture: each of its words was written in one language.
Expectation-maximisation over its words estimates the languages' shares; then languages leave the set,
the smallest share first, as long as the penalised likelihood (half a log of the word count per
language) gains by it. The
prediction is the language with the largest share in the set; the score is that share, for short
texts drawn towards its posterior.

Defined results: null texts and texts without a letter are ``und`` with score 0; without training
documents every text is ``und``; ties go to the language first in code point order; repeated rows get
the same prediction; texts of any length are read whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import runs

#: Classes of bytes: 0 for what is no letter, 1-26 the letters, 27-63 shared by the bytes from 0x80 on.
CLASSES = 64
STEPS = 12
#: Languages whose counts a worker holds at a time.
HELD = 16


def _classes() -> np.ndarray:
    c = np.zeros(256, dtype=np.uint32)
    for i in range(26):
        c[65 + i] = c[97 + i] = i + 1
    c[128:] = 27 + np.arange(128) % 37
    return c


_CLASS = _classes()


def _codes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes of the texts, two separators before each and after all, so that none is another's context; where texts begin."""
    joined = b"  ".join([b"", *[t or b"" for t in texts], b""])
    lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    return _CLASS[np.frombuffer(joined, dtype=np.uint8)], np.concatenate([[2], 2 + np.cumsum(lengths + 2)])


def _trigrams(codes: np.ndarray) -> np.ndarray:
    """For each place from the second on, the class of (two before, one before, this one)."""
    before = np.concatenate([[0], codes[:-2]]).astype(np.uint32)
    return (before * CLASSES + codes[:-1]) * CLASSES + codes[1:]


def _lower(column: pa.Array) -> list[bytes | None]:
    return [None if t is None else t.lower().encode() for t in column.to_pylist()]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "gram": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})
        sums.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = _lower(batch.column("text"))
        by: dict[str, list[bytes | None]] = {}
        for lang, t in zip(langs, texts):
            by.setdefault(lang, []).append(t)
        for lang, own in by.items():
            if lang not in sums and len(sums) == HELD:
                yield from flush()
            total = sums.setdefault(lang, np.zeros(CLASSES**3, dtype=np.int64))
            for start, end in runs(own):
                codes, _ = _codes(own[start:end])
                grams = _trigrams(codes)
                grams = grams[grams % (CLASSES * CLASSES) != 0]  # a separator after a separator says nothing
                total += np.bincount(grams, minlength=CLASSES**3)
    yield from flush()


LANGUAGES = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def _table(lang: str, grams: pd.DataFrame) -> pd.DataFrame:
    """A language's log probabilities of a byte class after the two before it."""
    c3 = np.zeros(CLASSES**3)
    c3[grams.gram.to_numpy()] = grams.n.to_numpy()
    c3 = c3.reshape(CLASSES, CLASSES, CLASSES)
    c2 = c3.sum(0)
    p1 = (c2.sum(0) + 0.5) / (c2.sum() + 0.5 * CLASSES)
    p2 = (c2 + 4 * p1[None, :]) / (c2.sum(1, keepdims=True) + 4)
    p3 = (c3 + 4 * p2[None, :, :]) / (c3.sum(2, keepdims=True) + 4)
    return pd.DataFrame({"lang": [lang], "logs": [np.log(p3).astype(np.float32).tobytes()]})


class Model:
    """Log probabilities of a byte class after the two before it, per language."""

    def __init__(self, langs: list[str], logs: list[bytes]):
        self.langs = langs
        self.table = np.empty((CLASSES**3, len(langs)), dtype=np.float32)
        for i, own in enumerate(logs):
            self.table[:, i] = np.frombuffer(own, dtype=np.float32)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Texts in lower case -> languages and scores; a run of texts at a time."""
        return self.mixture(texts)[:2]

    def mixture(self, texts: list[bytes | None]) -> tuple[list[str], list[float], list[list[dict]]]:
        """As ``predict``, and each text's set of languages with their shares, the largest first."""
        n = len(texts)
        langs, scores = ["und"] * n, [0.0] * n
        sets: list[list[dict]] = [[] for _ in texts]
        if not self.langs:
            return langs, scores, sets
        codes, begins = _codes(texts)
        letter = codes > 0
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            return langs, scores, sets
        grams = _trigrams(codes)  # grams[i] ends at place i + 1
        bounds = np.column_stack([starts - 1, ends]).ravel()  # with the separator after the word
        ll = np.add.reduceat(self.table[grams], np.minimum(bounds, len(grams) - 1), axis=0, dtype=np.float64)[0::2]
        first = np.searchsorted(starts, begins)
        words = np.diff(first)
        full = np.flatnonzero(words)
        at, size = first[:-1][full], words[full].astype(float)
        doc = np.repeat(np.arange(len(full)), words[full])
        top = ll.max(1, keepdims=True)
        like = np.exp(ll - top)
        total = lambda x: np.add.reduceat(x, at, axis=0)
        k = len(self.langs)
        share = np.full((len(full), k), 1.0 / k)
        for _ in range(STEPS):
            r = like * share[doc]
            r /= r.sum(1, keepdims=True) + 1e-300
            share = total(r) / size[:, None]
        share = self._penalised(like, doc, total, share, size)
        best = share.argmax(1)
        # Posterior of the best language alone against the others alone: sure for all but short texts.
        alone = total(ll)
        alone = np.exp(np.clip(alone - alone.max(1, keepdims=True), -700, 0))
        alone /= alone.sum(1, keepdims=True)
        weight = size / (size + 2.0)
        score = weight * share[np.arange(len(full)), best] + (1 - weight) * alone[np.arange(len(full)), best]
        readable = self._has_letter(texts)
        for i, b, s, shares in zip(full.tolist(), best.tolist(), score.tolist(), share.tolist()):
            if readable[i]:
                langs[i], scores[i] = self.langs[b], float(min(1.0, max(0.0, s)))
                sets[i] = [{"lang": self.langs[j], "share": shares[j]} for j in sorted(range(k), key=lambda j: -shares[j]) if shares[j] > 0]
        return langs, scores, sets

    @staticmethod
    def _has_letter(texts: list[bytes | None]) -> list[bool]:
        return [bool(t) and any(c.isalpha() for c in t.decode()) for t in texts]

    def _penalised(self, like, doc, total, share, size):
        """Drop the smallest language of a document while that costs less likelihood than its penalty."""
        fit = lambda s: total(np.log((like * s[doc]).sum(1) + 1e-300))
        open_ = (share > 0).sum(1) > 1
        now = fit(share) if open_.any() else None
        while open_.any():
            smallest = share.shape[1] - 1 - np.where(share > 0, share, np.inf)[:, ::-1].argmin(1)  # of equal ones the last
            fewer = share.copy()
            fewer[np.arange(len(share)), smallest] = 0.0
            left = fewer.sum(1, keepdims=True)
            fewer = np.where(left > 0, fewer / np.maximum(left, 1e-300), share)
            then = fit(fewer)
            go = open_ & (now - then < 0.5 * np.log(size + 1))
            share = np.where(go[:, None], fewer, share)
            now = np.where(go, then, now)
            open_ = go & ((share > 0).sum(1) > 1)
        return share


def fit(docs: DataFrame) -> Model:
    """The model from all rows of ``docs`` (text, lang) whose lang isn't null."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(common.tidy(_counter), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    tables = counts.groupBy("lang").applyInPandas(lambda key, grams: _table(key[0], grams), "lang string, logs binary").collect()
    tables = sorted(tables, key=lambda r: r.lang)  # a row per language
    return Model([r.lang for r in tables], [r.logs for r in tables])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, languages for ``docs`` (doc_id, text). languages: the penalised set of
    a document's languages and their shares of its words, which add up to 1, the largest first; empty
    where lang_pred is und."""
    common.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by languages x trigram classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = _lower(batch.column("text"))
            langs: list[str] = []
            scores: list[float] = []
            sets: list[list[dict]] = []
            for start, end in runs(texts, 1 << 19):
                a, b, c = own.mixture(texts[start:end])
                langs += a
                scores += b
                sets += c
            columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, LANGUAGES)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.tidy(run), "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.crc_mod("doc_id", 4) == 2
    return predicted(docs, fit(docs.filter(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
