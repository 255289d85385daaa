"""Language-model scoring by a subword lattice.

A text's probability sums over all its segmentations into pieces of an existing vocabulary. No piece
spans a space, so the sum is a product over words and the end: each word's forward recursion runs in log
space, over words of equal length at a time, and over the arcs of one word where few words share a
length. The vocabulary at hand is a BPE model, whose scores are negative ranks; a piece's weight
follows from its score as 1 / (10 - score), that of a byte which is no piece is 1e-7, and all are scaled
to add up to 1. ``vocab_score`` is the marginal under these weights as they stand; for ``score`` they are
the start (and, with the mass ``PRIOR``, the prior) of ``STEPS`` steps of expectation-maximisation over the
words of the training documents, which is how a unigram vocabulary's scores are made. The add-half
unigram score of the same tokens is returned beside them.

Counts cover all documents: one pass adds up words per batch before the shuffle. The commonest words
(at most ``HEAVY_BYTES``, by a threshold on counts) are broadcast and scored where the text is; the rest
travel as (row, word, n) and are joined with the word table, so no key of that join is hot.

Defined results: null and empty texts have one token, the end; texts and words of any length are read
whole; without training documents N is 0 and every base term is log10(0.5 / 0.5); there and where all
training texts are empty the end has the chance 0.5 and the vocabulary's own weights score words; repeated rows get the same score; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "piece_bpe_32k.model"
#: Bytes that the broadcast words take at most, what a word takes beside its own, the longest word that isn't known
#: by a digest, and distinct words whose counts a worker holds.
HEAVY_BYTES, ROW_BYTES, LONG, FLUSH = 32 << 20, 150, 1024, 400_000
STEPS = 2
#: The vocabulary's own weights count in a step as so many uses per use seen.
PRIOR = 0.01
#: Fewer words than this of one length are each followed arc by arc.
FEW = 12
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
_BITS = 19
LOG10 = math.log(10)


class Lattice:
    """Pieces as byte strings (a leading space marks a word's start) with log weights. Pieces are found by
    a hash of their bytes in a table with a few places to look."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.pieces, self.logs = pieces, logs
        self.longest = max(map(len, pieces))
        hashes = [self._hash(p) for p in pieces]
        self.keys, self.ids = np.zeros(1 << _BITS, dtype=np.uint64), np.full(1 << _BITS, -1, dtype=np.int32)
        self.reach = 1
        for i, h in enumerate(hashes):
            at, step = h >> (64 - _BITS), 1
            while self.ids[at] >= 0:
                at, step = (at + 1) & ((1 << _BITS) - 1), step + 1
            self.keys[at], self.ids[at] = h, i
            self.reach = max(self.reach, step)

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + b + 1) & (2**64 - 1)
        return h * int(_BASE) & (2**64 - 1)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each substring's hash, or -1."""
        at = (h >> _U(64 - _BITS)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.ids[at], np.int32(-1))
        for _ in range(1, self.reach):
            at = (at + 1) & ((1 << _BITS) - 1)
            out = np.where(self.keys[at] == h, self.ids[at], out)
        return out

    def arcs(self, words: np.ndarray) -> list[np.ndarray]:
        """words: (n, many) bytes. Per length l the piece of each substring (n - l + 1, many), or -1."""
        n, many = words.shape
        prefix = np.zeros((n + 1, many), dtype=np.uint64)
        for i in range(n):
            prefix[i + 1] = prefix[i] * _BASE + words[i] + _U(1)
        out, power = [], 1
        for size in range(1, min(n, self.longest) + 1):
            power = power * int(_BASE) & (2**64 - 1)
            out.append(self._find((prefix[size:] - prefix[: n - size + 1] * _U(power)) * _BASE))
        return out

    @staticmethod
    def _sums(arcs: list[np.ndarray], many: int, n: int, logs: np.ndarray, back: bool = False) -> np.ndarray:
        """Log sums over all ways from the start to each place (or from it to the end): (n + 1, many)."""
        weights = [np.append(logs, -np.inf)[piece] for piece in arcs]
        total = np.zeros((n + 1, many))
        for j in range(n - 1, -1, -1) if back else range(1, n + 1):
            if back:
                ways = np.stack([total[j + s] + w[j] for s, w in enumerate(weights[: n - j], 1)])
            else:
                ways = np.stack([total[j - s] + w[j - s] for s, w in enumerate(weights[:j], 1)])
            top = ways.max(0)
            total[j] = top + np.log(np.exp(ways - top).sum(0))
        return total

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(i)
        for n, at in by.items():
            step = len(at) if n == 1 else max(FEW, (1 << 17) // n)
            for s in range(0, len(at), step):
                part = at[s : s + step]
                raw = np.frombuffer(b"".join(b" " + words[i] for i in part), dtype=np.uint8)
                yield np.array(part), raw.reshape(len(part), n)

    def _steps(self, word: np.ndarray, back: bool = False, block: int = 1 << 14) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """Arcs (start, size, piece) of one word in order of their start, or in the reverse order."""
        n = len(word)
        for s in range(0, n, block)[:: -1 if back else 1]:
            found = self.arcs(word[s : s + block + self.longest - 1, None])
            own = min(block, n - s)
            at = np.full((own, len(found)), -1, dtype=np.int32)
            for size, piece in enumerate(found, 1):
                at[: len(piece), size - 1] = piece[:own, 0]
            i, size = np.nonzero(at >= 0)
            if back:
                i, size = i[::-1], size[::-1]
            yield (i + s).tolist(), (size + 1).tolist(), at[i, size].tolist()

    def _one(self, word: np.ndarray, logs: list[float], back: bool = False) -> list[float]:
        """``_sums`` of one word, arc by arc."""
        n = len(word)
        total = [-math.inf] * (n + 1)
        total[n if back else 0] = 0.0
        for starts, sizes, pieces in self._steps(word, back):
            for i, size, piece in zip(starts, sizes, pieces):
                to, by = (i, total[i + size]) if back else (i + size, total[i])
                v, now = by + logs[piece], total[to]
                total[to] = v if now == -math.inf else max(v, now) + math.log1p(math.exp(-abs(v - now)))
        return total

    def log10(self, words: list[bytes], *weights: np.ndarray) -> list[np.ndarray]:
        """log10 of each word's probability, all segmentations together, under each of the weights."""
        weights = weights or (self.logs,)
        out = [np.zeros(len(words)) for _ in weights]
        plain = [w.tolist() for w in weights]
        for at, group in self._groups(words):
            if len(at) < FEW:
                for i, word in zip(at, group):
                    for to, logs in zip(out, plain):
                        to[i] = self._one(word, logs)[-1] / LOG10
                continue
            arcs = self.arcs(group.T)
            for to, logs in zip(out, weights):
                to[at] = self._sums(arcs, len(group), group.shape[1], logs)[-1] / LOG10
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words."""
        out, plain = np.zeros(len(self.pieces)), logs.tolist()
        for at, group in self._groups(words):
            if len(at) < FEW:
                for k, word in zip(at, group):
                    ahead, behind = np.array(self._one(word, plain)), np.array(self._one(word, plain, True))
                    for starts, sizes, pieces in self._steps(word):
                        i = np.array(starts)
                        use = np.exp(ahead[i] + logs[pieces] + behind[i + sizes] - ahead[-1])
                        out += np.bincount(pieces, weights=use * counts[k], minlength=len(out))
                continue
            many, n = group.shape
            arcs = self.arcs(group.T)
            ahead, behind = self._sums(arcs, many, n, logs), self._sums(arcs, many, n, logs, True)
            for size, piece in enumerate(arcs, 1):
                i, k = np.nonzero(piece >= 0)
                if len(i):
                    p = piece[i, k]
                    use = np.exp(ahead[i, k] + logs[p] + behind[i + size, k] - ahead[n, k])
                    out += np.bincount(p, weights=use * counts[at[k]], minlength=len(out))
        return out


@functools.lru_cache(maxsize=2)
def start_lattice(name: str = VOCABULARY) -> Lattice:
    """The existing vocabulary with the weights that follow from its scores."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    weights: dict[bytes, float] = {bytes([b]): 1e-7 for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if piece and b" " not in piece[1:]:
                weights[piece] = 1.0 / (10.0 - model.get_score(i))
    pieces = sorted(weights)
    logs = np.log(np.array([weights[p] for p in pieces]))
    return Lattice(pieces, logs - np.log(np.exp(logs).sum()))


def _words(text: bytes | None) -> list[bytes]:
    """A-Z lowered, split at ASCII white space: what bytes.lower and bytes.split do."""
    return text.lower().split() if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    train, rest = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        words = list({**train, **rest})
        out = pa.RecordBatch.from_pydict(
            {
                "word": pa.array(words, pa.binary()).cast(pa.string()),
                "c": pa.array([train[w] for w in words], pa.int64()),
                "seen": pa.array([train[w] + rest[w] for w in words], pa.int64()),
            }
        )
        train.clear()
        rest.clear()
        return out

    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        for text, held in zip(texts, batch.column("held_out").to_pylist()):
            to = rest if held else train
            to.update(_words(text))
            to[b""] += 1  # the end
            if len(train) + len(rest) > FLUSH:
                yield flush()
    yield flush()


def _expect(logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = start_lattice()
        total = np.zeros(len(lattice.pieces))
        for words, batch in _joined(batches):
            total += lattice.expected(words, batch.column("c").to_numpy().astype(float), logs)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(at), "n": pa.array(total[at])})

    return common.tidy(run)


def _spell(logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = start_lattice()
        for words, batch in _joined(batches):
            columns = [c.combine_chunks() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, lattice.log10(words, lattice.logs, logs))], names=["word", "c", "seen", "vocab", "model"])

    return common.tidy(run)


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 40_000) -> Iterator[tuple[list[bytes], pa.Table]]:
    """Batches of words, several together: words of one length are then many."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[list[bytes], pa.Table]:
        joined = pa.Table.from_batches(held)
        held.clear()
        return joined.column("word").cast(pa.large_binary()).to_pylist(), joined

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= common.ARROW_BYTES:
            yield out()
    if held:
        yield out()


def _short(word: str) -> Column:
    """A word, or the digest of one of more than LONG bytes behind a tab, which no word holds."""
    return F.when(F.octet_length(word) > LONG, F.concat(F.lit("\t"), F.sha2(F.col(word).cast("binary"), 256))).otherwise(F.col(word)).alias(word)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocab_score for ``docs``
    (doc_id, text, held_out boolean)."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out")
    counted = docs.select("text", "held_out").mapInArrow(common.tidy(_count), "word string, c long, seen long")
    words = common.cut(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen")), "lm-counts")
    total, kinds, ends = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0))
    ).first()

    start = start_lattice()
    logs, n = start.logs, float(total)
    for _ in range(STEPS if kinds > 1 else 0):
        known = words.filter("c > 0 AND word <> ''").select("word", "c")
        sums = known.mapInArrow(_expect(logs), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row per piece at most
        fresh = np.exp(start.logs) * PRIOR * sums.n.sum()
        np.add.at(fresh, sums.piece.to_numpy(), sums.n.to_numpy())
        logs = np.log(fresh / fresh.sum())
    rest = math.log10(1 - ends / n if n else 0.5) if kinds != 1 else math.log10(0.5)
    spelt = words.filter("word <> ''").mapInArrow(_spell(logs), "word string, c long, seen long, vocab double, model double")
    base = F.log10((F.col("c") + 0.5) / (n + 0.5 * (kinds + 1)))
    words = common.cut(spelt.select(_short("word"), "c", "seen", base.alias("base"), (F.col("model") + rest).alias("model"), (F.col("vocab") + rest).alias("vocab")), "lm-words")
    base_end = math.log10((ends + 0.5) / (n + 0.5 * (kinds + 1)))
    model_end = math.log10(ends / n) if ends and kinds > 1 else math.log10(0.5)

    # The least count from which on the words take at most HEAVY_BYTES: a bound on what is broadcast. Long words are
    # known by a digest, so that none of them fills it.
    size = F.sum(F.octet_length("word") + ROW_BYTES)
    sizes = words.groupBy("seen").agg(size.alias("size")).filter("seen > 1").orderBy(F.desc("seen")).limit(HEAVY_BYTES // ROW_BYTES).toPandas()
    sizes = sizes[sizes["size"].cumsum() <= HEAVY_BYTES]
    least = int(sizes.seen.min()) if len(sizes) else 1 << 62
    heavy = words.filter(F.col("seen") >= least).toPandas()
    sent = spark.sparkContext.broadcast({w.encode(): (int(c > 0), b, m, v) for w, c, b, m, v in zip(heavy.word, heavy.c, heavy.base, heavy.model, heavy.vocab)})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            rows = batch.column("row").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            held = batch.column("held_out").to_pylist()
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            out: list[list] = [[] for _ in _PARTS]
            for row, doc_id, text, h in zip(rows, ids, texts, held):
                toks = _words(text)
                k, b, m, v = int(ends > 0), base_end, model_end, model_end
                far = Counter()
                for w in toks:
                    if len(w) > LONG:
                        w = b"\t" + hashlib.sha256(w).hexdigest().encode()
                    hit = known.get(w)
                    if hit:
                        k += hit[0]
                        b += hit[1]
                        m += hit[2]
                        v += hit[3]
                    else:
                        far[w] += 1
                for column, x in zip(out, (row, doc_id, h, None, len(toks) + 1, k, b, m, v)):
                    column.append(x)
                for w, c in far.items():
                    for column, x in zip(out, (row, None, None, w, c, None, None, None, None)):
                        column.append(x)
                if len(out[0]) > 200_000:
                    yield _rows(out)
                    out = [[] for _ in _PARTS]
            yield _rows(out)

    kind = "row long, doc_id long, held_out boolean, word string, n long, known long, base double, model double, vocab double"
    parts = common.cut(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(common.tidy(split), kind), "lm-parts")
    far = parts.filter("word IS NOT NULL").select("row", "word", "n").join(words.select("word", "c", "base", "model", "vocab"), "word")
    sums = [F.sum(F.col("n") * F.col(c)).alias("far_" + c) for c in ("base", "model", "vocab")]
    far = far.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("far_known"), *sums)
    whole = parts.filter("word IS NULL").drop("word").join(far, "row", "left")
    both = lambda c: F.col(c) + F.coalesce("far_" + c, F.lit(0))
    return whole.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        both("known").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        both("base").alias("base_score"),
        both("model").alias("score"),
        both("vocab").alias("vocab_score"),
    )


_PARTS = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "word": None, "n": pa.int64(), "known": pa.int64(), "base": pa.float64(), "model": pa.float64(), "vocab": pa.float64()}


def _rows(out: list[list]) -> pa.RecordBatch:
    columns = [pa.array(x, pa.binary()).cast(pa.string()) if k is None else pa.array(x, k) for x, k in zip(out, _PARTS.values())]
    return pa.RecordBatch.from_arrays(columns, names=list(_PARTS))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("held_out", common.crc_mod("doc_id", 5) == 1))
