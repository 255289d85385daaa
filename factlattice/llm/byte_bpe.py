"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

The ranks file becomes a tokenizers BPE model: bytes are mapped to printable characters (the byte
table), and each way to split a token into two tokens is a merge with the rank of the whole token. The
pre-token pattern cuts a text into pieces; each distinct piece is encoded once per batch (short pieces
that were seen lately come from a bounded cache), and a text's ids are its pieces' ids in order. Decoding
looks ids up in the reversed byte table and joins bytes, so a character that is split over several ids
comes back whole. An id's offsets are the characters that its bytes touch.

Defined results: null text counts as empty; an empty text has no ids and no bytes; texts may be of any
length (Arrow batches are bounded by bytes, a longer text comes alone); an empty table gives an empty
result; repeated rows are encoded each; other columns are ignored by the query and carried by
``with_ids``, whose own column gets underscores until its name is free.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces, of up to so many characters, whose ids a worker remembers; beyond it the memory is emptied.
CACHE, SHORT = 150_000, 64


def byte_table() -> list[str]:
    """Byte -> character: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encoder and decoder for one ranks file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_table()
        as_chars = lambda token: "".join(chars[b] for b in token)
        merges = [
            (as_chars(token[:i]), as_chars(token[i:]))
            for token in sorted(ranks, key=ranks.get)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        vocab = {as_chars(token): rank for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self._model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))
        self._model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {rank: bytes(back[c] for c in token) for token, rank in vocab.items()}
        self._cache: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces, encoded as one pretokenized sequence: the model sees each on its own."""
        fresh = [p for p in pieces if p not in self._cache]
        if len(self._cache) + len(fresh) > CACHE:
            self._cache = {}
            fresh = list(pieces)
        long_ones: dict[str, bytes] = {}
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            enc = self._model.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(enc.ids, dtype="<u4")
            ends = np.searchsorted(np.asarray(enc.word_ids, dtype=np.int64), np.arange(len(part)), side="right")
            start = 0
            for piece, end in zip(part, ends.tolist()):
                (self._cache if len(piece) <= SHORT else long_ones)[piece] = ids[start:end].tobytes()
                start = end
        return long_ones

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for start, end in _slices(texts):
            cut = [self.pieces(t) if t else [] for t in texts[start:end]]
            long_ones = self._learn({p for pieces in cut for p in pieces})
            of = self._cache.__getitem__
            for pieces in cut:
                if long_ones:
                    yield b"".join(long_ones[p] if p in long_ones else of(p) for p in pieces)
                else:
                    yield b"".join(map(of, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each id the first character its bytes touch, and the one after the last."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        first = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        sizes = [len(self.bytes_of[i]) for i in np.frombuffer(ids, dtype="<u4").tolist()]
        ends = np.cumsum(sizes, dtype=np.int64)
        starts = np.searchsorted(first, ends - sizes, side="right") - 1
        return starts.astype(np.int32), np.searchsorted(first, ends, side="left").astype(np.int32)


def _slices(texts: list[str | None], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``chars`` characters; a longer text is a run of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > chars:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


@functools.lru_cache(maxsize=2)
def codec(name: str = VOCABULARY) -> Codec:
    """The worker's codec; the file is looked up on the machine the worker runs on."""
    import public_tokenizers

    return Codec(public_tokenizers.path(name), public_tokenizers.PATTERN)


def _udf(text: Column, kind: str, rows: Callable[[Codec, list[str | None]], pd.DataFrame], name: str) -> Column:
    def every(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(name)
        for batch in batches:
            yield rows(own, batch.tolist())

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return common.tidy(every)(batches)

    return run(text)


def _frame(own: Codec, coded: list[bytes], **more) -> pd.DataFrame:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return pd.DataFrame({"n_tokens": [len(x) // 4 for x in coded], **more, "ids_sha256": [sha(x) for x in coded], "decoded_sha256": [sha(own.decode(x)) for x in coded]})


def encoded(text: Column, name: str = VOCABULARY, offsets: bool = False) -> Column:
    """Column struct(n_tokens, ids, ids_sha256, decoded_sha256) for a text column, with ``offsets`` also
    starts and ends: the characters that each id touches."""

    def rows(own: Codec, texts: list[str | None]) -> pd.DataFrame:
        ids = list(own.encode(texts))
        spans = [own.offsets(t or "", x) for t, x in zip(texts, ids)] if offsets else []
        return _frame(own, ids, ids=ids, **({"starts": [s for s, _ in spans], "ends": [e for _, e in spans]} if offsets else {}))

    return _udf(text, "n_tokens long, ids binary, " + "starts array<int>, ends array<int>, " * offsets + "ids_sha256 string, decoded_sha256 string", rows, name)


def digests(text: Column, name: str = VOCABULARY) -> Column:
    """Like ``encoded`` without the ids themselves."""
    return _udf(text, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda own, texts: _frame(own, list(own.encode(texts))), name)


def with_ids(docs: DataFrame, name: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """``docs`` with one more column ``bpe``: n_tokens, ids, (starts, ends,) ids_sha256, decoded_sha256."""
    common.ship(docs.sparkSession)
    (to,) = common.free(docs.columns, "bpe")
    return docs.withColumn(to, encoded(common.text_of(), name, offsets))


def query(spark, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", digests(common.text_of()).alias("e")).select("doc_id", "e.*")
