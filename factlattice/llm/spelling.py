"""Spelling variants: words that differ by one edit, and the common word that a rare one stands for.

A word's mask has one bit per letter: whether the letter occurs an odd number of times. One inserted or
deleted letter flips one bit and one replaced letter at most two, so of three bands of the mask at least one
is the same in both words. Words meet in a join on equal bands, with the lengths that one edit allows, and
are verified by their edit distance.

Bands alone are small (some 2^8 values that occur), so equal bands of a large vocabulary would hold long lists of
words. The join key therefore also holds what one edit leaves alone: a word is cut into ``PARTS`` parts by
the length of the shorter of two words; the edit lies in one of them, all before and after it is equal.
This loses no pair, and splits the groups of common bands by most of the letters. A pair is emitted
under the first key that it shares alone, so pairs need no deduplication.

Defined results: null text has no words; texts and words of any length are read whole; a null doc_id counts
as the empty text in the hash; repeated rows count again; an empty table gives an empty result; other columns are
ignored. Of near words equally frequent the first in code-point order is the form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Least code points of a word, least occurrences, and how many times as frequent its form must be.
LEAST, TWICE, RATIO = 7, 2, 10
BANDS, BAND_BITS, PARTS = 3, 21, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """word, n from the texts of ``docs`` (doc_id, text). Every 31st run of letters by its hash loses one
    letter, which plants variants at a known rate."""
    # Shorter runs can't become words; a run of at least so many letters still matches whole.
    runs = F.regexp_extract_all(common.text_of(), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}+"), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    run = run.select("doc", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("run"))
    run = run.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = run.select(F.when(F.col("h") % 31 == 0, less).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least)
    return word.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= twice)


def mask(word: Column) -> Column:
    """The parity mask. Letters are dealt to the bands in turn; letters beyond the bits share them, which
    keeps what one edit can flip."""

    def flip(m: Column, c: Column) -> Column:
        code = F.ascii(c)
        place = F.pmod(F.when(code < 123, code - 97).otherwise(code - 166), F.lit(BANDS * BAND_BITS))
        bit = place % BANDS * BAND_BITS + F.floor(place / BANDS)
        return m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int")))

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(flip(m, c)))


def _band(m: Column, i: int) -> Column:
    return F.shiftright(m, i * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def _around(word: Column, size: Column, short: Column, part: int) -> Column:
    """``word`` without its part, with the cuts of a word of ``short`` letters."""
    cut = [F.floor(short * j / PARTS).cast("int") for j in (part, part + 1)]
    return F.concat(F.substring(word, F.lit(1), cut[0]), F.lit(" "), F.substring(word, size - (short - cut[1]) + 1, size))


def _keys(table: DataFrame, longer: bool) -> DataFrame:
    """The keys under which a word is the shorter of a pair, or the longer one."""
    short = F.col("size") - int(longer)
    keys = [
        F.struct(F.lit(p * BANDS + b).alias("nth"), F.xxhash64(short, F.lit(p * BANDS + b), _around(F.col("word"), F.col("size"), short, p), _band(F.col("mask"), b)).alias("key"))
        for p in range(PARTS)
        for b in range(BANDS)
    ]
    return table.select("word", "n", "size", "mask", F.lit(longer).alias("longer"), F.explode(F.array(*keys)).alias("k")).select("word", "n", "size", "mask", "longer", "k.*")


def near_pairs(table: DataFrame) -> DataFrame:
    """word, n, near, near_n for all pairs of words of ``table`` (word, n; distinct) one edit apart, once."""
    table = table.select("word", "n", F.char_length("word").alias("size"), mask(F.col("word")).alias("mask"))
    one = _keys(table, False).drop("longer")
    other = _keys(table, False).unionByName(_keys(table, True)).select(*(F.col(c).alias("o_" + c) for c in ("word", "n", "size", "mask", "longer", "nth", "key")))
    # The first part and band that both share: the pair is emitted under this key alone.
    nth = F.lit(-1)
    for p in reversed(range(PARTS)):
        same = _around(F.col("word"), F.col("size"), F.col("size"), p) == _around(F.col("o_word"), F.col("o_size"), F.col("size"), p)
        nth = F.when(same, p).otherwise(nth)
    band = reduce(lambda rest, b: F.when(_band(F.col("mask"), b) == _band(F.col("o_mask"), b), b).otherwise(rest), reversed(range(BANDS)), F.lit(-1))
    pair = one.join(
        other,
        (F.col("key") == F.col("o_key"))
        & (F.col("nth") == F.col("o_nth"))
        & (F.col("o_size") == F.col("size") + F.col("o_longer").cast("int"))
        & (F.col("o_longer") | (F.col("word") < F.col("o_word")))
        & (F.col("nth") == nth * BANDS + band)
        & (F.levenshtein("word", "o_word", 1) == 1),
    )
    return pair.select("word", "n", F.col("o_word").alias("near"), F.col("o_n").alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: where the chain that starts with ``links`` (word, form; no circles) ends. Each round
    doubles the steps taken."""
    at = common.cut(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = common.cut(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")), "forms")
        if not at.filter("went").limit(1).count():
            return at.drop("went")
        at = at.drop("went")


def variants(docs: DataFrame, least: int = LEAST, twice: int = TWICE, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of ``docs`` (doc_id, text)."""
    table = common.cut(words(docs, least, twice), "words")
    pairs = common.cut(near_pairs(table), "near-words")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = both.groupBy("word").agg(F.first("n").alias("own"), F.count(F.lit(1)).alias("n_near"), best)
    good = -F.col("best.less") >= F.col("own") * ratio
    found = common.cut(found.select("word", "n_near", F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "near-best")
    ends = roots(found.filter("form IS NOT NULL"))
    out = table.join(found, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), run AS (
  SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295)) AS h
  FROM (SELECT *, hex(doc || ':' || run) AS x FROM run), tab
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substring(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h
), words AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2
), less AS (
  SELECT DISTINCT word, i, left(word, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON words.word = rest
  UNION SELECT words.word, less.word FROM less JOIN words ON words.word = rest
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min(near, (-b.n, near)) AS form, max(b.n) AS form_n, any_value(a.n) AS n
  FROM near JOIN words a ON a.word = near.word JOIN words b ON b.word = near GROUP BY 1
), forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * words.n THEN form END AS form, CASE WHEN form_n >= 10 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS top FROM forms
    UNION ALL SELECT c.word, f.form FROM c JOIN forms f ON f.word = c.top AND f.form IS NOT NULL
  ) SELECT c.word, top AS root FROM c JOIN forms f ON f.word = c.top AND f.form IS NULL
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN chain USING (word)
"""
