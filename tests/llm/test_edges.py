"""Every operator and pipeline stage on odd tables: nulls in any column, empty and very long texts, ties,
repeated rows, empty tables, and columns named like those that operators use inside."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from factlattice.llm import byte_bpe, common, exact_dedup, language_id, lattice_lm, mixing, near_dedup, token_counts, toxicity

LONG = "lorem ipsum dolor " * 300_000  # 5.4 MB
BLOB = "x" * 200_000
#: Names that operators use for columns of their own.
INSIDE = "row key size n c p h kept digest keep_id group_size copies taken total target word seen base model vocab held_out bpe n_tokens ids ids_sha256 decoded_sha256 score predicted lang_pred same bands rep component_id n_shingles __fl_row __fl_toxic __fl_digest __fl_copies".split()


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, None, "", " \t", "one", "one", LONG, LONG + "more", BLOB, "the same words again and again", "the same  words again and again", "é日本 \x00 �"]
    rows = [(None if i % 4 == 0 else i % 7, t, None if i % 3 == 0 else "en", None if i % 5 == 0 else "s") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string").repartition(3)
    return common.cut(d.select("*", *(F.lit(i).alias(c) for i, c in enumerate(INSIDE))), "odd")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, 1), (1, 0, 0), (2, 1, None), (None, 0, 1), (5, 0, 7), (6, 0, 0)], "doc_id long, quality int, toxic int")


def lm(d):
    return lattice_lm.score(d.withColumn("held_out", common.crc_mod("doc_id", 5) == 1))


def language(d):
    return language_id.predicted(d, language_id.fit(d))


def toxic(d):
    from pyspark.sql import SparkSession

    none = SparkSession.getActiveSession().createDataFrame([], "doc_id long, toxic int")
    return d.select("doc_id", toxicity.score(common.text_of(), toxicity.fit(d.select("doc_id", "text"), none)).alias("score"))


#: Each gives one row per row.
EACH = {"mix": mixing.mix, "near": lambda d: near_dedup.near_dedup(d, k=2), "toxic": toxic, "counts": token_counts.counts, "language": language, "exact": exact_dedup.exact_dedup, "bpe": byte_bpe.with_ids, "lm": lm}


@pytest.mark.parametrize("name", EACH)
def test_odd_rows(odd, name):
    out = EACH[name](odd).toPandas()
    assert len(out) == 24
    for c in out.columns:
        if out[c].dtype == float and c not in ("doc_id", "component_id", "keep_id"):
            assert np.isfinite(out[c]).all(), c


@pytest.mark.parametrize("name", EACH)
def test_empty_tables(odd, name):
    assert EACH[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", EACH)
def test_all_texts_null(odd, name):
    none = odd.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    assert EACH[name](none).count() == 24


def test_repeated_rows_agree(odd):
    for name, value in (("toxic", "score"), ("language", "lang_pred"), ("counts", "n_tokens"), ("lm", "score")):
        out = EACH[name](odd).toPandas()
        assert all(len(g) % 2 == 0 for _, g in out.fillna(-1).groupby(["doc_id", value])), name


def test_language_ties_and_no_training(spark):
    d = spark.createDataFrame([("ab ba", "y"), ("ab ba", "x")], "text string, lang string")
    ask = spark.createDataFrame([(1, "ab ba ab"), (2, "?"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predicted(ask, language_id.fit(d)).collect()}
    assert got[1][0] == "x" and got[2] == got[3] == ("und", 0.0)
    assert {r.lang_pred for r in language_id.predicted(ask, language_id.fit(d.limit(0))).collect()} == {"und"}


def test_small_shares_of_a_language_are_asked_for(spark):
    """A hundredth of a long text in a clearly different language stays in its set."""
    rng = random.Random(1)
    one = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(400))
    d = spark.createDataFrame([(one("abcde"), "a"), (one("vwxyz"), "z")] * 5, "text string, lang string")
    ask = spark.createDataFrame([(1, " ".join([one("abcde")] * 5 + [one("vwxyz")[:120]]))], "doc_id long, text string")
    (r,) = language_id.predicted(ask, language_id.fit(d)).collect()
    assert r.lang_pred == "a" and [x.lang for x in r.languages] == ["a", "z"] and 0.005 < r.languages[1].share < 0.02


def test_toxicity_with_odd_labels(odd, labels):
    out = toxicity.drop_toxic(odd, labels)
    assert out.columns == odd.columns and 0 < out.count() <= 24


def test_short_mined_words_and_many_of_them(spark):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice(["tree", "house", "river", "walk", "blue"]) for _ in range(30))
    slurs = [f"{a}{b}{c}" for a in "qxz" for b in "aeiou" for c in "bcdfghjklmnpqrst"]
    bad = [plain() + " " + " ".join(rng.sample(slurs, 40)) + " gx" for _ in range(400)]
    texts = [plain() for _ in range(1200)] + bad
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 1200)) for i in range(1600)], "doc_id long, toxic int")
    voters = toxicity.fit(d, labels).voters
    assert "gx" in voters.mined and len(voters.mined) + len(voters.stems) > 200


def test_toxicity_on_held_out_rows(spark):
    """Rows made from words that no list holds: learned from labelled rows, judged on others."""
    rng = random.Random(6)
    vocabulary, slurs = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)], ["grumbulk", "snivelord", "fopdoodler"]
    rows = []
    for i in range(900):
        bad = rng.random() < 0.25
        words = [rng.choice(vocabulary) for _ in range(50)] + [rng.choice(slurs) for _ in range(3 * bad)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i < 600], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    guess = model.score([t for i, t, _ in rows if i >= 600]) >= toxicity.THRESHOLD
    truth = np.array([b for i, _, b in rows if i >= 600]) == 1
    assert (guess == truth).mean() > 0.98


def test_stages_on_odd_rows(spark, odd, labels, tmp_path):
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), f"file://{tmp_path}").count() == 0, name
        out = common.cut(stage(spark, docs, f"file://{tmp_path}"), "odd-stage")
        assert set(docs.columns) <= set(out.columns) and (out.columns == docs.columns or name == "byte_bpe")
        assert [out.schema[c].dataType for c in docs.columns] == [f.dataType for f in docs.schema]
        if name != "byte_bpe":
            docs = out
    assert {"n_tokens_", "ids_", "bpe"} <= set(out.columns)
    kept = [r.text for r in docs.select("text").distinct().collect()]
    assert len(kept) == docs.select("text").distinct().count() and docs.count() > 0


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Far:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Far()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_lookup_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "SALT_ROWS", 10)
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, v long")
    right = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "k long, t string")
    got = sorted(map(tuple, common.lookup(left, right, "k", "v").select("k", "v", "t").collect()))
    assert got == sorted((k, v, f"t{k}") for k, v in ((1 if i % 3 else i, i) for i in range(300)))
