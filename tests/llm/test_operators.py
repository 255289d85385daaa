"""The operators on small fixtures: nulls, empty tables, ties, repeated rows, and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlattice.llm import byte_bpe, common, exact_dedup, language_id, lattice_lm, mixing, near_dedup, page_text, shingles, token_counts, toxicity, vector_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, row string"


def docs(spark, texts, sources=None):
    """Documents with extra columns whose names operators use inside."""
    rows = [(i, t, "en", sources[i] if sources else "s", 0, "k", 1, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "   \t", "one", "One  two\n three", "one two three", "one two three", "é" * 3, "x " * 3000]


def test_exact_dedup(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, ODD)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD]
    for i, t in enumerate(norm):
        assert got[i].keep_id == norm.index(t) and got[i].group_size == norm.count(t) and got[i].kept == (norm.index(t) == i)
        assert bytes(got[i].digest) == hashlib.sha256(t.encode()).digest()


def test_exact_dedup_checks_bytes(spark):
    weak = F.substring(F.sha2(F.col("norm").cast("binary"), 256), 1, 1)  # different texts meet
    texts = [f"t{i % 20}" for i in range(60)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs(spark, texts), digest=weak).collect()}
    assert got == {i: (i % 20, 3) for i in range(60)}


def test_exact_dedup_repeated_rows_and_columns(spark):
    d = docs(spark, ["a", "a", "b"])
    out = exact_dedup.drop_exact_copies(d.union(d))
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [0, 2]


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(docs(spark, ["x"]).limit(0)).count() == 0


def test_exact_dedup_over_batches(spark, tmp_path):
    """A second batch meets the first one in the same folder, and is checked against its bytes."""
    state = f"file://{tmp_path}/state"
    first = spark.createDataFrame([(5, "a  b"), (6, "c"), (7, "a b")], "doc_id long, text string")
    second = spark.createDataFrame([(8, "c"), (1, "a b"), (9, "d"), (None, "d")], "doc_id long, text string")
    one = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(first, state=state).collect()}
    assert one == {5: (5, 2, True), 7: (5, 2, False), 6: (6, 1, True)}
    two = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(second, state=state).collect()}
    assert two == {8: (6, 2, False), 1: (1, 3, True), 9: (9, 2, True), None: (9, 2, False)}
    third = exact_dedup.drop_exact_copies(spark.createDataFrame([(6, "c"), (11, "e")], "doc_id long, text string"), state=state)
    assert [r.doc_id for r in third.collect()] == [11]


def test_exact_dedup_of_one_large_group(spark, monkeypatch):
    """More groups than may be broadcast, one of them with a third of all rows."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(common, "HOT", 4)
    texts = ["hot"] * 400 + [f"t{i // 2}" for i in range(800)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    assert got == {i: (0, 400, i == 0) if i < 400 else (i - i % 2, 2, i % 2 == 0) for i in range(1200)}


def test_exact_dedup_never_shuffles_texts_of_a_large_group(spark, monkeypatch):
    """Beyond the broadcast, the join that carries texts takes hot groups apart: no task gets them all."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT", 4)
    groups = spark.createDataFrame([(b"h", 1, 1, 1, 900), (b"c", 2, 1, 2, 2)], "digest binary, keep_id long, keep_batch int, keep_row long, group_size long")
    rows = spark.createDataFrame([(b"h", i, "x" * 50) for i in range(900)] + [(b"c", i, "y") for i in range(2)] + [(b"s", 0, "z")], "digest binary, doc_id long, norm string").repartition(4)
    hot = F.col("group_size") > 300
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how, n in (("inner", 902), ("left", 903)):
            out = exact_dedup._with_groups(rows, groups, 2, hot, how)
            per_task = out.withColumn("task", F.spark_partition_id()).filter("digest = X'68'").groupBy("task").count().collect()
            assert out.count() == n and len(per_task) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_copies_with_null_and_repeated_ids(spark):
    rows = [(None, "a", 1), (None, "a", 2), (3, "a", 3), (4, "b", 4), (4, "b", 5), (None, "c", 6), (None, "c", 7), (None, None, 8), (9, "", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    stays = [sorted(r.digest for r in exact_dedup.drop_exact_copies(d.repartition(n)).collect()) for n in (1, 5)]
    assert stays[0] == stays[1] and len(stays[0]) == 4 and {3, 9} < set(stays[0]) and len({4, 5} & set(stays[0])) == len({6, 7} & set(stays[0])) == 1


def test_mixing(spark):
    rng = random.Random(3)
    texts = [" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for _ in range(600)] + [None, ""]
    sources = [rng.choice(["a", "a", "a", "b", "c", "d"]) for _ in texts]
    sources[-1] = None
    d = docs(spark, texts, sources)
    found = mixing.mix(d).toPandas()
    again = mixing.mix(d).toPandas()
    key = lambda f: dict(zip(f.doc_id, f.taken))
    assert key(found) == key(again) and len(found) == len(texts)
    assert (found.taken <= 3 * found["size"]).all()
    assert math.isclose(found.groupby("source", dropna=False).target.first().sum(), found["size"].sum())
    for _, g in found.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(3, g["size"].max())
    assert mixing.mix(d.limit(0)).count() == 0
    assert mixing.mixed_rows(d).count() == found.copies.sum()


def targets_by_loop(sizes):
    """The target weights by the words of the contract: share, cut at 3 times the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        more = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, m in more.items():
            target[s] += m
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixing_targets_by_loop(spark):
    rng = random.Random(5)
    for n in (1, 4, 40):
        names = [None, "", "a", "B", "é", "\U0001f600", "\uffee", *(f"s{i}" for i in range(n))]
        sizes = {s: rng.choice([0, 1, 30, 500, 20_000]) for s in names}
        frame = spark.createDataFrame([(s, v, 1) for s, v in sizes.items()], "source string, source_size long, docs long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        want = targets_by_loop(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in want)


def test_mixing_agrees_however_rows_are_dealt(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = rows.union(rows.filter("doc_id % 9 = 0")).union(rows.filter("doc_id % 9 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    taken = lambda d: sorted(map(tuple, mixing.mix(d).select("doc_id", "size", "source", "taken").fillna(-1, ["doc_id"]).fillna("", ["source"]).collect()))
    first = taken(rows)
    assert first == taken(rows.repartition(7)) == taken(rows.orderBy(F.rand(1)).coalesce(2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert first == taken(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mixing_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rows = [(1, "a b c", "x", 0)] * 100 + [(i, "d " * (i % 7 + 1), "y", i) for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    found = mixing.mix(d).toPandas()
    back = mixing.mixed_rows(d).toPandas()
    assert len(found) == 200 and back.groupby("source").text.count().to_dict() == found.groupby("source").copies.sum().to_dict()
    for _, g in found.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() and g.copies.max() <= 3
    assert found[found.source == "x"].copies.max() - found[found.source == "x"].copies.min() <= 1


def test_mixed_rows_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"t{i} " + "w " * rng.randint(1, 30), rng.choice("aaabc")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    took = {s: (taken, target) for s, taken, target in mixing.mix(d).groupBy("source").agg(F.sum("taken"), F.first("target")).collect()}
    got = [r.asDict() for r in mixing.mixed_rows(d).collect()]
    for s, (taken, target) in took.items():
        mine = [len(r["text"].split()) for r in got if r["source"] == s]
        assert sum(mine) == taken and abs(taken - target) <= 31
    assert max(Counter(r["text"] for r in got).values()) <= 3


def similar_groups(texts):
    """Brute force: each text's set of two-word shingles, and the smallest index it reaches."""
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = comp[i], comp[j]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    return sets, comp


def test_near_dedup_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "solo", "solo", "two words"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(10, 60))]
        for _ in range(rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    sets, comp = similar_groups(texts)
    got = {r.doc_id: r for r in near_dedup.near_dedup(docs(spark, texts), k=2).collect()}
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), comp[i], comp[i] == i)


def test_near_copies_with_null_and_repeated_ids(spark):
    base = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [
        (1, base[0]), (None, base[0].upper()),  # a copy without an id goes, and no other row without one
        (None, "unlike all the others"), (None, ""), (None, None),
        (None, base[1]), (None, base[1] + " z"),  # near copies without ids: one stays
        (5, base[2]), (5, base[3]), (4, base[3] + " z"), (6, base[2] + " z"),  # each text of a repeated id has its own copies
        (8, base[4]), (8, base[4]),
    ]
    d = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    out = near_dedup.drop_near_copies(d, k=2)
    stay = {r.row for r in out.collect()}
    assert out.columns == d.columns and stay - {5, 6, 11, 12} == {0, 2, 3, 4, 7, 9} and len(stay & {5, 6}) == len(stay & {11, 12}) == 1
    found = near_dedup.near_dedup(d, k=2).collect()
    assert sorted(r.component_id for r in found if r.doc_id is not None) == [1, 4, 4, 5, 5, 8, 8]
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(stay)


@pytest.mark.parametrize("rare", [1, 64])
def test_near_dedup_of_a_large_family(spark, monkeypatch, rare):
    """Many edited copies of one text, a part of them linked to nothing or only to each other."""
    monkeypatch.setattr(near_dedup, "RARE", rare)
    rng = random.Random(rare)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.choice([0, 2, 5, 6, 7, 8, 10])):
            t[rng.randrange(len(t))] = rng.choice([f"x{rng.randrange(12)}", "of"])
        texts.append(" ".join(t))
        if i % 16 == 0:  # a pair far from the base that is linked to each other
            t[3] = "of"
            texts.append(" ".join(t))
    sets, comp = similar_groups(texts)
    assert len(set(comp)) > 10
    got = {r.doc_id: r for r in near_dedup.near_dedup(docs(spark, texts), k=2, rounds=1).collect()}
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), comp[i], comp[i] == i)


def thue_morse(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_near_dedup_tells_thue_morse_words_apart(spark):
    """Words on which polynomial hashes modulo powers of two collide, whatever the base."""
    texts = [thue_morse(1024), thue_morse(1024, "b", "a"), thue_morse(1024) + " x", thue_morse(1024, "b", "a") + " x"]
    got = near_dedup.near_dedup(docs(spark, texts), k=2).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got) and len(got) == 4


def test_links_are_confirmed_on_words(monkeypatch):
    """With a hash under which all words look alike, only texts that share their words are linked."""
    import pyarrow as pa

    monkeypatch.setattr(shingles, "word_hashes", lambda texts: (np.ones(sum(len(t.split()) for t in texts), np.uint64), np.concatenate([[0], np.cumsum([len(t.split()) for t in texts])])))
    texts = ["a b c d e f g h", "s t u v w x y z", "a b c d e f g h h"]
    pairs = [(0, 1), (0, 2), (1, 2)]
    batch = pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "text_a": [texts[a] for a, _ in pairs], "text_b": [texts[b] for _, b in pairs]})
    (out,) = near_dedup._verifier(2, 80)(iter([batch]))
    assert out.to_pydict() == {"a": [0], "b": [2]}


def test_word_hashes():
    rng = random.Random(9)
    words = [b"", b"a", b"A", b"ab", b"x" * 8, b"x" * 9, b"x" * 255, b"x" * 256, b"X" * 3000, "é日".encode(), *(bytes(rng.choices(b"ab", k=rng.randint(1, 40))) for _ in range(300))]
    texts = [None, b" \n", *words, b"\x0b".join(words)]
    h, begin = shingles.word_hashes(texts)
    of = [h[b:e].tolist() for b, e in zip(begin, begin[1:])]
    assert of[:3] == [[], [], []] and [x for y in of[3:-1] for x in y] == of[-1]
    same = {}
    for w, x in zip(words[1:], of[-1]):
        assert same.setdefault(w.lower(), x) == x
    assert len(set(same.values())) == len(same)


def test_exact_set_sizes():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        for k in (1, 2, 5):
            of = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())  # noqa: B023, E731
            assert shingles.exact(a, b, k) == (len(of(a)), len(of(b)), len(of(a) & of(b)))


def test_sketch_estimates_jaccard():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64))
    b = np.concatenate([a[:400], np.random.default_rng(2).integers(0, 2**63, 100, dtype=np.uint64)])
    agree = (shingles.sketch(a, 2000) == shingles.sketch(b, 2000)).mean()
    assert abs(agree - 400 / 600) < 0.05
    assert (shingles.sketch(a[:1], 64) == shingles.sketch(a[:1], 64)).all()


def test_toxicity(spark):
    rng = random.Random(2)
    clean = [" ".join(rng.choice(["tree", "house", "river", "walk", "blue"]) for _ in range(40)) for _ in range(300)]
    bad = [c + " idiot moron stupid " + "grobnik grobnika" for c in clean[:80]]
    d = docs(spark, clean + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(380)], "doc_id long, toxic int")
    out = toxicity.drop_toxic(d, labels)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == {*range(300), 380, 381}
    model = toxicity.fit(d.select("doc_id", "text"), labels.limit(0))
    assert model.score(["idiot moron stupid trash", "tree", None])[0] > 0.3 > model.score(["tree", None]).max()


def test_language_id(spark):
    en, de = ["the house with the thing and that"] * 20, ["das haus mit dem ding und der"] * 20
    rows = [(i, t, l) for i, (t, l) in enumerate([*((t, "en") for t in en), *((t, "de") for t in de)])]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ask = spark.createDataFrame([(0, "that thing with the"), (1, "mit dem haus und"), (2, None), (3, "12 34 !"), (4, "")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predicted(ask, model).orderBy("doc_id").collect()] == ["en", "de", "und", "und", "und"]


def test_byte_bpe_round_trip_and_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    texts = [*ODD, "日本語 👩‍👩‍👧 ²³ ⅷ\x00", "aaaa  aaaa\n\n a's 'LL"]
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), special_tokens={})
    for r in byte_bpe.with_ids(docs(spark, texts)).select("doc_id", "bpe.*").collect():
        t = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(t) and r.n_tokens == len(r.ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_byte_bpe_offsets(spark):
    texts = [*ODD, "日本語 👩‍👩‍👧 ²³ ⅷ\x00", "a" * 100 + "é", "z" * 70 + "\U0001f600" * 3]
    out = byte_bpe.with_ids(docs(spark, texts).withColumn("bpe", F.lit("mine")), offsets=True)
    assert out.columns[-2:] == ["bpe", "bpe_"]
    bytes_of = byte_bpe.codec().bytes_of
    for r in out.select("doc_id", "bpe", "bpe_.*").collect():
        t, at = texts[r.doc_id] or "", 0
        owner = [i for i, c in enumerate(t) for _ in c.encode()]
        for token, start, end in zip(np.frombuffer(r.ids, "<u4").tolist(), r.starts, r.ends):
            n = len(bytes_of[token])
            assert (start, end) == (owner[at], owner[at + n - 1] + 1) and r.bpe == "mine"
            at += n
        assert at == len(owner)


def test_token_counts_by_full_encoding():
    encode = token_counts.encoder().encode_ordinary
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdé1") for _ in range(rng.randint(1, 8))) for _ in range(900))
    tree = token_counts.Tree(text, lambda s: len(encode(s)))
    for _ in range(60):
        a = rng.randint(0, len(text))
        b = min(len(text), a + rng.randint(0, 30))
        new = rng.choice(["", " x", "foo bar", "  ", "'s", "z" * 700])
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
        assert tree.text == text and tree.tokens == len(encode(text))
    assert tree.root.height <= 2 * math.log2(tree.segments + 1)
    tree.edit(0, len(text), "")
    assert tree.tokens == 0
    tree.edit(0, 0, "new words")
    assert tree.text == "new words" and tree.tokens == 2


def test_an_edit_encodes_and_sums_only_around_it():
    text = "alpha beta " * 20_000
    tree = token_counts.Tree(text, len)
    tree.encoded, old = 0, set()
    stack = [tree.root]
    while stack:
        node = stack.pop()
        old.add(node)
        stack += [x for x in (node.left, node.right) if x is not None]
    tree.edit(100_000, 100_005, "x")
    stack, fresh = [tree.root], 0
    while stack:
        node = stack.pop()
        if node not in old:
            fresh += 1
            stack += [x for x in (node.left, node.right) if x is not None]
    assert tree.encoded <= 6 and fresh <= 60 < len(old) and tree.text == text[:100_000] + "x" + text[100_005:]


def test_token_counts_query_by_full_encoding(spark):
    texts = [*ODD, "mail a.b@c.org or call 0123 456 789 012, now", "x" * 3000 + " a@b.co"]
    encode = token_counts.encoder().encode_ordinary
    got = {r.doc_id: r for r in token_counts.counts(docs(spark, texts)).collect()}
    for i, t in enumerate(t or "" for t in texts):
        edited = t
        for start, end, to in token_counts.redactions(t):
            edited = edited[:start] + to + edited[end:]
        assert (got[i].n_tokens, got[i].n_tokens_edited, got[i].n_edits) == (len(encode(t)), len(encode(edited)), len(token_counts.redactions(t)))
    assert got[len(ODD)].n_edits == 2 and token_counts.counts(docs(spark, texts).limit(0)).count() == 0


def test_vector_search_by_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:160] = x[100]  # equal vectors
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] * 8)]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=20).toPandas()
    hit = total = 0
    for i in range(0, 400, 20):
        s = x.astype(float) @ x[i].astype(float)
        near = [j for j in np.lexsort((np.arange(400), -s)) if j != i][:20]
        mine = got[got.query_id == i].sort_values("rank")
        assert len(mine) == 20 and list(mine["rank"]) == list(range(1, 21))
        hit += len(set(near) & set(mine.vec_id))
        total += 20
    assert hit / total >= 0.9 and set(got.query_id) == set(range(0, 400, 20))


def recall(x, got, every, k=20):
    hit = total = 0
    for i in range(0, len(x), every):
        near = [j for j in np.lexsort((np.arange(len(x)), -(x @ x[i]))) if j != i][:k]
        mine = got[got.query_id == i].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, k + 1)) and np.allclose(mine.score, x[mine.vec_id] @ x[i])
        hit += len(set(near) & set(mine.vec_id))
        total += k
    return hit / total


@pytest.mark.parametrize("shard, n", [(4096, 4096), (1000, 3500)])
def test_vector_search_recall_on_full_and_many_shards(spark, monkeypatch, shard, n):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 50)
    x = np.random.default_rng(8).normal(size=(n, 24)).astype(np.float32)
    d = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    got = vector_search.nearest(d, F.col("vec_id") % 20 == 0, shard=shard).toPandas()
    assert recall(x.astype(float), got, 20) >= 0.9


def test_vector_search_ties_repeats_and_lengths(spark):
    kind = "vec_id long, embedding array<double>, rep long, shard int, block int, vec string"
    rows = [(i, [1.0, float(i % 3)]) for i in range(40)] + [(7, [1.0, 1.0]), (7, [5.0, 5.0]), (90, [1.0] * 3), (91, [None, 1.0]), (None, [1.0, 1.0])]
    d = spark.createDataFrame([(i, e, 0, 0, 0, "") for i, e in rows], kind)
    got = vector_search.nearest(d, F.col("vec_id") % 20 == 0, k=5).collect()
    of0 = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0]  # asks (1, 0): all score 1, but 7 scores 5
    assert of0 == [(7, 5.0), (1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)]
    one = vector_search.nearest(d.filter("vec_id = 0"), F.lit(True)).count()
    assert one == 0 and vector_search.nearest(d.limit(0), F.lit(True)).count() == 0


def test_lattice_sums_all_segmentations():
    start = lattice_lm.start_lattice()
    weight = {p: math.exp(v) for p, v in zip(start.pieces, start.logs)}
    words = [b"the", b"tionable", "é日".encode(), b"|", b"y" * 25, *(b"same%03d" % i for i in range(40))]
    for w, got in zip(words, start.log10(words)[0]):
        s = b" " + w
        ahead = [1.0] + [0.0] * len(s)
        for j in range(1, len(s) + 1):
            ahead[j] = sum(ahead[i] * weight.get(s[i:j], 0.0) for i in range(j))
        assert math.isclose(got, math.log10(ahead[-1]), rel_tol=1e-9)


def lattice_of(text, weight):
    """Plain sums over all segmentations of a whole text: ways to each place, and from it to the end."""
    s, n = text, len(text)
    arcs = [(i, j, s[i:j]) for i in range(n) for j in range(i + 1, min(n, i + 30) + 1) if s[i:j] in weight]
    ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j, p in sorted(arcs, key=lambda a: a[1]):
        ahead[j] += ahead[i] * weight[p]
    for i, j, p in sorted(arcs, key=lambda a: -a[0]):
        behind[i] += behind[j] * weight[p]
    return arcs, ahead, behind


def test_lm_of_long_words_that_recur(spark, monkeypatch):
    """Long words that many texts share are neither broadcast nor taken for others, and score as with the whole word."""
    blobs = ["x" * 3000 + str(i) for i in range(4)]
    rows = [(i, f"{blobs[i % 4]} one {blobs[0]} two", i % 5 == 1) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    of = lambda: {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in lattice_lm.score(d).collect()}
    sent = []
    real = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or real(self, value))
    short = of()
    assert max(len(w) for t in sent if isinstance(t, dict) for w in t) <= 65
    monkeypatch.setattr(lattice_lm, "LONG", 10_000)
    whole = of()
    assert short.keys() == whole.keys() and all(short[i][:2] == whole[i][:2] and np.allclose(short[i][2:], whole[i][2:]) for i in whole)
    monkeypatch.setattr(lattice_lm, "HEAVY_BYTES", 400)
    few = of()
    assert all(few[i][:2] == whole[i][:2] and np.allclose(few[i][2:], whole[i][2:]) for i in whole)


@pytest.mark.parametrize("heavy", [32 << 20, 500])
def test_lm_by_brute_force(spark, heavy, monkeypatch):
    monkeypatch.setattr(lattice_lm, "HEAVY_BYTES", heavy)
    texts = [None, "", "   \t", "one", "One  two\n three", "one two three", "é" * 3, "one two unseen", "held out only only", "zq|x two"]
    held = [i % 3 == 1 for i in range(len(texts))]
    d = spark.createDataFrame([(i, t, h, "w", 1) for i, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, held_out boolean, word string, n int")
    toks = [(t or "").encode().lower().split() + [b""] for t in texts]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v, ends = sum(c.values()), len(c), c[b""]
    start = lattice_lm.start_lattice()
    vocab = {p: math.exp(x) for p, x in zip(start.pieces, start.logs)}
    weight = vocab
    for _ in range(lattice_lm.STEPS):
        uses = Counter()
        for w, k in c.items():
            if w:
                arcs, ahead, behind = lattice_of(b" " + w, weight)
                for i, j, p in arcs:
                    uses[p] += k * ahead[i] * weight[p] * behind[j] / ahead[-1]
        fresh = {p: x * lattice_lm.PRIOR * sum(uses.values()) + uses[p] for p, x in vocab.items()}
        weight = {p: x / sum(fresh.values()) for p, x in fresh.items()}
    got = lattice_lm.score(d).collect()
    assert len(got) == len(texts)
    for r in got:
        t = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        whole = b"".join(b" " + w for w in t[:-1])  # the whole text at once: no piece spans a space
        for have, of in ((r.score, weight), (r.vocab_score, vocab)):
            marginal = math.log10(lattice_of(whole, of)[1][-1]) + (len(t) - 1) * math.log10(1 - ends / n) + math.log10(ends / n)
            assert math.isclose(have, marginal, rel_tol=1e-9)


def test_lattice_of_long_and_lone_words():
    start = lattice_lm.start_lattice()
    rng = random.Random(3)
    words = [bytes(rng.choice(b"etaoin") for _ in range(n)) for n in (1, 40, 20_000)]
    alone = start.log10(words)[0]
    together = start.log10([w for w in words[:2] for _ in range(lattice_lm.FEW)])[0]
    assert np.allclose(alone[:2], together[:: lattice_lm.FEW]) and np.isfinite(alone).all()
    many = start.expected([w for w in words[:2] for _ in range(lattice_lm.FEW)], np.ones(2 * lattice_lm.FEW), start.logs)
    assert np.allclose(many, lattice_lm.FEW * start.expected(words[:2], np.ones(2), start.logs))
    assert math.isclose(start.expected(words[2:], np.ones(1), start.logs) @ [len(p) for p in start.pieces], 20_001, rel_tol=1e-6)


def test_lm_without_training_words(spark):
    d = spark.createDataFrame([(1, "a b", True), (2, None, False)], "doc_id long, text string, held_out boolean")
    for part, n in ((d, 1), (d.filter("held_out"), 0)):
        r = {x.doc_id: x for x in lattice_lm.score(part).collect()}[1]
        assert r.train_tokens == n and r.score == r.vocab_score and math.isfinite(r.score) and r.n_known == n
    assert lattice_lm.score(d.limit(0)).count() == 0


def test_page_text_on_unseen_layouts(spark):
    rng = random.Random(77)
    right = 0
    for _ in range(150):
        page = page_text.training_page(rng)
        nodes, _ = page_text.features(page_text.parse(page))
        want = [t for _, t in sorted(b for n in nodes for b in n.blocks) if page_text.MARK in t]
        right += page_text.extract(page_text.trained(), [page])[0] == "\n".join(want)
    assert right >= 140
    rows = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<article><p>a &amp; b\n c.</p><p>d</article>")], "page_id long, url string, html string")
    assert [r.text for r in page_text.texts_of(rows).orderBy("page_id").collect()] == ["", "", "a & b c.\nd"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>T</title><meta charset=x><article><p>one two.<p>three</article>", ["one two.", "three"]),
        ("<head><title>T</title>one<p>two", ["one", "two"]),
        ("<head><title>T</title><script>x<p></script></head><body><p>one", ["one"]),
        ("<article><p>one<select><option>a<option>b<p>two</article>", ["one", "two"]),
        ("<article><div>one<video src=x>no</div><p>two</p><video><p>no</p></video><p>three</article>", ["one", "two", "three"]),
        ("<article><p>one <select><option>a</select>two <canvas><p>no</p></canvas>three</p></article>", ["one two three"]),
        ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <svg><g><text>up</text><text>down</text></g></svg> <object>as text</object></p>", ["let x=1 up down as text"]),
        ("<article><p>a <math><mi>x</mi><p>one</p><svg><path d=x><p>two</p><object data=y><p>three", ["a x", "one", "two", "three"]),
    ],
)
def test_page_text_of_open_heads_and_raw_elements(page, want):
    nodes = page_text.nodes_of(page_text.parse(page))
    assert [t for _, t in sorted(b for n in nodes for b in n.blocks)] == want


def test_page_text_keeps_an_article_after_an_open_head():
    prose = "Rivers carry stones, sand and mud, and they leave them where the water is slow. " * 4
    page = f"<!DOCTYPE html><html><head><title>T</title><article><p>{prose}</p><p>{prose}</p></article>"
    assert page_text.extract(page_text.trained(), [page]) == [f"{prose.strip()}\n{prose.strip()}"]


def test_page_features_tell_the_places_of_many_siblings():
    for n in (63, 64, 200):
        _, x = page_text.features(page_text.parse("<article>" + "<p>a b.</p>" * n + "</article>"))
        assert x[1:, 19].tolist() == list(range(n)) and np.allclose(x[1:, 21], [(i + 1) / (n + 1) for i in range(n)])


@pytest.mark.parametrize("text", ["u are an idiot", "well\nu are an idiot", "'u idiot'", "(U r such an idiot)", "you're an idiot"])
def test_addressed_wherever_u_stands(text):
    voters = toxicity.Voters()
    assert voters.of(text)[voters.names.index("addressed")] == 1
    assert voters.of("an idiot and u")[voters.names.index("addressed")] == 0


def test_language_shares(spark):
    en, de = ["the house with the thing and that"] * 20, ["das haus mit dem ding und der"] * 20
    model = language_id.fit(spark.createDataFrame([*((t, "en") for t in en), *((t, "de") for t in de)], "text string, lang string"))
    texts = ["the house with the thing and that " * 9 + "das haus mit dem ding und der " * 3, "that thing with the", None, "12 34 !"]
    ask = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both, one, *none = [r.languages for r in language_id.predicted(ask, model).orderBy("doc_id").collect()]
    assert [x.lang for x in both] == ["en", "de"] and math.isclose(both[0].share + both[1].share, 1) and abs(both[0].share - 0.75) < 0.1
    assert [(x.lang, x.share) for x in one] == [("en", 1.0)] and none == [[], []]


PROSE = "Rivers carry stones, sand and mud, and they leave them where the water is slow. " * 3


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><body><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><article><h1>On rivers</h1><p>{PROSE}</p><ul><li><a href=/a>The Rhine in spring</a></li><li><a href=/b>The Loire in autumn</a></li></ul><p>{PROSE}</p></article><footer><p>All rights reserved.</p></footer></body></html>",
         ["On rivers", PROSE.strip(), "The Rhine in spring", "The Loire in autumn", PROSE.strip()]),
        (f"<body><header><p>A paper of record</p></header><main><article><h2>Mud</h2><p class=\"lead>{PROSE}</p><figure><img src=m.png><figcaption>Mud at low tide.</figcaption></figure><dl><dt>Silt</dt><dd>Fine mud.</dd></dl></article></main><div class='cookie-notice'><p>We use cookies.</p></div></body>",
         ["Mud", PROSE.strip(), "Mud at low tide.", "Silt", "Fine mud."]),
        (f"<body><div id=content><p>{PROSE}</p><svg><path d=x><p>{PROSE}</p><div class=ad><p>Buy now!</p></div><blockquote>{PROSE}</blockquote></div><div class='comments'><p>First!</p><p>I disagree with all of this, as ever.</p></div></body>",
         [PROSE.strip()] * 3),
    ],
)
def test_page_text_of_pages_by_hand(page, want):
    assert page_text.extract(page_text.trained(), [page])[0].split("\n") == want


def test_page_text_of_deep_and_empty_and_repeated_pages(spark):
    deep = "<div>" * 3000 + f"<article><p>{PROSE}</p></article>" + "</div>" * 3000
    rows = [(1, "u", deep), (2, None, f"<article><p>{PROSE}</p></article>"), (2, None, f"<article><p>{PROSE}</p></article>"), (None, "u", "<"), (3, "u", "<p class=\"x")]
    d = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.text) for r in page_text.texts_of(d).collect())
    assert [i for i, _ in got] == [0, 1, 2, 2, 3] and got[2] == got[3] == (2, PROSE.strip()) and got[4] == (3, "")
    assert page_text.texts_of(d.limit(0)).count() == 0


def test_near_dedup_links_of_a_family_become_stars(spark):
    """Members linked with several of the same few others: as many edges as members, not members times others."""
    links = spark.createDataFrame([(i, h) for i in range(100, 1100) for h in range(20) if (i + h) % 3] + [(5000, 5001), (5001, 5002)], "a long, b long")
    few = near_dedup._stars(links)
    assert few.count() < 1100 and few.filter("a = b").count() == 0
    assert sorted(near_dedup.components(few).collect()) == sorted(near_dedup.components(links).collect())
