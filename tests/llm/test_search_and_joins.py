"""Hard negatives, parity-sketch join and ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import near_brute

from sievework.llm import bpe, hardneg, lexical, minhash, parity, queries, texts

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- hard negatives

def negatives_brute(rows, positives=5, negatives=3):
    sound = [(i, v, [math.floor(256 * x) for x in e], label) for i, (v, e, label) in enumerate(rows)
             if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]

    def score(a, b):
        return sum(x * y for x, y in zip(a[2], b[2]))

    def order(pair):
        s, r = pair
        return -s, r[1] is None, r[1] or 0, r[0]

    out = []
    for a in sound:
        if a[1] is None or a[1] % 10:
            continue
        best = sorted(((score(a, r), r) for r in sound if r[0] != a[0] and r[3] == a[3]), key=order)[:positives]
        for ps, p in best:
            hard = sorted(((score(a, r), r) for r in sound if r[3] != a[3]), key=order)
            hard = [(s, r) for s, r in hard if 50 * ps <= 100 * s <= 95 * ps][:negatives]
            out += [(a[1], p[1], k + 1, r[1], ps, s) for k, (s, r) in enumerate(hard)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(230):
        vec = [rng.choice([-0.5, -0.25, 0.0, 0.3, 0.5, 1.7]) for _ in range(rng.choice([6, 6, 6, 3, 0]))]
        rows.append((i, vec, rng.randrange(4)))
    rows += [(10, rows[10][1], rows[10][2]), (None, [0.5] * 6, 1), (240, None, 1), (250, [0.5] * 6, None), (260, [0.5, None], 1),
             (270, [float("nan"), 1.0], 2), (280, [float("inf")], 2), (290, [0.5] * 6, 9), (300, [0.5] * 6, 1), (None, [1.0, 1.0], 2)]
    rng.shuffle(rows)
    monkeypatch.setattr(hardneg, "ROW_BLOCK", 50)
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(hardneg, "SCORES", 300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    df = df.withColumn("uid", F.lit("x")).withColumn("id", F.lit(1)).withColumn("rank", F.lit(2))
    got = hardneg.mine(df, F.col("vec_id") % 10 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == negatives_brute(rows)
    assert hardneg.mine(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert hardneg.mine(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("most, width", [(3, 70), (300, 64), (1 << 20, 300), (1 << 26, 11), (0, 5)])
def test_residue_product_is_exact(most, width):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-most, most + 1, (n, width)) for n in (9, 13))
    a[0], b[0], b[1] = -most, most, -most
    primes = hardneg.moduli(a, b)
    got = hardneg.residue_product(hardneg.residues(a, primes), hardneg.residues(b, primes), primes)
    assert (got.astype(object) == a.astype(object) @ b.T.astype(object)).all()


def test_first_columns_of_wide_and_narrow_scores():
    rng = np.random.default_rng(4)
    scores = rng.integers(-3, 4, (20, 30))
    allowed = rng.random((20, 30)) < 0.2
    want = [sorted(np.flatnonzero(ok), key=lambda c: (-row[c], c))[:4] for row, ok in zip(scores, allowed)]
    for factor in (1, 1 << 58):
        got = hardneg.first_columns(scores * factor, allowed, 4)
        assert [[c for c in row if c >= 0] for row in got.tolist()] == want
    with pytest.raises(ValueError, match="64 bits"):
        hardneg.moduli(np.array([[1 << 31]]), np.array([[1 << 31]]))


# --- parity sketches

def test_sketch_distance_never_exceeds_the_difference_of_sets():
    rng = np.random.default_rng(7)
    for n in (1, 5, 40, 700):
        pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        for words in (1, 3, 40):
            a, b = np.unique(pool[:n]), np.unique(rng.choice(pool, n))
            flat, held, offs = parity.sketches([a, b, a[:0]], np.array([words] * 3), 5)
            one, other, empty = (flat[x:y] for x, y in zip(offs, offs[1:]))
            assert int(np.bitwise_count(one ^ other).sum()) <= len(np.setxor1d(a, b)) and not empty.any()
            assert int(np.bitwise_count(one).sum()) % 2 == len(a) % 2 and held.sum() == len(a) + len(b)


@pytest.mark.parametrize("per_mille", [500, 800, 900, 1000])
def test_bands_leave_no_similar_sizes_apart(per_mille):
    bands = parity.Bands(per_mille, 10_000)
    for a in [*range(1, 300), 1000, 4321]:
        most = 1000 * a // per_mille
        for b in {a, (a + most) // 2, most}:
            low, high = bands.of(np.array([a, b])).tolist()
            assert high - low in (0, 1)
            both = -(-per_mille * (a + b) // (1000 + per_mille))
            assert a + b - 2 * both + 2 * bands.left_out(low) < bands.words(low)


@pytest.mark.parametrize("crowd, block, threshold, width", [(256, 256, 0.8, 5), (5, 4, 0.9, 3)])
def test_join_links_near_copies(spark, monkeypatch, crowd, block, threshold, width):
    rng = random.Random(width)
    rows = []
    for d in range(150):
        words = [f"w{i}" for i in range(rng.choice([60, 150]))]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((1000 - d, " ".join(words)))
    rows += [(d, " ".join(f"t{(d * 7 + i) % 13}" for i in range(d % 14))) for d in range(60)]
    rows += [(70, "a b c d e f"), (70, "g h i j k l"), (71, "A b C d e f"), (70, ""), (72, "g h i j k l"), (None, "a b c d e f"), (73, None)]
    monkeypatch.setattr(parity, "CROWD", crowd)
    monkeypatch.setattr(parity, "PARTS", crowd)
    monkeypatch.setattr(parity, "LEADERS", 2)
    monkeypatch.setattr(parity, "LEAVE", 3)
    monkeypatch.setattr(parity, "BLOCK", block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("set", F.lit("s")).withColumn("n", F.lit(1))
    label = near_brute([(d, t or "") for d, t in rows if d is not None], width, round(1000 * threshold))
    got = parity.join(df, width=width, threshold=threshold).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((d, label[d]) for d, _ in rows if d is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_join_of_odd_rows(odd, clashing, none, texts_of):
    rows = texts_of(odd)
    label = near_brute([(d, t) for d, t in rows if d is not None], 5, 800)
    got = parity.join(clashing).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((d, label[d]) for d, _ in rows if d is not None)
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert parity.join(none).count() == 0


def test_turns_of_a_join_take_few_tasks(spark, monkeypatch):
    """The driver keeps a record of every task, so later turns, with little left to compare, run few."""
    rng = random.Random(8)
    rows = []
    for d in range(150):
        words = [f"w{i}" for i in range(150)]
        for _ in range(rng.choice([0, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((d, " ".join(words)))
    monkeypatch.setattr(parity, "CROWD", 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before, sc = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", 150)
    sc.setJobGroup("turns", "turns of a join")
    try:
        got = parity.join(df, width=3, threshold=0.9).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("turns") for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    label = near_brute(rows, 3, 900)
    assert {r.doc_id: r.component_id for r in got} == label
    assert tasks < 1500


def test_sets_of_few_numbers_are_not_shuffled(spark, monkeypatch):
    sets = spark.createDataFrame([(i, i, 0, b"x" * 8) for i in range(50)], "uid long, node long, band long, items binary")
    uids = spark.createDataFrame([(3,), (7,), (3,), (99,)], "uid long")
    for few in (4, 3):
        monkeypatch.setattr(parity, "FEW", few)
        got = parity._picked(sets, uids, 4)
        assert {r.uid for r in got.join(uids, "uid").collect()} == {3, 7}
        assert got.count() == (2 if few == 4 else 50)


def test_no_false_links_of_crafted_texts(spark):
    """Words on which polynomial hashes modulo powers of two agree for every base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one + " x y z"), (4, one.translate(str.maketrans("ab", "ba")) + " x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for got in (minhash.near_groups(df), parity.join(df)):
        assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_word_hashes_depend_on_the_key():
    data = np.frombuffer(b"a bb a", np.uint8)
    offs = np.array([0, 6])
    (one, rows), (other, _) = texts.word_hashes(data, offs, b"1"), texts.word_hashes(data, offs, b"2")
    assert rows.tolist() == [0, 3] and one[0] == one[2] != one[1] and not (one == other).any()


def test_words_are_hashed_together_under_a_key(monkeypatch):
    data, key = np.arange(64, dtype=np.uint8), bytes(range(16))
    # The hashes of the first 0, 1, 8 and 15 bytes that the function's authors give.
    for n, want in ((0, "310e0edd47db6f72"), (1, "fd67dc93c539f874"), (8, "6224939a79f5f593"), (15, "e545be4961ca29a1")):
        assert texts.keyed_hashes(data, np.array([0, n]), key).astype("<u8").tobytes().hex() == want
    offs = np.sort(np.random.default_rng(5).integers(0, 65, 200))
    alone = [texts.keyed_hashes(data, offs[i:i + 2], key)[0] for i in range(199)]
    assert texts.keyed_hashes(data, offs, key).tolist() == alone
    calls, plain = [], texts.hashlib.blake2b
    monkeypatch.setattr(texts.hashlib, "blake2b", lambda *a, **k: calls.append(a) or plain(*a, **k))
    monkeypatch.setattr(texts, "HASHED", 100)
    words = [f"{i}é" for i in range(1000)] + ["x" * 256, "x" * 257, "y" * 5000, "0é", "y" * 5000, "x" * 257 + "z"]
    piece = np.frombuffer(" ".join(words).encode(), np.uint8)
    found, rows = texts.word_hashes(piece, np.array([0, len(piece)]), b"key")
    assert len(calls) <= 5 and rows.tolist() == [0, len(words)]
    assert len(set(found.tolist())) == len(set(words)) and found[0] == found[1003] and found[1002] == found[1004]


# --- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search_brute(docs, queries, k):
    docs = [(i, d, Counter(TERM.findall((t or "").translate(AZ)))) for i, (d, t) in enumerate(docs)]
    docs = [x for x in docs if x[2]]
    n, total = len(docs), sum(sum(c.values()) for _, _, c in docs)
    df = Counter(t for _, _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for q, text in queries:
        asked, scores = Counter(TERM.findall((text or "").translate(AZ))), []
        for i, d, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(times * weight[t] * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(q, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, shard, batch, step", [(1, 300, 3, 1), (2, 1 << 20, 256, 64)])
def test_search(spark, monkeypatch, seed, shard, batch, step):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "日本", "A1", "a1"]

    def text(n):
        return "".join(rng.choice(words[:rng.choice([5, 44])]) + rng.choice([" ", "_", "\n", "-"]) for _ in range(n))

    docs = [(i, text(rng.choice([1, 5, 30]))) for i in range(150)] + [(3, "w1 w2"), (None, "w1 w2 w3"), (200, None), (201, ""), (202, " .! ")]
    docs += [(300 + i, "w1 w2 w3") for i in range(30)] + [(400, "w7 " * 20_000)]
    queries = [(i, text(rng.choice([1, 4, 12]))) for i in range(12)] + [(3, "w1 w1 w1"), (None, "w2 zz"), (50, None), (51, "nowhere"), (52, "w1 w2 w3")]
    rng.shuffle(docs)
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BATCH", batch)
    monkeypatch.setattr(lexical, "STEP", step)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("shard", F.lit("x")).withColumn("term", F.lit(1))
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("uid", F.lit(1)).withColumn("rank", F.lit(1))
    shards = lexical.store(lexical.index(frame))
    for k in (1, 20):
        got = lexical.search(shards, asked, k)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == search_brute(docs, queries, k)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    for d, q in ((docs.where("false"), queries), (docs, queries.where("false")), (docs.where("text IS NULL"), queries)):
        assert lexical.search(lexical.store(lexical.index(d)), q).count() == 0


def test_reading_stops_early_and_never_below_the_best():
    rng = np.random.default_rng(3)
    docs = np.arange(20_000)
    lists = [lexical.ImpactList(docs, np.sort(rng.integers(1, 100, 20_000))[::-1].copy()) for _ in range(3)]
    found, score, read = lexical.best_positions(lists, [1, 1, 1], 20_000, 10)
    assert read < 20_000 and score.max() == sum(int(x.impacts[0]) for x in lists)
    flat = [lexical.ImpactList(docs, np.full(20_000, 5)) for _ in range(2)]
    found, score, read = lexical.best_positions(flat, [1, 2], 20_000, 10)
    assert len(found) == 20_000 and set(score.tolist()) == {15}


# --- tokens

def test_stored_ids_decode_to_the_texts(spark, odd, none):
    ranks, pattern = queries.tokenizer()
    for df in (odd, none):
        encoded = bpe.encode_documents(df, ranks, pattern).select("doc_id", "text", "ids").withColumnRenamed("text", "was")
        back = bpe.decode_documents(encoded, ranks, pattern)
        assert back.columns == ["doc_id", "was", "ids", "text"]
        assert all((r.was or "") == r.text for r in back.collect())
    with pytest.raises(Exception, match="no token"):
        bpe.decode_documents(spark.createDataFrame([([10 ** 9],)], "ids array<int>"), ranks, pattern).collect()


def test_transducer_tables_stay_bounded_within_a_piece(monkeypatch):
    ranks, _ = queries.tokenizer()
    with open(ranks, "rb") as f:
        machine = bpe.Transducer(bpe.read_ranks(f.read()))
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)).encode()
    whole = machine.encode(text)
    monkeypatch.setattr(bpe, "STATES", 500)
    monkeypatch.setattr(bpe, "PAIRS", 900)
    machine.reset()
    assert machine.encode(text) == whole
    assert len(machine._states) < 600 and len(machine._agree) < 2000


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_new_words_go_side_by_side(monkeypatch, name):
    ranks, pattern = queries.tokenizer(name)
    with open(ranks, "rb") as f:
        coder = bpe.Codec(f.read(), pattern)
    rng = random.Random(7)
    bits = ["th", "er", "ê", "ßch", "e", "日", "\U0001f600", "qu", "aa", "ing", "Z", "=", "12"]
    words = list({"".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(3000)})
    machine, resets = coder.transducer, []
    alone = [np.array(machine.encode(w.encode()), "<u4").tobytes() for w in words]
    assert all(a == np.array(machine.merge(w.encode()), "<u4").tobytes() for a, w in zip(alone[:500], words))
    monkeypatch.setattr(bpe, "SIDE_WORDS", 700)
    assert machine.encode_all([w.encode() for w in words]) == alone
    # Words that no state is kept for do not make the kept ones over and over.
    monkeypatch.setattr(bpe, "STATES", 500)
    monkeypatch.setattr(machine, "reset", lambda: resets.append(type(machine).reset(machine)))
    short = [w for w in words if len(w.encode()) <= bpe.SIDE_BYTES]
    text = " ".join(short)
    coder.known.clear()
    assert b"".join(coder.decode(coder.encode(text))) == text.encode() and not resets
