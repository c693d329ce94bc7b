"""Each operator against a plain computation, on the given documents and on odd rows."""

import hashlib
import random
import re
import string
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import (
    bpe, classifier, components, digests, minhash, mixing, queries, repeats, rules, secrets, texts, tokencounts, urls,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORD.findall(text.translate(AZ))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def reachable(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def near_brute(rows, width, per_mille):
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i]
             if x and y and 1000 * len(x & y) >= per_mille * len(x | y)]
    return reachable({d for d, _ in sets}, links)


@pytest.mark.parametrize("width,threshold", [(3, 0.85), (5, 0.8)])
def test_near_groups(odd, documents, texts_of, width, threshold):
    for df in (odd, documents):
        rows = texts_of(df)
        label = near_brute(rows, width, round(1000 * threshold))
        want = sorted((d if d is not None else -1, len(shingles(t, width)), label.get(d, -1), d is None or label[d] == d)
                      for d, t in rows)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept)
                     for r in minhash.near_groups(df, width=width, threshold=threshold).collect())
        assert got == want


def test_near_groups_of_a_family(spark, monkeypatch):
    """Copies that each differ a little: leaders alone miss links, the blocks find them."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 2, 3, 5, 6])):
            words[rng.randrange(200)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((1000 - d, " ".join(words)))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in minhash.near_groups(df, width=3, threshold=0.85).collect()}
    assert got == near_brute(rows, 3, 850)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_of_identifiers_with_several_texts(spark, monkeypatch, seed):
    """Each set is ruled out by its own private shingles only, and all texts of an identifier are in one component."""
    rng = random.Random(seed)
    rows = []
    for d in range(120):
        words = [f"w{i}" for i in range(200)]
        for _ in range(rng.choice([2, 3, 5, 6])):
            words[rng.randrange(200)] = f"x{rng.randrange(10 ** 6)}"
        rows += [(1000 - d, " ".join(words)), (1000 - d, " ".join(f"own{d}x{i}" for i in range(200)))]
    # Same number of shingles in one bucket, texts shared with two other identifiers, and an empty one beside them.
    rows += [(50, "a b c d e f"), (60, "g h i j k l"), (70, "a b c d e f"), (70, "g h i j k l"), (70, ""), (40, "m n o p"), (80, "m n o p"), (80, None)]
    monkeypatch.setattr(minhash, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    label = near_brute([(d, t or "") for d, t in rows], 3, 850)
    got = minhash.near_groups(df, width=3, threshold=0.85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted((d, label[d], label[d] == d) for d, _ in rows)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    s = minhash.sketches([a, b, a[:3], np.zeros(0, np.uint64)], 512)
    assert abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.08
    assert len(np.unique(s[2] & np.uint64(0xFFFFFFFF))) >= 3 and s[2].max() < 1 << 63  # every coordinate is filled
    assert minhash.n_bands(0.85) >= 20


@pytest.mark.parametrize("per_task", [50_000, 7])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr(components, "LINKS", per_task)
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)]
    links += [(1000, 1000 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = reachable({x for p in links for x in p}, links)
    assert got == {n: label[n] for p in links if p[0] != p[1] for n in p}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    # What was found, with one link more, gives the same as all links.
    more = components.stars(components.components(spark.createDataFrame(links, "a long, b long"))).unionByName(
        spark.createDataFrame([(40, 1005)], "a long, b long"))
    label = reachable({x for p in links for x in p}, links + [(40, 1005)])
    got = {r.node: r.component for r in components.components(more).collect()}
    assert got == {n: label[n] for p in links if p[0] != p[1] for n in p}


def test_drop_near_and_exact(odd, clashing, none):
    kept = minhash.drop_near(clashing)
    assert kept.columns == clashing.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert 4 not in ids and 9 not in ids and {0, 1, 5, 6, 7, 8, 11, 13} <= set(ids)
    exact = digests.drop_exact(clashing, largest=True)
    assert exact.columns == clashing.columns
    assert sorted(r.doc_id or 0 for r in exact.collect()) == [0, 3, 4, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16, 17]
    assert sorted(r.doc_id or 0 for r in digests.drop_exact(odd).collect()).count(1) == 2
    for df in (minhash.drop_near(none), digests.drop_exact(none), minhash.near_groups(none), digests.exact_groups(none)):
        assert df.count() == 0


@pytest.mark.parametrize("largest", [True, False])
def test_exact_groups(odd, documents, texts_of, largest):
    for df in (odd, documents):
        rows = [(d, t.translate(AZ)) for d, t in texts_of(df)]
        groups = {}
        for d, t in rows:
            if d is not None:
                groups.setdefault(t, []).append(d)
        want = []
        for d, t in rows:
            own = groups[t] if d is not None else [None]
            keep = None if d is None else (max if largest else min)(own)
            want.append((d, keep, len(own), d == keep, hashlib.sha256(t.encode()).hexdigest()))
        got = [tuple(r) for r in digests.exact_groups(df, largest=largest).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_merge_runs_verifies_sizes(spark):
    def run(*entries):
        rows = np.zeros(len(entries), digests._ENTRY)
        for i, (d, s, k) in enumerate(entries):
            rows[i] = (d.ljust(32, b"\0"), s, k, 1)
        return rows
    out = digests.merge_runs([run((b"b", 1, 5), (b"a", 1, 7)), run((b"a", 1, 3)), run((b"a", 2, 1))], False)
    assert [(bytes(r["digest"])[:1], r["size"], r["id"], r["rows"]) for r in out] == [
        (b"a", 1, 3, 2), (b"a", 2, 1, 1), (b"b", 1, 5, 1)]
    many = spark.range(5000).selectExpr("id AS doc_id", "concat('t', id % 700) AS text").repartition(40)
    found = digests.tree_merge(digests.digest_rows(many, "doc_id", "text"), fan=3, range_rows=100)
    assert found.count() == 700 and found.agg(F.sum("group_size"), F.sum("keep_id")).first()[:] == (5000, 699 * 350)


def repeats_brute(rows, length=50):
    first = {}
    data = [(d if d is not None else 1 << 62, t.encode()) for d, t in rows]
    for d, t in data:
        for i in range(len(t) - length + 1):
            w = t[i:i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i:i + length]] < d:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d if d < 1 << 62 else None, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk,hot", [(repeats.CHUNK, repeats.HOT_CHUNKS), (3000, 2)])
def test_remove_repeats(spark, odd, documents, texts_of, monkeypatch, chunk, hot):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "HOT_CHUNKS", hot)
    rng = random.Random(9)
    parts = ["".join(rng.choice("abc ") for _ in range(rng.choice([20, 45, 60, 90]))) for _ in range(12)]
    made = [(d, "".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for d in range(150)]
    made += [(200, "ab" * 300), (201, "x" + "ab" * 200), (202, "a" * 500), (203, "b" + "a" * 300), (204, "\0" * 120), (205, "\0" * 70)]
    mixed = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    for df in (odd, documents.limit(80) if chunk == 3000 else documents, mixed):
        got = sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=repr)
        assert got == repeats_brute(texts_of(df))


def test_clean_repeats_gives_spans_and_text(odd, texts_of, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 3000)
    rows = repeats.clean_repeats(odd).collect()
    got = sorted(((r.doc_id, len(r.kept) + sum(s.length for s in r.spans), sum(s.length for s in r.spans), len(r.spans),
                   hashlib.sha256(r.kept).hexdigest()) for r in rows), key=repr)
    assert got == repeats_brute(texts_of(odd)) and any(r.spans for r in rows)
    whole = {}
    for d, t in texts_of(odd):
        whole.setdefault(d, t.encode())
    for r in rows:
        text = bytearray(whole[r.doc_id])
        for s in reversed(r.spans):
            del text[s.start:s.start + s.length]
        assert bytes(text) == r.kept


def test_maximal_repeats_have_all_occurrences():
    text = b"xabcdeyabcdezabcdqabc"
    data = np.frombuffer(text, np.uint8)
    n = len(text)
    *found, order = repeats.maximal_repeats(data, np.arange(n), np.full(n, n), np.zeros(n, np.int64), np.zeros(n, np.int64), least=3)
    got = {text[order[a]:order[a] + k]: sorted(order[a:b + 1].tolist()) for k, a, b in zip(*(x.tolist() for x in found))}
    assert got == {b"abc": [1, 7, 13, 18], b"abcd": [1, 7, 13], b"abcde": [1, 7]}
    assert repeats.intervals(np.array([0, 3, 5, 5, 0, 3]), 3) == [(5, 1, 3), (3, 0, 3), (3, 4, 5)]


def test_no_documents_to_repeat(none):
    assert repeats.remove_repeats(none).count() == 0


def stats_brute(t):
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_stats(odd, clashing, documents, texts_of):
    for df in (odd, clashing, documents):
        got = sorted(tuple(r) for r in rules.with_stats(df, prefix="__").select(*(f"__{n}" for n in rules.STATS[:5])).collect())
        assert got == sorted(stats_brute(t) for _, t in texts_of(df))


def test_learned_rules(spark, documents, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = rules.learn(docs, labels)
    assert learned and all(r.precision >= 0.97 for r in learned)
    judged = rules.judge(docs, learned).join(labels, "doc_id")
    assert judged.where("quality = 1 AND rule IS NOT NULL").count() <= 2
    assert judged.where("quality = 0 AND kept").count() <= 0.1 * judged.where("quality = 0").count()
    assert rules.learn(docs, labels.limit(0)) == [] and rules.learn(none, labels) == []
    assert rules.judge(none, learned).count() == 0
    got = rules.judge(odd, learned)
    assert got.where("kept IS NULL OR base_failed IS NULL").count() == 0
    assert got.where("n_words < 20 AND kept").count() == 0


def test_rule_learner_finds_a_planted_conjunction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.4)
    found = rules.RuleLearner(names=["a", "b", "c"]).fit(x, bad, rng.random(4000) < 0.67)
    assert {(m, above) for m, above, _ in found[0].conditions} == {("a", True), ("b", False)}


def test_urls(spark):
    cases = [
        (1, "http://X.Net/a", "x.net", "/a", "net/", "block"), (2, "https://www.example.net/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
        (3, "ftp://Example.com/de/", "example.com", "/de/", "example.com/de/", "block"), (4, "http://a.org/fr/x", "a.org", "/fr/x", "org/fr/", "allow"),
        (5, None, "", "", None, "allow"), (6, "no scheme", "", "", None, "allow"), (7, "", "", "", None, "allow"),
        (8, "http://bad.example.co.uk?x", "bad.example.co.uk", "", None, "block"), (9, "http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (10, "http://net", "net", "", None, "allow"), (11, "http://ÄB.org#x", "Äb.org", "", None, "allow")]
    pages = [(i, u, 0) for i, u, *_ in cases] + [(100 + i, "http://bad.example.co.uk/", 1) for i in range(300)]
    pages += [(1000 + i, f"http://good{i % 9}.org/", int(i % 50 == 0)) for i in range(900)]
    df = spark.createDataFrame(pages, "page_id long, url string, bad int").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, F.col("bad"), queries.URL_RULES).collect()}
    for i, _, *want in cases:
        assert got[i] == tuple(want), (i, got[i])
    assert all(got[100 + i][3] == "block" for i in range(300)) and all(got[1000 + i][3] == "allow" for i in range(900))
    assert urls.judge(df.limit(0), F.col("bad"), queries.URL_RULES).count() == 0
    assert urls.judge(df.withColumn("bad", F.lit(None)), F.col("bad"), []).where("verdict = 'block'").count() == 0


def secrets_brute(t, table):
    data, out = t.encode(), []
    for k, r in enumerate(table):
        for m in re.finditer((r.regex if r.kind != "hex" else r"[0-9a-f]+").encode(), data):
            if len(m[r.group]) >= r.least:
                out.append((len(data[:m.start()].decode()), k, r.kind, len(data[:m.end()].decode())))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def test_secrets(spark, odd, clashing, none, documents, texts_of):
    table = secrets.BASE + secrets.MORE
    rng = random.Random(3)
    bits = ["password", "PassWd", "token", "api_key", "ApiKey", ":", "=", "'", '"', " ", "\n", "abc", "deadbeef", "0123456789abcdef",
            "AKIA", "ABCD1234", "==", "é", "-----BEGIN ", "PRIVATE KEY-----", "ghp_", "xoxb-", "eyJ", ".", "http://", "@", "a:b"]
    made = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(1500)]
    for df in (odd, clashing, documents, spark.createDataFrame(made, "doc_id long, text string")):
        got = [(r.doc_id, [tuple(s) for s in r.secret_spans]) for r in secrets.scan(df).select("doc_id", "secret_spans").collect()]
        want = [(d, secrets_brute(t, table)) for d, t in texts_of(df)]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert secrets.scan(none).count() == 0
    found = secrets.scan(odd)
    row = found.select("doc_id", *secrets.digest_columns(found)).where("doc_id = 15").first()
    assert (row.n_assign, row.n_access, row.n_hex, row.spans) == (1, 1, 0, "assign:0:24,access:29:49")
    assert row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()


@pytest.mark.parametrize("few", [1, 16, 1000])
def test_secrets_in_long_texts(monkeypatch, few):
    """Long runs and many secrets, by steps over all stretches and by walks along each."""
    monkeypatch.setattr(secrets, "FEW", few)
    rng, table = random.Random(4), secrets.BASE + secrets.MORE
    word = string.ascii_letters + string.digits
    made = ["token=" + "".join(rng.choices(word, k=30_000)), " ".join("token=" + "".join(rng.choices(word, k=8)) for _ in range(2000)),
            "".join(rng.choices("0123456789abcdef", k=30_000)), "AKIA" * 5000, "token=" * 5000, "ab://c:d@" * 3000, "eyJa.eyJb.c" * 3000,
            "-----BEGIN " * 3000, "", "é" * 30 + "0" * 30]
    data = [t.encode() for t in made]
    found = secrets.Scanner(table).spans(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))
    for d, got in zip(data, found):
        assert got == sorted(((k, m.start(), m.end()) for k, r in enumerate(table) for m in re.finditer(r.regex.encode(), d)
                              if len(m[r.group]) >= r.least), key=lambda s: (s[1], s[0]))


def test_secrets_in_a_megabyte_of_hostile_text():
    made = b"token=" + b"Z9" * 250_000 + b" " + b"secret: abcdefg " * 32_000
    begin = time.process_time()
    found = secrets.Scanner(secrets.BASE + secrets.MORE).spans(np.frombuffer(made, np.uint8), np.array([0, len(made)]))[0]
    assert len(found) == 32_001 and time.process_time() - begin < 5


def test_automaton_is_minimal_and_rejects_unknown_parts():
    a = secrets.compile_rules(["ab|cb", "x{2,3}"], False, False)
    assert len(a.accepts) == 7  # start, after a or c, after b, x, xx, xxx, and where nothing can follow
    with pytest.raises(ValueError):
        secrets.compile_rules([r"(a)\1"], False, False)


def test_training_counts_are_exact(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "train", lambda labels, counts, buckets: seen.extend(counts))
    docs = spark.createDataFrame([(1, "word " * 70_000)], "doc_id long, text string")
    classifier.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert len(seen) == 1 and seen[0][1].max() >= 70_000


def test_classifier(spark, odd, clashing, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = classifier.fit(big, labels.where(~classifier.held_out()), sample=1500)
    again = classifier.fit(big.repartition(7), labels.where(~classifier.held_out()), sample=1500)
    assert np.array_equal(model.logits, again.logits) and model.bias == again.bias
    rows = classifier.score(big, model).join(labels, "doc_id").where(classifier.held_out()).select("score", "quality").collect()
    score, good = np.array([r.score for r in rows]), np.array([r.quality for r in rows]) == 1
    order = np.argsort(np.argsort(score))
    assert (order[good].mean() - order[~good].mean()) / len(rows) + 0.5 > 0.95
    assert (score[good] >= 0.3).mean() > 0.99 and (score[~good] < 0.3).mean() > 0.8
    assert classifier.score(clashing, model).where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert classifier.score(none, model).count() == 0
    blank = classifier.fit(none, labels)
    assert {r.score for r in classifier.score(odd, blank).collect()} == {0.5} or blank.logits.any()
    held = {r.doc_id: r.h for r in docs.select("doc_id", classifier.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in held.items())


@pytest.fixture(scope="module")
def reference_encoder():
    import tiktoken
    path, pattern = queries.tokenizer()
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe(odd, clashing, none, documents, texts_of, reference_encoder):
    for df in (odd, clashing, documents):
        got = [(r.doc_id, r.n_tokens, r.ids) for r in bpe.encode_documents(df, *queries.tokenizer()).collect()]
        want = [(d, len(ids), ids) for d, t in texts_of(df) for ids in [reference_encoder.encode_ordinary(t)]]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(none, *queries.tokenizer()).count() == 0
    row = bpe.encode_documents(odd.where("doc_id = 10"), *queries.tokenizer(), digests=True).first()
    text = odd.where("doc_id = 10").first().text
    assert row.ids_sha256 == hashlib.sha256(np.array(reference_encoder.encode_ordinary(text), "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_on_random_text(name):
    import tiktoken
    path, pattern = queries.tokenizer(name)
    with open(path, "rb") as f:
        lines = f.read()
    own = bpe.Codec(lines, pattern)
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(lines), special_tokens={})
    rng = random.Random(1)
    bits = ["a", "b", " ", "\n", "é", "日", "\U0001f600", "\x1c", "\x85", "　", "1", "²", "'s", "'ll", "=", "==", "  ", "\t", "the", "\0", "ſ"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(70)))
        ids = own.encode(text)
        assert ids.tolist() == theirs.encode_ordinary(text)
        assert b"".join(own.decode(ids)) == text.encode()
    for _ in range(4000):
        a, b = rng.randrange(50256), rng.randrange(800)
        t = own.transducer
        assert t.agree(a, b) == (t.merge(t.bytes_of[a] + t.bytes_of[b]) == [a, b])
    own.transducer.reset()
    assert own.encode("the " * 500).tolist() == theirs.encode_ordinary("the " * 500)
    assert own.encode("=" * 5000).tolist() == theirs.encode_ordinary("=" * 5000)


def test_streaming_decoder():
    decoder = bpe.Decoder([bytes([i]) for i in range(256)] + ["é".encode()])
    data = "aé日\U0001f600z".encode()
    out = [decoder.feed(np.array([b])) for b in data]
    assert b"".join(out) == data and all(o == b"" or o.decode() for o in out)
    assert [len(o) for o in out] == [1, 0, 2, 0, 0, 3, 0, 0, 0, 4, 1]
    for broken in (b"\xff", b"\xc0\x80", b"\xed\xa0\x80", b"\xe9a", b"\xf4\x90\x80\x80"):
        decoder.state, decoder.held = 0, b""
        with pytest.raises(ValueError):
            decoder.feed(np.array(list(broken)))
    decoder.state, decoder.held = 0, b""
    assert decoder.feed(np.array([0xC3])) == b""
    with pytest.raises(ValueError):
        decoder.finish()


def test_token_counts(spark, odd, none, documents, texts_of, reference_encoder):
    for df in (odd, documents):
        for block in (64, 5000):
            blocks = tokencounts.write_flat(df, *queries.tokenizer(), queries.END_OF_DOCUMENT, block=block)
            got = tokencounts.scan(blocks, queries.END_OF_DOCUMENT, labels="ids", stride=3).collect()
            want = [(d, len(reference_encoder.encode_ordinary(t))) for d, t in texts_of(df)]
            assert sorted(((r.label, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)
            assert all(r.closed for r in got)
    blocks = tokencounts.write_flat(none, *queries.tokenizer(), queries.END_OF_DOCUMENT)
    assert tokencounts.scan(blocks, queries.END_OF_DOCUMENT, labels="ids").count() == 0


def test_token_files(spark, tmp_path):
    rng = random.Random(8)
    want = []
    for k, size in enumerate((0, 1, 5, 400, 1000)):
        tokens = np.array([0 if rng.random() < (0.02 if k == 4 else 0.3) else rng.randrange(1, 9) for _ in range(size)], "<u2")
        (tmp_path / f"f{k}.bin").write_bytes(tokens.tobytes())
        ends = [-1, *np.flatnonzero(tokens == 0).tolist()]
        want += [(f"f{k}.bin", i, b - a - 1, True) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
        if size - ends[-1] - 1:
            want.append((f"f{k}.bin", len(ends) - 1, size - ends[-1] - 1, False))
    for block in (1, 7, 64):
        found = tokencounts.scan(tokencounts.read_flat(spark, str(tmp_path), 2, block), 0, stride=5).collect()
        assert sorted((r.file.rsplit("/", 1)[1], r.document, r.n_tokens, r.closed) for r in found) == sorted(want)


def mix_brute(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while True:
        full = [s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = most * sizes[s]
        left, free = share * sum(sizes.values()) - sum(target.values()), free - set(full)
    return {**target, **{s: left * w[s] / sum(w[x] for x in free) for s in free}}


def test_mixing(spark, odd, clashing, none, documents):
    hot = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', 1 + id % 7) AS text",
                                       "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 11 = 0 THEN NULL ELSE concat('s', id % 8) END AS source")
    for df in (odd, clashing, documents, hot):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        sizes = {}
        for r in rows:
            assert r["__mix_size"] == len(WORD.findall(r.text or ""))
            sizes[r.source] = sizes.get(r.source, 0) + r["__mix_size"]
        want = mix_brute(sizes)
        for s in sizes:
            own = [r for r in rows if r.source == s]
            assert own[0]["__mix_source_size"] == sizes[s] and own[0]["__mix_target"] == pytest.approx(want[s])
            taken = sum(r["__mix_copies"] * r["__mix_size"] for r in own)
            assert abs(taken - want[s]) <= max(r["__mix_size"] for r in own)
            assert max(r["__mix_copies"] for r in own) - min(r["__mix_copies"] for r in own) <= 1
            assert all(0 <= r["__mix_copies"] <= 2 for r in own)
        again = mixing.mix(df.repartition(5)).collect()
        assert sorted((repr(r.doc_id), r["__mix_copies"]) for r in again) == sorted((repr(r.doc_id), r["__mix_copies"]) for r in rows)
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd.where("doc_id IN (5, 6, 7)")).where("__mix_copies * __mix_size > 0").count() == 0


def test_better_documents_come_earlier(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'a b c d', 'a# b# c# d#') AS text", "'s' AS source")
    taken = mixing.mix(df, total_share=0.5).where("__mix_copies > 0")
    clean = taken.where("doc_id % 2 = 0").count()
    assert 1150 < clean < 1550 and 1990 <= taken.count() <= 2010  # twice the weight


def test_word_pieces_do_not_cross_rows():
    import pyarrow as pa
    column = pa.array(["a b", None, "", "c", " d e ", "f" * 50])
    whole = [w for a, b, d, o in texts.pieces(column, 1 << 20) for w in np.diff(texts.word_hashes(d, o)[1]).tolist()]
    single = [w for a, b, d, o in texts.pieces(column.slice(1), 1) for w in np.diff(texts.word_hashes(d, o)[1]).tolist()]
    assert whole == [2, 0, 0, 1, 2, 1] and single == whole[1:]
