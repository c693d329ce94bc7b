"""The operators over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import (bpe, classifier, digests, hardneg, lexical, minhash, mixing, parity, repeats, rules, secrets,
                           tokencounts, urls)

#: Name of the rank file in the package of public tokenizers.
RANKS = "byte_bpe_50k.tiktoken"
#: The free identifier that ends documents in token files.
END_OF_DOCUMENT = 50256

URL_RULES = (urls.UrlRule("net", "/", True), urls.UrlRule("example.net", "/en/", False),
             urls.UrlRule("example.com", "/de/", True), urls.UrlRule("org", "/fr/", False))


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def tokenizer(name: str = RANKS) -> tuple[str, str]:
    """Path of a rank file and the pattern that splits text before the merges."""
    import public_tokenizers
    return public_tokenizers.path(name), public_tokenizers.PATTERN


def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_groups(table(spark, folder, "documents", "doc_id", "text"), width=3, threshold=0.85)


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, from flat token files written of all documents."""
    blocks = tokencounts.write_flat(table(spark, folder, "documents", "doc_id", "text"), *tokenizer(), END_OF_DOCUMENT)
    return tokencounts.scan(blocks, END_OF_DOCUMENT, labels="ids").select(F.col("label").alias("doc_id"), "n_tokens")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    learned = rules.learn(docs, table(spark, folder, "labels", "doc_id", "quality"))
    return rules.judge(docs, learned).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def page_outcome():
    """The outcome of a page: bad (1) if its source holds five or more runs of three symbols."""
    return (F.regexp_count("html", F.lit(r"[#*$%&]{3}")) >= 5).cast("int")


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    return urls.judge(pages, page_outcome(), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", *secrets.digest_columns(found))


def repeat_removal(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents", "doc_id", "text"))


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    labels = table(spark, folder, "labels", "doc_id", "quality").where(~classifier.held_out())
    scored = classifier.score(docs, classifier.fit(docs, labels))
    return scored.select("doc_id", classifier.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return digests.exact_groups(table(spark, folder, "documents", "doc_id", "text"), largest=True)


def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return bpe.encode_documents(docs, *tokenizer(), digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"),
                        F.col("__mix_target").alias("target"), (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"))


def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with every seventh label moved on by one."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return parity.join(table(spark, folder, "documents", "doc_id", "text"), width=3, threshold=0.9)


def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item, over an index of all documents."""
    shards = lexical.store(lexical.index(table(spark, folder, "documents", "doc_id", "text")))
    return lexical.search(shards, table(spark, folder, "benchmark", "item_id", "text"), 20)


QUERIES = {
    "op1_minhash_near_dedup": near_dedup,
    "op2_token_counts": token_counts,
    "op3_quality_rules": quality_rules,
    "op4_url_filters": url_filter,
    "op5_secret_scan": secret_scan,
    "op6_suffix_array_dedup": repeat_removal,
    "op7_quality_classifier": quality_scores,
    "op8_exact_dedup": exact_dedup,
    "op9_byte_level_bpe": bpe_round_trip,
    "op10_source_mixing": source_mix,
    "op11_hard_negatives": hard_negatives,
    "op12_ngram_jaccard_join": jaccard_join,
    "op13_lexical_search": lexical_search,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Components of documents whose shingle sets are similar enough: two percentages, and what is returned of each document.
_LINKED = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_SMALL.format("coalesce(text, '')"))} AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
  ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]) END AS items FROM w),
e AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.item = b.item AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= %d * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= %d * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(items) AS BIGINT) AS n_shingles, component_id%s
FROM s JOIN low ON a = doc_id"""

SQL = {
    "op1_minhash_near_dedup": _LINKED % (85, 85, ", doc_id = component_id AS kept"),
    "op4_url_filters": r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
  CASE WHEN html IS NOT NULL THEN CASE WHEN len(regexp_extract_all(html, '[#*$%&]{3}')) >= 5 THEN 1 ELSE 0 END END AS bad FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p),
h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, string_split(host, '.') AS l FROM p GROUP BY host),
h1 AS (SELECT *, array_to_string(list_slice(l, -2, -1), '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br') AS long FROM h0),
h AS (SELECT host, n, bad, array_to_string(list_slice(l, CASE WHEN long THEN -2 ELSE -1 END, -1), '.') AS suffix,
  array_to_string(list_slice(l, CASE WHEN long THEN -3 ELSE -2 END, -1), '.') AS domain FROM h1),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
g AS (SELECT 'h' AS level, n, bad FROM h UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s),
m AS (SELECT level, sum(bad) AS b, sum(n) AS n, count(*) AS k, sum(n * n) AS nn, sum(bad * bad / n) AS bb FROM g WHERE n > 0 GROUP BY level),
a AS (SELECT level, CASE WHEN b = 0 OR b = n OR k < 2 THEN -1 ELSE CASE WHEN n - nn / n - (k - 1) > 0 THEN
  ((bb - n * (b / n) * (b / n)) / ((b / n) * (1 - b / n)) - (k - 1)) / (n - nn / n - (k - 1)) ELSE 0 END END AS alike FROM m),
k AS (SELECT level, CASE WHEN alike <= 0 THEN 10000.0 WHEN alike >= 1 THEN 1.0 ELSE least(greatest(1 / alike - 1, 1.0), 10000.0) END::DOUBLE AS v FROM a),
t AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM h),
ks AS (SELECT coalesce(max(v) FILTER (level = 'h'), 10000) AS kh, coalesce(max(v) FILTER (level = 'd'), 10000) AS kd,
  coalesce(max(v) FILTER (level = 's'), 10000) AS ksx FROM k),
sm AS (SELECT suffix, (s.bad + ksx * CASE WHEN t.n = 0 THEN 0 ELSE (t.bad + 0.5) / (t.n + 1.0) END) / (s.n + ksx) AS mean FROM s, t, ks),
dm AS (SELECT domain, (d.bad + kd * sm.mean) / (d.n + kd) AS mean FROM d JOIN sm USING (suffix), ks),
hm AS (SELECT host, (h.bad + kh * dm.mean) / (h.n + kh) AS mean, h.n + kh AS size FROM h JOIN dm USING (domain), ks),
lo AS (SELECT host, mean - 2.0 * sqrt(mean * (1 - mean) / (size + 1)) AS lower FROM hm)
SELECT page_id, r.host, path, rule, CASE WHEN coalesce(rule IN ('net/', 'example.com/de/'), lower > 0.1) THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN lo ON r.host = lo.host""",
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_SMALL.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op10_source_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS symbols FROM documents),
q AS (SELECT *, -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
  / CASE WHEN size = 0 THEN 1.0 ELSE size::DOUBLE / (size + symbols) END AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM q GROUP BY source),
r AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER f - cap)) / (sum(w) OVER () - sum(w) OVER f + w) AS level FROM r
  WINDOW f AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT source, source_size, round(least(cap, max(CASE WHEN cap >= level * w THEN level END) OVER () * w), 6) AS target FROM o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
a AS (SELECT doc_id, size, source_size, target, epochs,
  sum(size) OVER (PARTITION BY q.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead
  FROM q JOIN e ON q.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN 2 * ahead + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM a""",
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 50 = 0 AND a.vec_id IS DISTINCT FROM r.vec_id),
g AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id ASC NULLS LAST) <= 5)
SELECT g.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY g.anchor_id, positive_id ORDER BY score DESC, id ASC NULLS LAST) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM g JOIN p ON p.anchor_id = g.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
    "op12_ngram_jaccard_join": _LINKED % (90, 90, ""),
    "op13_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS.format(_SMALL.format("coalesce(text, '')"))} AS terms FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format(_SMALL.format("text"))}) AS term FROM benchmark)
  GROUP BY ALL),
c AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
m AS (SELECT doc_id, 75 + (25 * len(terms) * n) // l AS m FROM d, c),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20""",
}
