"""The operators as registered queries: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "{}/{}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(TABLES.format(sf_dir, name))


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """Where the public vocabularies lie; ``spark.ratioscope.tokenizers`` overrides the installed package."""
    folder = spark.conf.get("spark.ratioscope.tokenizers", None)
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


#: Path-insensitive signs of hosts that a training corpus leaves out.
BLOCK_GLOBS = ["*casino*/**", "*casino*", "*free-bets*/**", "*free-bets*", "*cheap-pills*/**", "*cheap-pills*", "*adult-*/**", "*adult-*", "*spam-farm*/**", "*spam-farm*"]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import HostRule, filter_urls

    rules = [HostRule("net/", "block"), HostRule("example.net/en/", "allow"), HostRule("example.com/de/", "block"), HostRule("org/fr/", "allow")]
    return filter_urls(table(spark, sf_dir, "pages"), rules, BLOCK_GLOBS)


OP2_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM p
), g AS (
  SELECT *, CASE WHEN contains(host, 'casino') THEN 'casino' WHEN contains(host, 'free-bets') THEN 'free-bets' WHEN contains(host, 'cheap-pills') THEN 'cheap-pills'
         WHEN contains(host, 'adult-') THEN 'adult-' WHEN contains(host, 'spam-farm') THEN 'spam-farm' END AS sign FROM q
), r AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM g
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN sign IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN sign IS NULL THEN NULL ELSE '*' || sign || '*' || CASE WHEN path = '' THEN '' ELSE '/**' END END AS glob
FROM r
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(spark, "byte_bpe_50k.json"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spm import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(spark, "piece_bpe_32k.model"), with_ids=False)
    return out.select("doc_id", "n_tokens", "n_unknown", "n_fallback", "ids_crc32", "round_trip", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(generate_series(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 90 * (nx.k + ny.k - shared)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node WHERE l.y > r.root
)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, r.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id
"""


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_wrappers import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 12)) AS i, words FROM w WHERE len(words) >= 13
), seq AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS k FROM win),
least AS (SELECT k, min(doc_id) AS d FROM seq GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM seq JOIN least USING (k) WHERE least.d < seq.doc_id
), each AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS j FROM w),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS t, count(*) AS n FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.j = e.j WHERE g.j IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import apply_quality, fit_quality

    docs = table(spark, sf_dir, "documents")
    return apply_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, min_words=20, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), dw AS (
  SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL
), bw AS (
  SELECT word, count(*) AS k FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY ALL
), bytes AS (
  SELECT word, list_transform(range(length(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) AS b
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw))
), cell AS (
  SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, tab
), s AS (SELECT bucket, sum(k)::DOUBLE AS s FROM dw JOIN cell USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(k)::DOUBLE AS t FROM bw JOIN cell USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)
), w AS (SELECT doc_id, sum(k * gain)::BIGINT AS weight FROM dw JOIN cell USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM f WHERE n_features >= 20
)
SELECT f.doc_id, n_features, weight, score, CASE WHEN r.rank <= 10 * n // 100 THEN r.rank END AS rank FROM f LEFT JOIN r USING (doc_id)
"""


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal, fit_tagger

    docs = table(spark, sf_dir, "documents")
    out = find_personal(docs, fit_tagger(docs))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs, with_periodic_tails

    docs = with_periodic_tails(table(spark, sf_dir, "documents"))
    out = periodic_runs(docs, min_length=12).withColumn("n_runs", F.size("runs").cast("long"))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    out = out.withColumn("top", F.when(F.col("n_runs") > 0, top)).withColumn("period", -F.col("top.period"))
    return out.select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), "period", F.expr("1000 * top.length div period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_url_filter": op2_url_filter,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_html_extraction": op7_html_extraction,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_personal_data": op12_personal_data,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op2_url_filter": OP2_SQL, "op6_ngram_jaccard": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op11_importance_resampling": OP11_SQL}
