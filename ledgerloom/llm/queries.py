"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_file() -> str:
    """Place of the public byte-level BPE file, from the package that the cluster installs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_harmonic_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, folder, "documents"), tokenizer_file())


@query("op6_jump_sharding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from .sharding import assign_shards

    placed = assign_shards(table(spark, folder, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (
  SELECT d.doc_id, d.pos, d.line, coalesce(f.first_id < d.doc_id, false) AS gone
  FROM keyed d LEFT JOIN firsts f ON f.k = d.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op1_line_dedup", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from .linededup import dedup_lines

    kept = dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: fixed rules of the query; every other entry of the list comes from the pages
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, url, strpos(url, '://') AS p FROM pages),
rest AS (SELECT page_id, CASE WHEN coalesce(p, 0) > 0 THEN substr(url, p + 3) ELSE '' END AS r FROM parts),
split AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(regexp_extract(r, '^[^?#]*'), length(regexp_extract(r, '^[^/?#]*')) + 1) AS path
  FROM rest),
rules(host, path, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
addressed AS (SELECT *, host || regexp_replace(path, '(/|\.html)$', '') AS address FROM split),
twice AS (SELECT address FROM addressed WHERE host <> '' GROUP BY address HAVING count(*) > 1),
fits AS (
  SELECT s.page_id, max(length(r.host || r.path)) AS n
  FROM split s JOIN rules r ON (s.host = r.host OR s.host LIKE '%.' || r.host) AND starts_with(s.path, r.path)
  GROUP BY s.page_id)
SELECT s.page_id, s.host, s.path, r.host || r.path AS rule,
       coalesce(r.action, CASE WHEN s.address IN (SELECT address FROM twice) THEN 'block' ELSE 'allow' END) AS verdict
FROM addressed s LEFT JOIN fits f ON f.page_id = s.page_id
LEFT JOIN rules r ON length(r.host || r.path) = f.n AND (s.host = r.host OR s.host LIKE '%.' || r.host) AND starts_with(s.path, r.path)
"""


@query("op3_url_filter", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from .urls import canonical, filter_urls, host_of, path_of

    pages = table(spark, folder, "pages")
    # addresses that several pages give under other spellings or queries are listed for blocking
    address = pages.select(host_of("url").alias("host"), path_of("url").alias("path")).where("host <> ''")
    again = address.groupBy(canonical(F.col("host"), F.col("path")).alias("address")).count().where("count > 1")
    rules = spark.createDataFrame(RULES, "entry string, action string")
    listed = rules.union(again.select(F.concat(F.lit("="), "address"), F.lit("block")))
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


@query("op7_source_mixing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from .mixing import mix_table

    taken, sizes, targets = mix_table(table(spark, folder, "documents"))
    by_source = spark.createDataFrame(
        [(s, sizes[s], targets[s]) for s in sizes], "source string, source_size bigint, target double"
    )
    rows = taken.withColumn("source", F.col("sources")[0])
    joined = rows.join(F.broadcast(by_source), rows["source"].eqNullSafe(by_source["source"]))
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


@query("op2_quality_attention")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = table(spark, folder, "documents")
    model = fit_quality(docs, table(spark, folder, "labels"))
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (crc_of_id("doc_id") % 3 == 1).alias("held_out"),
        F.col("quality_score.score").alias("score"),
        (F.col("quality_score.score") >= 0.5).cast("int").alias("predicted"),
        F.col("quality_score.n_passages").alias("n_passages"),
    )


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, folder, "documents")
    model = fit_toxicity(docs, table(spark, folder, "labels"))
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (crc_of_id("doc_id") % 4 == 2).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.3).cast("int").alias("predicted"),
        F.col("toxicity.n_hits").alias("n_hits"),
    )


@query("op4_ngram_jaccard")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from .ngramjoin import ngram_classes

    return ngram_classes(table(spark, folder, "documents"), n=3, num=90, den=100)


@query("op8_embedding_links")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from .embeddedup import vector_links

    return vector_links(table(spark, folder, "embeddings"), cosine=0.9)


@query("op9_nearest_neighbours")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from .annsearch import nearest_neighbours

    return nearest_neighbours(table(spark, folder, "embeddings"), k=10, every=100)


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pieces AS (
  SELECT row, doc_id, k, substr(x, 2000 * k + 1, 2098) AS y
  FROM (SELECT row, doc_id, x, unnest(range(0, (length(x) + 1999) // 2000)) AS k FROM d)),
w AS MATERIALIZED (
  SELECT row, doc_id, 1000 * k + i AS i, substr(y, 2 * i + 1, 100) AS s
  FROM (SELECT row, doc_id, k, y, unnest(range(0, least(1000, length(y) // 2 - 49))) AS i FROM pieces WHERE length(y) >= 100)),
firsts AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT row, i FROM w JOIN firsts USING (s) WHERE doc_id > m),
marked AS (SELECT row, i, coalesce(i > lag(i) OVER (PARTITION BY row ORDER BY i) + 50, true)::int AS fresh FROM gone),
numbered AS (SELECT row, i, sum(fresh) OVER (PARTITION BY row ORDER BY i) AS span FROM marked),
spans AS (SELECT row, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY row, span),
gaps AS (
  SELECT d.row, coalesce(lag(a.b) OVER (PARTITION BY d.row ORDER BY a.a), 0) AS lo, a.a AS hi, a.b - a.a AS n, x
  FROM d JOIN spans a ON a.row = d.row
  UNION ALL
  SELECT d.row, coalesce(e.b, 0), length(x) // 2, 0, x
  FROM d LEFT JOIN (SELECT row, max(b) AS b FROM spans GROUP BY row) e ON e.row = d.row),
kept AS (
  SELECT row, sum(n) AS n_removed, count(*) - 1 AS n_spans,
         string_agg(substr(x, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS k
  FROM gaps GROUP BY row)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, k.n_removed::bigint AS n_removed, k.n_spans, sha256(unhex(coalesce(k.k, ''))) AS kept_sha256
FROM d JOIN kept k ON k.row = d.row
"""


@query("op11_suffix_dedup", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from .suffixdedup import dedup_spans

    found = dedup_spans(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _repeated(text: str, h: int) -> str:
    """From word g % n on, the text becomes periodic, with a period that the id's checksum fixes."""
    words, g = text.encode().split(), h // 10
    if not words:
        return text
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return b" ".join(words[i if i < a else a + (i - a) % p] for i in range(len(words))).decode()


@query("op12_word_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from .runs import word_runs

    @F.arrow_udf("string")
    def repeated(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        both = zip(texts.to_pylist(), hashes.to_pylist(), strict=True)
        return pa.array([None if t is None else _repeated(t, h) for t, h in both], pa.string())

    h = crc_of_id("doc_id")
    chosen = F.when(h % 10 == 0, F.col("text"))
    docs = table(spark, folder, "documents").select(
        "doc_id", F.when(h % 10 == 0, repeated(chosen, h)).otherwise(F.col("text")).alias("text")
    )
    found = word_runs(docs)
    runs, best = F.col("runs.runs"), F.col("best")
    lines = F.transform(runs, lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return found.select(
        "doc_id", F.size(runs).cast("bigint").alias("n_runs"), longest.alias("best"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2(F.col("runs.kept"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", (-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period"),
        F.expr("1000 * best.length div (-best.col3)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


OP13_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::bigint AS score
  FROM usable a JOIN usable r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
found AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from .negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))

    def whole(x):  # floor(256 x); doubles of 2**53 and more are whole numbers, and components not finite stay so
        y = x.cast("double") * 256
        return F.when(F.abs(y) < 2.0**53, F.floor(F.when(F.abs(y) < 2.0**53, y)).cast("double")).otherwise(y)

    found = hard_negatives(table(spark, folder, "embeddings"), vector=F.transform("embedding", whole), label=label)
    scores = (F.col(c).cast("bigint").alias(c) for c in ("positive_score", "negative_score"))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", *scores)
