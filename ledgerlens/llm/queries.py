"""One thin query per operator: the given tables as the project's records, results as the contracts' columns.

A document stands for a risk report: doc_id is the user, text the report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, langid, licenses, lines, mixing, order_minhash, perplexity, phrases, private_spans, statements, urls, warc, whitening
from .vectors import fixed_point, usable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reports(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("user_id"), F.col("text").alias("report"), *more)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark")


def with_domain(docs: DataFrame) -> DataFrame:
    """The table names no domain; sources are numbered, and four domains take turns."""
    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return docs.withColumn("domain", F.concat(F.lit("domain"), number % 4))


# target weights: the first domain twice the others, English three times each other language, src0 a quarter
DOMAIN_WEIGHTS = {"domain0": 2.0, "domain1": 1.0, "domain2": 1.0, "domain3": 1.0}
LANGUAGE_WEIGHTS = {"en": 3.0, "de": 1.0, "fr": 1.0, "es": 1.0}
SOURCE_WEIGHTS = {"src0": 0.25}


def mixture_weights(spark: SparkSession, docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """(path, weight) rows of the tree, and a budget of half of all tokens."""
    rows = []
    for domain, weight in DOMAIN_WEIGHTS.items():
        rows.append(([domain], weight))
        for lang, lang_weight in LANGUAGE_WEIGHTS.items():
            rows.append(([domain, lang], lang_weight))
            rows += [([domain, lang, source], w) for source, w in SOURCE_WEIGHTS.items()]
    weights = spark.createDataFrame(rows, "path array<string>, weight double")
    total = docs.agg(F.sum(mixing.token_count(F.col(text)))).first()[0] or 0
    return weights, total // 2


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page stands for the body of a response record; the table has no dates and no HTTP headers."""
    pages = _table(spark, sf_dir, "pages")
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    responses = pages.select(
        "page_id",
        warc.record_id(F.lit("response"), F.col("page_id").cast("string")).alias("warc_record_id"),
        F.col("url").alias("warc_target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
        F.concat(F.lit(http), F.coalesce("html", F.lit(""))).alias("block"),
    )
    return warc.derive_records(responses)


def op5_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.filter_urls(_table(spark, sf_dir, "pages"), carry=["page_id"])
    return out.select("page_id", "host", "path", "rule", "verdict", "score", F.array_join("host_words", " ").alias("host_words"))


def op6_rare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    return licenses.scan_licenses(files, carry=["file_id"]).withColumnRenamed("file_id", "doc_id")


def op2_hierarchical_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(_table(spark, sf_dir, "documents"))
    weights, budget = mixture_weights(spark, docs, "text")
    reports = docs.select(F.col("doc_id").alias("user_id"), F.col("text").alias("report"), "domain", "lang", "source")
    out = mixing.mix_to_weights(reports, weights, budget, ("domain", "lang", "source"))
    return out.select(F.col("user_id").alias("doc_id"), "domain", "lang", "source", "copies", "part_tokens", "taken_tokens")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(_reports(spark, sf_dir))
    length = F.aggregate("removed_spans", F.lit(0).cast("bigint"), lambda t, s: t + s["last"] - s["first"])
    return out.select(
        F.col("user_id").alias("doc_id"),
        F.col("report").alias("text"),
        F.size("removed_spans").cast("bigint").alias("n_removed"),
        length.alias("removed_chars"),
        F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["first"], s["last"])), ",").alias("removed_spans"),
    )


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = order_minhash.near_duplicates(_reports(spark, sf_dir))
    return classes.select(F.col("id").alias("doc_id"), F.col("text_id"), "class_id", "n_links")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _reports(spark, sf_dir, "lang")
    held_out = F.coalesce(F.crc32(F.col("user_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.train_language_model(docs.where(~held_out))
    out = langid.identify_language(docs.select("user_id", "report"), model)
    return out.select(F.col("user_id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity.quality(_reports(spark, sf_dir, "lang"), carry=["user_id"])
    return out.withColumnRenamed("user_id", "doc_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_reports(spark, sf_dir), benchmark(spark, sf_dir))
    return out.select(
        F.col("user_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _reports(spark, sf_dir)
    out = phrases.drop_repeated_strings(reports.withColumn("n_bytes", F.coalesce(F.octet_length("report"), F.lit(0)).cast("bigint")), carry=["user_id", "n_bytes"])
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["last"] - s["first"])
    return out.select(
        F.col("user_id").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_boosted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = private_spans.find_personal_data(_reports(spark, sf_dir), carry=["user_id"])
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")
    counts = [F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}") for kind in private_spans.KINDS]  # noqa: B023
    return out.select(F.col("user_id").alias("doc_id"), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector stands for a user's feature vector; every seventh has the next label, as the contract asks."""
    vectors = _table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    users = vectors.select(F.col("vec_id").alias("user_id"), label.alias("status"), fixed_point(F.col("embedding"), 256).alias("vec"))
    return hard_negatives.mine_hard_negatives(users, F.col("user_id") % 50 == 0)


def op13_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    users = vectors.select(F.col("vec_id").alias("user_id"), fixed_point(F.col("embedding"), 64, 1_000_000).alias("vec"))
    model = whitening.fit_whitening(users)
    n, sums = F.lit(model.n).cast("bigint"), F.array(*[F.lit(s).cast("bigint") for s in model.sums]).cast("array<bigint>")
    squares = F.zip_with("vec", sums, lambda x, s: (n * x - s) * (n * x - s))
    explained = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    out = whitening.whiten(users, model).select(
        F.col("user_id").alias("vec_id"), F.aggregate(squares, F.lit(0).cast("bigint"), lambda t, x: t + x).alias("deviation"), F.posexplode("whitened").alias("at", "whitened")
    )
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), n.alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_derivatives, op2_hierarchical_mixture, op3_line_dedup, op4_order_minhash, op5_host_words,
        op6_rare_tokens, op7_language_id, op8_perplexity, op9_decontaminate, op10_prefix_free, op11_boosted_spans, op12_cover_tree, op13_qd_whitening,
    )
}

MIXTURE_SQL = """
WITH toks AS (
  SELECT doc_id, 'domain' || (COALESCE(TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT), 0) % 4) AS domain, lang, source,
    COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n)::DOUBLE AS tokens, 4 * sum(n)::DOUBLE AS cap FROM toks WHERE n > 0 GROUP BY ALL),
n3 AS (SELECT *, CASE WHEN source = 'src0' AND lang IN ('en', 'de', 'fr', 'es') THEN 0.25 ELSE 1.0 END::DOUBLE AS w FROM leaf),
n2 AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM leaf GROUP BY ALL),
n1 AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'domain0' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM leaf GROUP BY ALL),
r AS (SELECT floor(sum(n) / 2)::DOUBLE AS b FROM toks),
-- the share per weight l that uses the budget up: of the breaks cap / w, the sum of least(w * b, cap) tells which are full
f1 AS (SELECT n1.*, r.b, (SELECT sum(least(o.w * (n1.cap / n1.w), o.cap)) FROM n1 o) <= r.b AS is_full FROM n1, r),
l1 AS (SELECT *, (b - COALESCE(sum(cap) FILTER (is_full) OVER (), 0)) / sum(w) FILTER (NOT is_full) OVER () AS rate FROM f1),
g1 AS (SELECT domain, CASE WHEN is_full THEN cap ELSE w * rate END AS b FROM l1),
f2 AS (SELECT n2.*, g1.b, (SELECT sum(least(o.w * (n2.cap / n2.w), o.cap)) FROM n2 o WHERE o.domain = n2.domain) <= g1.b AS is_full FROM n2 JOIN g1 USING (domain)),
l2 AS (SELECT *, (b - COALESCE(sum(cap) FILTER (is_full) OVER p, 0)) / sum(w) FILTER (NOT is_full) OVER p AS rate FROM f2 WINDOW p AS (PARTITION BY domain)),
g2 AS (SELECT domain, lang, CASE WHEN is_full THEN cap ELSE w * rate END AS b FROM l2),
f3 AS (SELECT n3.*, g2.b, (SELECT sum(least(o.w * (n3.cap / n3.w), o.cap)) FROM n3 o WHERE o.domain = n3.domain AND o.lang = n3.lang) <= g2.b AS is_full FROM n3 JOIN g2 USING (domain, lang)),
l3 AS (SELECT *, (b - COALESCE(sum(cap) FILTER (is_full) OVER p, 0)) / sum(w) FILTER (NOT is_full) OVER p AS rate FROM f3 WINDOW p AS (PARTITION BY domain, lang)),
g3 AS (SELECT domain, lang, source, tokens::BIGINT AS tokens, floor(CASE WHEN is_full THEN cap ELSE w * rate END + 1e-6)::BIGINT AS given FROM l3),
drawn AS (
  SELECT t.*, given // tokens AS full_epochs, given % tokens AS rest,
    ('0x' || substr(md5('1:' || (given // tokens) || ':' || doc_id), 1, 15))::BIGINT AS place
  FROM toks t JOIN g3 USING (domain, lang, source) WHERE n > 0 AND given > 0),
cut AS (
  SELECT *, greatest(0, least(n, rest - COALESCE(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS part FROM drawn)
SELECT doc_id, domain, lang, source, (full_epochs + (part = n)::BIGINT)::BIGINT AS copies,
  CASE WHEN part < n THEN part ELSE 0 END::BIGINT AS part_tokens, (full_epochs * n + part)::BIGINT AS taken_tokens
FROM cut WHERE full_epochs > 0 OR part > 0"""

LINES_SQL = """
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
token AS (
  SELECT doc_id, i, unnest(string_split_regex(line, '[\\x20\\x09-\\x0D]')) AS w, unnest(range(1, len(string_split_regex(line, '[\\x20\\x09-\\x0D]')) + 1)) AS j FROM line),
placed AS (
  SELECT doc_id, i, j, length(w) AS n, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w,
    COALESCE(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM token),
word AS (
  SELECT *, list_sum(list_transform(range(0, octet_length(encode(w))), lambda k: ('0x' || substr(hex(encode(w)), (2 * k + 1)::INT, 2))::INT)) % 8 = 0 AS closes FROM placed WHERE n > 0),
numbered AS (
  SELECT *, lag(i) OVER o IS DISTINCT FROM i OR lag(closes) OVER o AS opens FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i, j)),
unit AS (
  SELECT doc_id, u, list(w ORDER BY i, j) AS ws, min(a) AS a, max(a + n) AS b, count(*) AS n
  FROM (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY i, j) AS u FROM numbered) GROUP BY doc_id, u),
repeated AS (SELECT * FROM unit QUALIFY row_number() OVER (PARTITION BY ws ORDER BY doc_id, u) > 1),
span AS (
  SELECT doc_id, min(a)::BIGINT AS a, max(b)::BIGINT AS b FROM (SELECT *, u - row_number() OVER (PARTITION BY doc_id ORDER BY u) AS run FROM repeated)
  GROUP BY doc_id, run HAVING sum(n) >= 25),
piece AS (SELECT doc_id, a, b, COALESCE(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
cut AS (
  SELECT doc_id, count(*) AS n, sum(b - a) AS chars, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, max(b) AS tail, string_agg(substr(text, before + 1, a - before), '' ORDER BY a) AS head
  FROM piece JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN cut.doc_id IS NULL THEN text ELSE head || substr(text, tail + 1) END AS text, COALESCE(n, 0)::BIGINT AS n_removed,
  COALESCE(chars, 0)::BIGINT AS removed_chars, COALESCE(spans, '') AS removed_spans
FROM documents d LEFT JOIN cut ON d.doc_id = cut.doc_id"""

CONTAMINATION_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, sizes WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.n, p.i, win.item_id FROM place p JOIN win ON p.n = win.n AND p.t = win.t),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
  sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN words ON w.doc_id = words.doc_id LEFT JOIN items ON w.doc_id = items.doc_id"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id,
  positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""

ORACLE_SQL: dict[str, str] = {
    "op1_warc_derivatives": statements.warc_statement(),
    "op2_hierarchical_mixture": MIXTURE_SQL,
    "op3_line_dedup": LINES_SQL,
    "op6_rare_tokens": statements.license_statement(),
    "op9_decontaminate": CONTAMINATION_SQL,
    "op10_prefix_free": statements.STRINGS_SQL,
    "op12_cover_tree": NEGATIVES_SQL,
}
