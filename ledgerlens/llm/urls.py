"""URL filter: rules first, then naive Bayes on segmented host names and path tokens.

The project keeps no URLs, so the operator is general. A page record has ``url`` and, to learn the
unigram model from, ``html``.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import cut_lineage, join_small, unpacked

UPPER, LOWERCASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: the rules, as (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# words that mark a page as blocked for training; naive Bayes carries that over to the words beside them
SEEDS = ("ads", "adult", "bet", "bets", "casino", "gambling", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")
LONGEST_WORD = 20


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#``
    or the end. Null or no ``://``: both empty."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWERCASE)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) of the distinct sites that a rule fits; the longest rule text wins, then the least."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    wanted = sites.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host"))
    named = rules.groupBy(F.col("host").alias("rule_host")).agg(F.collect_set(F.struct("path", "verdict")).alias("rules"))
    fits = join_small(wanted, named, "rule_host", F.xxhash64("host", "path")).select("host", "path", "rule_host", F.inline("rules").alias("rule_path", "verdict"))
    fits = fits.where(F.startswith("path", "rule_path")).withColumn("rule", F.concat("rule_host", "rule_path"))
    best = F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def unigrams(pages: DataFrame, html: str) -> DataFrame:
    """(word, n): lower-case ASCII words of all pages without their markup."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(f"`{html}`"), F.lit(""))), r"(?s)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(text, r"[^a-z]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def _viterbi(batches):
    """The split of each name with the largest product of unigram probabilities; ties take the longer last word."""
    for batch in batches:
        names, found, total = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out = []
        for name, known, n in zip(names, found, total):
            log_p = {k["word"]: math.log(k["n"] / n) for k in known or ()}
            best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
            for end in range(1, len(name) + 1):
                for start in range(max(0, end - LONGEST_WORD), end):
                    word = name[start:end]
                    p = best[start] + log_p.get(word, -math.log(n) - len(word) * math.log(10))
                    if p > best[end]:
                        best[end], back[end] = p, start
            words, end = [], len(name)
            while end:
                words.append(name[back[end] : end])
                end = back[end]
            out.append(words[::-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])


def segment_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct lower-case names, by unigram Viterbi.

    Every substring of at most ``LONGEST_WORD`` letters meets its count in a join, so the vocabulary
    is neither cut nor broadcast. An unknown word has a tenth of one count per letter.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    starts = F.sequence(F.lit(1), F.length("name"))
    pieces = F.flatten(
        F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - i + 1)), lambda k: F.substring("name", i, k)))
    )
    parts = names.select("name", F.explode(F.array_distinct(pieces)).alias("word"))
    known = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    df = names.join(known, "name", "left").select("name", "known", F.lit(max(total, 1)).cast("bigint").alias("total"))
    return df.mapInArrow(_viterbi, "name string, words array<string>")


def token_odds(tokens: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(token, odds) of multinomial naive Bayes with additive smoothing, from (token, blocked, pages)."""
    per_token = tokens.groupBy("token").agg(
        F.sum(F.when(F.col("blocked"), F.col("pages")).otherwise(0)).alias("bad"), F.sum(F.when(~F.col("blocked"), F.col("pages")).otherwise(0)).alias("good")
    )
    per_token = cut_lineage(per_token)
    s = per_token.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("kinds")).first()
    bad, good, kinds = s["bad"] or 0, s["good"] or 0, s["kinds"]
    odds = F.log((F.col("bad") + smoothing) / (bad + smoothing * kinds)) - F.log((F.col("good") + smoothing) / (good + smoothing * kinds)) if kinds else F.lit(0.0)
    return per_token.select("token", F.round(odds, 9).alias("odds"))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame | None = None,
    url: str = "url",
    html: str = "html",
    carry: list[str] | None = None,
    seeds: tuple[str, ...] = SEEDS,
    block_above: float = 0.5,
) -> DataFrame:
    """The columns in ``carry`` (default all) plus host, path, rule, verdict, score and host_words.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule gives the verdict. For all other
    pages naive Bayes decides: tokens are the words of the host (without the last label; names are split by
    unigram Viterbi on the words of all pages) and of the path. It is trained on the pages themselves: a site whose
    host or path words include a seed is bad, the others good, each weighted by its pages. ``score`` is the
    probability of bad given the tokens; the verdict is block above ``block_above``.

    Sites (host, path) are judged once and joined back, so a hot host or page costs no more.

    Defined results: null URLs and URLs without ``://`` have an empty host and path, no rule, no tokens and so
    score by the prior alone; repeated rows get equal results; an empty table gives no rows; null html adds
    nothing to the unigrams; added columns replace columns of the same name.
    """
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    host, path = host_and_path(F.col(f"`{url}`"))
    names = pages.columns if carry is None else carry
    df = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), host.alias("host"), path.alias("path"))
    sites = cut_lineage(df.groupBy("host", "path").agg(F.count("*").alias("pages")))
    labels = F.split("host", r"\.")
    host_names = F.split(F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), "."), r"[^a-z]+")
    path_names = F.split(F.translate("path", UPPER, LOWERCASE), r"[^a-z]+")
    named = sites.select("host", "path", "pages", F.explode(F.array_union(
        F.transform(F.filter(host_names, lambda n: n != ""), lambda n: F.struct(F.lit("host").alias("part"), n.alias("name"))),
        F.transform(F.filter(path_names, lambda n: n != ""), lambda n: F.struct(F.lit("path").alias("part"), n.alias("name"))),
    )).alias("x")).select("host", "path", "pages", "x.part", "x.name")
    split = cut_lineage(segment_names(named.where("part = 'host'").select("name").distinct(), cut_lineage(unigrams(pages, html))))
    # a name may stand in a third of all hosts; neither join has an aggregate on the same key behind it
    host_tokens = named.where("part = 'host'").join(split, "name").select("host", "path", "pages", F.explode("words").alias("token"))
    tokens = host_tokens.unionByName(named.where("part = 'path'").select("host", "path", "pages", F.col("name").alias("token")))
    tokens = cut_lineage(tokens)
    bad = tokens.where(F.col("token").isin(*seeds)).groupBy("host", "path").agg(F.lit(True).alias("blocked"))
    labelled = sites.join(bad, ["host", "path"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    labelled = cut_lineage(labelled)
    prior = labelled.agg(F.sum(F.when(F.col("blocked"), F.col("pages")).otherwise(0)).alias("bad"), F.sum("pages").alias("all")).first()
    n_bad, n_all = prior["bad"] or 0, prior["all"] or 0
    start = math.log((n_bad + 1) / (n_all - n_bad + 1))
    odds = cut_lineage(token_odds(tokens.join(labelled.select("host", "path", "blocked"), ["host", "path"])))
    # summed as decimals, so that the order of the tokens does not show
    scored = tokens.join(odds, "token").groupBy("host", "path").agg(F.sum(F.col("odds").cast("decimal(30,9)")).alias("odds"))
    total = F.lit(start) + F.coalesce(F.col("odds").cast("double"), F.lit(0.0))
    judged = (
        labelled.join(scored, ["host", "path"], "left")
        .join(longest_rule(sites, rules), ["host", "path"], "left")
        .join(host_tokens.groupBy("host", "path").agg(F.array_sort(F.collect_set("token")).alias("host_words")), ["host", "path"], "left")
        .select("host", "path", "rule", "rule_verdict", (1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(700.0)), F.lit(-700.0))))).alias("score"), "host_words")
    )
    out = df.join(cut_lineage(judged), ["host", "path"])
    method = F.when(F.col("score") > block_above, F.lit("block")).otherwise(F.lit("allow"))
    return unpacked(
        out, host="host", path="path", rule="rule", verdict=F.coalesce("rule_verdict", method), score="score",
        host_words=F.coalesce("host_words", F.array().cast("array<string>")),
    )
