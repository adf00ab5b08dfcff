"""Licence scan of files by a positional index of rare tokens. Only DataFrame functions are used.

The project keeps no source files or licence texts, so the operator is general: any table with an id
and a text column works. Its records here are named ``file_id`` and ``content``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rows import cut_lineage, join_small, unpacked

UPPER, LOWERCASE = string.ascii_uppercase, string.ascii_lowercase

# fixed values: the base phrases and their labels
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# fixed values: wording of well-known licences and notices, with the phrases that must stand in place
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ("lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "binary forms")),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, label, words, phrases): phrases as (place in the template, words)."""
    rows = []
    for i, (label, text, phrases) in enumerate(templates):
        words = text.split()
        placed = []
        for phrase in phrases:
            p = phrase.split()
            at = next(k for k in range(len(words)) if words[k : k + len(p)] == p)
            placed.append((at, p))
        rows.append((i, label, words, placed))
    return spark.createDataFrame(rows, "template int, label string, words array<string>, phrases array<struct<place:int,words:array<string>>>")


def words_of(content: Column) -> Column:
    """Maximal runs of ASCII letters (A-Z lower-cased), digits and all non-ASCII characters; null has none."""
    parts = F.split(F.translate(F.coalesce(content, F.lit("")), UPPER, LOWERCASE), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of all occurrences of the phrase, overlapping ones too."""
    last = F.size(words) - len(phrase)
    same = lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(phrase)])
    starts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), same)
    return F.when(F.array_contains(words, phrase[-1]) & (last >= 0), starts).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def rare_words(files: DataFrame, templates: DataFrame, content: str, per_template: int, least: float) -> DataFrame:
    """(template, label, place, word, idf, total, is_key): the ``per_template`` words of each template with the highest IDF over all files.

    Key words are the rarest of them, as many as it takes for the others to stay below ``least`` of the IDF sum: a
    file without any of them cannot reach it. IDF values are decimals, so their sums do not depend on the order of the rows.
    """
    vocabulary = templates.select(F.explode("words").alias("word")).distinct()
    seen = files.select(F.explode(F.array_distinct(words_of(F.col(f"`{content}`")))).alias("word"))
    counted = join_small(seen, vocabulary, "word", F.xxhash64(F.rand(1))).groupBy("word").agg(F.count("*").alias("files"))
    n = files.count()
    idf = F.log((F.lit(n) + 1.0) / (F.coalesce("files", F.lit(0)) + 1.0)) + 1.0
    placed = templates.select("template", "label", F.posexplode("words").alias("place", "word")).join(counted, "word", "left")
    first = Window.partitionBy("template").orderBy(F.desc("idf"), "place")
    ranked = placed.withColumn("idf", F.round(idf, 6).cast("decimal(12,6)")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_template)
    rarer = first.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({"total": F.sum("idf").over(Window.partitionBy("template")), "above": F.coalesce(F.sum("idf").over(rarer), F.lit(0))})
    return ranked.select("template", "label", "place", "word", "idf", "total", (F.col("total") - F.col("above") >= least * F.col("total")).alias("is_key"))


def scan_licenses(
    files: DataFrame,
    templates: DataFrame | None = None,
    id_col: str = "file_id",
    content: str = "content",
    carry: list[str] | None = None,
    per_template: int = 6,
    least: float = 0.7,
) -> DataFrame:
    """The columns in ``carry`` (default all) plus n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: every place where the words of a base phrase stand in a row. Method: the ``per_template`` words with
    the highest IDF over all files index each template. A file that holds a rarest one looks its words up; each hit votes
    for a template at a relative position (place in the file minus place in the template), and a template
    whose votes at one position reach ``least`` of its IDF sum is a candidate there. It counts if its mandatory
    phrases stand at their places. ``score`` is 1 with a base phrase, else the largest share of an accepted template, else 0.

    Defined results: null and empty content has no words and no label; labels are distinct, sorted and joined by commas;
    rows equal in id and content get equal results; extra columns are carried; added columns replace
    columns of the same name; with an empty template table only base labels remain.
    """
    spark = files.sparkSession
    templates = template_table(spark) if templates is None else templates
    names = files.columns if carry is None else carry
    index = cut_lineage(rare_words(files, templates, content, per_template, least))
    listed = index.groupBy("word").agg(F.max("is_key").alias("is_key")).collect()  # at most per_template words a template
    anchors, keys = sorted(r["word"] for r in listed), sorted(r["word"] for r in listed if r["is_key"])
    df = files.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(f"`{content}`").alias("version"), words_of(F.col(f"`{content}`")).alias("words"),
    )
    # the few files with a key word
    some = df.where(F.arrays_overlap("words", F.array(*[F.lit(a) for a in keys]).cast("array<string>"))).select("id", "version", "words")
    some = cut_lineage(some)
    known = F.array(*[F.lit(a) for a in anchors]).cast("array<string>")
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(known, w), F.struct(i.alias("place"), w.alias("word")))), lambda s: s.isNotNull())
    hits = some.select("id", "version", F.explode(at).alias("hit")).select("id", "version", F.col("hit.word").alias("word"), F.col("hit.place").alias("at"))
    hits = hits.groupBy("id", "version", "word", "at").agg(F.count("*").alias("rows"))
    votes = join_small(hits, index.groupBy("word").agg(F.collect_list(F.struct("template", "place", "idf", "total")).alias("postings")), "word", F.xxhash64("id", "at"))
    votes = votes.select("id", "version", "at", F.inline("postings"))
    aligned = votes.groupBy("id", "version", "template", (F.col("at") - F.col("place")).alias("shift")).agg((F.sum("idf").cast("double") / F.max("total").cast("double")).alias("share"))
    aligned = join_small(aligned.where(F.col("share") >= least), templates.select("template", "label", "phrases"), "template", F.xxhash64("id", "shift"))
    placed = some.join(aligned, ["id", "version"])
    there = F.forall(
        "phrases",
        lambda p: (F.col("shift") + p["place"] >= 0)
        & (F.slice("words", F.greatest(F.col("shift") + p["place"] + 1, F.lit(1)), F.size(p["words"])) == p["words"]),
    )
    found = placed.where(there).groupBy("id", "version").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    places = {label: _places(F.col("words"), phrase.split()) for phrase, label in BASE_PHRASES}
    every = F.concat(*places.values())
    base = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for label, p in places.items()]))
    facts = df.select(
        "row", "id", "version", F.size("words").cast("bigint").alias("n_words"), every.alias("places"), base.alias("base")
    )
    found = found.select(F.col("id").alias("found_id"), F.col("version").alias("found_version"), "more", "share")
    out = facts.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("version") == F.col("found_version")), "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return unpacked(
        out,
        n_words="n_words",
        n_base=F.size("places").cast("bigint"),
        first_word=F.array_min("places").cast("bigint"),
        last_word=F.array_max("places").cast("bigint"),
        base_labels=joined(F.col("base")),
        labels=joined(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))),
        score=F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)))),
    )
