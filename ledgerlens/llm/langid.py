"""Language identification of risk reports: averaged hashed subword embeddings and a linear softmax.

Text records of this project are the per-user risk reports (``user_id``, ``report``); the
column arguments name any other. The model is trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows and broadcast (its size is fixed by parameters).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import unpacked
from .textbytes import LOWER, U64, mix, text_chunks

UNDETERMINED = "und"
ORDERS = (2, 3, 4)


@dataclass(frozen=True)
class LanguageModel:
    """``weights[bucket]`` holds the class scores of one subword; ``scale`` and ``reject_below`` come from calibration."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    scale: float
    reject_below: float
    bits: int


def subwords(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every byte n-gram of the orders in ``ORDERS`` that stays in its text.

    A-Z is lower-cased and runs of digits, punctuation and white space are one blank, so
    only letters tell languages apart.
    """
    low = LOWER[buf]
    blank = ((low < 97) | (low > 122)) & (low < 128)
    low = np.where(blank, np.uint8(32), low)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = np.ones(len(low), bool)
    if len(low):
        keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    low, owner = low[keep], owner[keep]
    buckets, texts = [], []
    code = low.astype(np.uint64)
    for k in range(2, max(ORDERS) + 1):
        if len(low) < k:
            break
        code = (code[:-1] << U64(8)) | low[k - 1 :]
        if k in ORDERS:
            whole = owner[: len(code)] == owner[k - 1 :]
            buckets.append((mix(code[whole] + U64(k << 40)) >> U64(64 - bits)).astype(np.int64))
            texts.append(owner[: len(code)][whole])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(texts)


def _features(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and their shares."""
    out = []
    for _, _, buf, offsets in text_chunks(pa.array(texts, pa.string())):
        bucket, text = subwords(buf, offsets, bits)
        key, n = np.unique((text << bits) | bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(len(offsets)) << bits)
        for i in range(len(offsets) - 1):
            own = slice(cut[i], cut[i + 1])
            out.append((key[own] & ((1 << bits) - 1), (n[own] / max(n[own].sum(), 1)).astype(np.float32)))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def labelled_sample(reports: DataFrame, report: str, label: str, order: str, per_language: int, most_languages: int = 1024) -> list:
    """At most ``per_language`` labelled rows of each language, chosen by a hash of ``order``; few rows, whatever the input.

    Languages are counted over all rows. More than ``most_languages`` label values are an error, as the
    table of weights has a column for each: none is left out in silence.
    """
    known = reports.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{report}`").isNotNull())
    counts = known.groupBy(F.col(f"`{label}`").alias("language")).count()
    rows = counts.orderBy(F.desc("count"), "language").limit(most_languages + 1).collect()
    if not rows:
        return []
    if len(rows) > most_languages:
        raise ValueError(f"more than {most_languages} languages; raise most_languages, the model has a weight per subword and language")
    draw = F.xxhash64(F.col(f"`{order}`").cast("string"), F.lit("sample"))
    unit = F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for r in rows for x in (r["language"], min(1.0, 2.0 * per_language / r["count"]))])
    picked = known.select(F.col(f"`{report}`").alias("report"), F.col(f"`{label}`").alias("language"), draw.alias("draw"), unit.alias("unit"))
    picked = picked.where(F.col("unit") < F.coalesce(share[F.col("language")], F.lit(0.0)))
    n: dict[str, int] = {}
    out = []
    for r in picked.orderBy("draw", "language", "report").toLocalIterator():
        if n.get(r["language"], 0) < per_language:
            n[r["language"]] = n.get(r["language"], 0) + 1
            out.append((r["report"], r["language"]))
    return out


def train_language_model(
    reports: DataFrame,
    report: str = "report",
    label: str = "lang",
    order: str = "user_id",
    per_language: int = 400,
    dim: int = 16,
    bits: int = 18,
    epochs: int = 6,
    rate: float = 0.5,
    seed: int = 5,
) -> LanguageModel | None:
    """Train on at most ``per_language`` reports per language; one in five of them only calibrates.

    A report is the average of the embeddings of its subwords; a linear softmax sits on top. After
    training, both layers fold into one table of class scores per bucket. The scale of the
    scores minimises the log loss on the calibration rows, and ``reject_below`` is the
    largest score at which at least half of the calibration rows scored lower were wrong
    (never above one half), so a report is rejected only where a rejection is more likely right than wrong.
    Null texts and labels are left out; without any labelled row there is no model.
    """
    sample = labelled_sample(reports, report, label, order, per_language)
    if not sample:
        return None
    languages = tuple(sorted({lang for _, lang in sample}))
    target = np.array([languages.index(lang) for _, lang in sample])
    feats = _features([t for t, _ in sample], bits)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = np.zeros((dim, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    fit = [i for i in range(len(sample)) if i % 5 or len(sample) < 10]
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            idx, share = feats[i]
            step = rate * (1 - done / steps)
            done += 1
            if not len(idx):
                continue
            hidden = share @ embed[idx]
            grad = _softmax(hidden @ out + bias)
            grad[target[i]] -= 1
            back = out @ grad
            out -= step * np.outer(hidden, grad)
            bias -= 0.1 * step * grad
            embed[idx] -= step * len(idx) ** 0.5 * share[:, None] * back
    weights = embed @ out
    hold = [i for i in range(len(sample)) if i % 5 == 0]
    z = np.stack([feats[i][1] @ weights[feats[i][0]] + bias if len(feats[i][0]) else bias for i in hold])
    y = target[hold]
    loss = lambda s: -np.log(_softmax(z * s)[np.arange(len(y)), y] + 1e-9).mean()
    scale = float(min(np.geomspace(0.25, 64, 33), key=loss))
    p = _softmax(z * scale)
    top, wrong = p.max(1), p.argmax(1) != y
    rank = np.argsort(top)
    bad = np.cumsum(wrong[rank]) / np.arange(1, len(rank) + 1)
    good = np.flatnonzero(bad >= 0.5)
    reject = float(min(0.5, np.nextafter(top[rank][good[-1]], 2))) if len(good) else 0.0
    return LanguageModel(languages, weights.astype(np.float32), bias, scale, reject, bits)


def _predictor(shared, at: int):
    """``at``: place of the text among the fields of the row, which is sent once."""

    def predict(batches):
        model: LanguageModel = shared.value
        names = pa.array([*model.languages])
        for batch in batches:
            best = np.zeros(batch.num_rows, np.int64)
            score = np.zeros(batch.num_rows)
            for first, end, buf, offsets in text_chunks(batch.column(0).field(at)):
                bucket, text = subwords(buf, offsets, model.bits)
                n = end - first
                count = np.maximum(np.bincount(text, minlength=n), 1)
                z = np.stack([np.bincount(text, model.weights[:, c][bucket], n) for c in range(len(model.languages))], 1)
                p = _softmax((z / count[:, None] + model.bias) * model.scale)
                best[first:end], score[first:end] = p.argmax(1), p.max(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), names.take(pa.array(best)), pa.array(score), batch.column(1)], names=["row", "language", "p", "letters"]
            )

    return predict


def _judged(reports: DataFrame, model: LanguageModel | None, report: str) -> tuple[DataFrame, Column, Column]:
    letters = F.coalesce(F.col(f"`{report}`").rlike(r"\p{L}"), F.lit(False))
    df = reports.select(F.struct("*").alias("row"), letters.alias("letters"))
    if model is None:
        df = df.select("row", F.lit(UNDETERMINED).alias("language"), F.lit(0.0).alias("p"), F.lit(False).alias("letters"))
    else:
        schema = T.StructType([df.schema["row"]]).add("language", "string").add("p", "double").add("letters", "boolean")
        shared = reports.sparkSession.sparkContext.broadcast(model)
        df = df.mapInArrow(_predictor(shared, reports.columns.index(report)), schema)
    score = F.when(F.col("letters"), F.col("p")).otherwise(F.lit(0.0))
    return df, score, ~F.col("letters") | (score < (model.reject_below if model else 0.0))


def identify_language(reports: DataFrame, model: LanguageModel | None, report: str = "report") -> DataFrame:
    """All columns plus lang_pred, score and rejected; every whole report is read once, no shuffle.

    ``lang_pred`` is a learned language, or ``und`` with score 0 for a null report, one
    without a letter, or when there is no model. ``rejected`` marks ``und`` and scores below the model's
    calibrated ``reject_below``. Repeated rows get equal results; columns
    of the added names are replaced.
    """
    df, score, rejected = _judged(reports, model, report)
    language = F.when(F.col("letters"), F.col("language")).otherwise(F.lit(UNDETERMINED))
    return unpacked(df, lang_pred=language, score=score, rejected=rejected)


def keep_identified(reports: DataFrame, model: LanguageModel | None, report: str = "report") -> DataFrame:
    """The reports that are not rejected, columns unchanged.

    Defined results: null reports and those without a letter go; without a model (no labelled row) nothing can be
    judged and all reports stay; reports of any length are read whole; repeated rows stay or go together; an empty table stays empty.
    """
    if model is None:
        return reports
    df, _, rejected = _judged(reports, model, report)
    return df.where(~rejected).select("row.*")
