"""Quality rules for risk reports: text statistics and perplexity bands of a Kneser-Ney model.

Text records of this project are the per-user risk reports (``user_id``, ``report``); the
column arguments name any other. N-grams are counted by Spark over every whole report,
per language; the model is interpolated modified Kneser-Ney over the bytes of normalised
words. Every counted n-gram keeps its own probability; the texts look them up in sorted arrays of exact keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import cut_lineage, join_small, unpacked
from .textbytes import LOWER, SPACE_WORD, U64, SegmentHash, lines, text_chunks, window_hashes, words

ORDER = 5
UNKNOWN = "und"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True  # fixed values of the symbol rule


# ------------------------------------------------------------------ n-grams


def _grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-gram, text) for every position of every text.

    A text is its lower-cased words joined by one blank, with ``ORDER - 1`` blanks before the
    first; each byte after the padding ends one n-gram of ``ORDER`` bytes.
    """
    low = LOWER[buf]
    starts, ends, firsts = words(buf, offsets, SPACE_WORD)
    inside = SPACE_WORD[buf]
    # a word's bytes plus one blank after it; blanks before the first word are the padding
    text_of_word = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    sizes = ends - starts
    keep = low[inside]
    gaps = np.zeros(len(keep) + 1, np.int64)
    after = np.cumsum(sizes)
    gaps[after] += 1
    some = np.flatnonzero(np.diff(firsts) > 0)
    before = np.concatenate([[0], after])[firsts[some]]
    np.add.at(gaps, before, ORDER - 1)
    place = np.arange(len(keep)) + np.cumsum(gaps)[: len(keep)]
    total = len(keep) + int(gaps.sum())
    line = np.full(total, 32, np.uint8)
    line[place] = keep
    per_text = np.bincount(text_of_word, sizes + 1, len(offsets) - 1).astype(np.int64)
    per_text[some] += ORDER - 1
    owner = np.repeat(np.arange(len(offsets) - 1), per_text)
    if total < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(total - ORDER + 1, np.uint64)
    for k in range(ORDER):
        code = (code << U64(8)) | line[k : k + len(code)]
    whole = owner[: len(code)] == owner[ORDER - 1 :]
    return code[whole], owner[: len(code)][whole]


def _by_language(languages: list[str], owner: np.ndarray):
    """(language, texts' mask over n-grams) of a chunk."""
    index: dict[str, int] = {}
    code = np.array([index.setdefault(x, len(index)) for x in languages], np.int64)
    of = code[owner]
    for language, i in index.items():
        yield language, (slice(None) if len(index) == 1 else np.flatnonzero(of == i))


def _count(batches):
    for batch in batches:
        languages = batch.column(1).to_pylist()
        sums: dict[str, list] = {}
        for first, end, buf, offsets in text_chunks(batch.column(0), 1 << 21):
            gram, owner = _grams(buf, offsets)
            for language, own in _by_language(languages[first:end], owner):
                key, n = np.unique(gram[own], return_counts=True)
                sums.setdefault(language, []).append((key, n))
        for language, got in sums.items():
            key = np.concatenate([k for k, _ in got])
            key, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in got]), len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language], pa.string()).take(pa.array(np.zeros(len(key), np.int32))), pa.array(key.astype(np.int64)), pa.array(n)],
                names=["language", "gram", "n"],
            )


def count_ngrams(reports: DataFrame, report: str = "report", language: str = "lang") -> DataFrame:
    """(language, gram, n) over all whole reports; a batch adds up before it is shuffled."""
    texts = reports.select(F.col(f"`{report}`"), F.coalesce(F.col(f"`{language}`").cast("string"), F.lit(UNKNOWN)).alias("language"))
    rows = texts.mapInArrow(_count, "language string, gram bigint, n bigint")
    return rows.groupBy("language", "gram").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ modified Kneser-Ney


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(order, language, gram, net, total, back) of all orders 0..``ORDER``.

    ``net``: count less its discount; ``total`` and ``back``: as a context, the sum of the counts and the
    share of it that the discounts leave to the order below. Counts are raw at the top
    order and numbers of distinct preceding bytes below it. The interpolated probability is
    ``net / total(context) + back(context) * p(shorter n-gram)``, and 1/256 below order 1.
    """
    levels = [counts.select(F.lit(ORDER).alias("order"), "language", "gram", "n")]
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << (8 * k)) - 1).alias("gram")
        level = levels[-1].select("language", shorter).groupBy("language", "gram").agg(F.count("*").alias("n"))
        levels.append(cut_lineage(level.select(F.lit(k).alias("order"), "language", "gram", "n")))
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)
    many = lambda condition, name: F.sum(condition.cast("bigint")).alias(name)
    n = F.col("n")
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    cut = lambda k: F.greatest(
        F.lit(0.1), F.least(F.lit(float(k)), F.coalesce(k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}"), F.lit(0.5 * k)))
    )
    key = F.concat_ws(":", "order", "language").alias("key")
    cuts = grams.groupBy("order", "language").agg(*[many(n == k, f"n{k}") for k in (1, 2, 3, 4)]).select(key, *[cut(k).alias(f"d{k}") for k in (1, 2, 3)])
    cuts = cut_lineage(cuts)
    contexts = grams.groupBy((F.col("order") - 1).alias("below"), "order", "language", F.shiftright("gram", 8).alias("gram")).agg(
        F.sum("n").alias("total"), many(n == 1, "n1"), many(n == 2, "n2"), many(n > 2, "n3")
    )
    contexts = join_small(contexts.withColumn("key", key), cuts, "key", F.xxhash64("gram"))
    left = F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")
    contexts = contexts.select(F.col("below").alias("order"), "language", "gram", F.lit(None).cast("double").alias("net"), F.col("total").cast("double").alias("total"), (left / F.col("total")).alias("back"))
    rows = join_small(grams.withColumn("key", key), cuts, "key", F.xxhash64("gram"))
    own = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    none = F.lit(None).cast("double")
    return rows.select("order", "language", "gram", (n - own).alias("net"), none.alias("total"), none.alias("back")).unionByName(contexts)


def model_arrays(model: DataFrame) -> dict[int, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Per order and language: sorted n-grams, and their net, total and back; nothing is left out.

    All of the model comes to the driver: for other texts than those counted, and models that fit there.
    """
    most = [F.max(c).alias(c) for c in ("net", "total", "back")]
    got = model.groupBy("order", "language", "gram").agg(*most).select("order", "language", "gram", "net", "total", "back").toArrow()
    order = got.column("order").to_numpy()
    names = got.column("language").combine_chunks().dictionary_encode()
    name = names.indices.to_numpy(zero_copy_only=False)
    grams = got.column("gram").to_numpy().astype(np.uint64)
    values = [np.nan_to_num(got.column(c).to_numpy(), nan=0.0) for c in ("net", "total", "back")]
    out = {}
    for k in range(ORDER + 1):
        out[k] = {}
        for i, language in enumerate(names.dictionary.to_pylist()):
            own = np.flatnonzero((order == k) & (name == i))
            own = own[np.argsort(grams[own])]
            out[k][language] = (grams[own], *[v[own] for v in values])
    return out


hash_arrays = model_arrays  # earlier name


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
    return at, (known[at] == wanted) if len(known) else np.zeros(len(wanted), bool)


def log_probabilities(model: dict, language: str, gram: np.ndarray) -> np.ndarray:
    """Interpolated log p of each distinct n-gram; an n-gram or context that was never seen leaves all to the shorter one."""
    p = np.full(len(gram), 1 / 256)
    for k in range(1, ORDER + 1):
        if language not in model[k]:
            continue
        short = gram & U64((1 << (8 * k)) - 1)
        known, _, totals, backs = model[k - 1][language]
        at, seen = _find(known, short >> U64(8))
        if not seen.any():
            continue
        total, back = np.where(seen, totals[at], 0), np.where(seen, backs[at], 0)
        seen &= total > 0
        known, nets, _, _ = model[k][language]
        at, hit = _find(known, short)
        net = np.where(hit, nets[at], 0) if len(nets) else 0.0
        p = np.where(seen, net / np.maximum(total, 1e-9) + back * p, p)
    return np.log(p)


# ------------------------------------------------------------------ scores of the counted n-grams


def counted_probabilities(model: DataFrame) -> DataFrame:
    """(language, gram, logp) of every counted n-gram of ``ORDER`` bytes.

    The context and the shorter n-gram of a counted one are counted themselves, so inner joins lose nothing. At
    most 256 n-grams share either of them.
    """
    p = None
    for k in range(1, ORDER + 1):
        own = model.where((F.col("order") == k) & F.col("net").isNotNull()).select(
            "language", "gram", "net", F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND((1 << (8 * (k - 1))) - 1).alias("shorter")
        )
        contexts = model.where((F.col("order") == k - 1) & F.col("total").isNotNull()).select("language", F.col("gram").alias("context"), "total", "back")
        rows = own.join(contexts, ["language", "context"])
        below = F.lit(1 / 256)
        if p is not None:
            rows, below = rows.join(p.select("language", F.col("gram").alias("shorter"), F.col("p").alias("below")), ["language", "shorter"]), F.col("below")
        p = rows.select("language", "gram", (F.col("net") / F.col("total") + F.col("back") * below).alias("p"))
    return p.select("language", "gram", F.log("p").alias("logp"))


PART_ROWS = 1 << 22


class LogTable:
    """Every counted n-gram's log p, as sorted parts of about ``PART_ROWS`` rows that are broadcast one by one.

    A key is the number of the language above the ``GRAM_BITS`` bits of the n-gram, so no two n-grams share one. The driver and a
    Python worker hold one part at a time; there are as many parts as the n-grams need.
    """

    def __init__(self, numbers: dict[str, int], bounds: list[int], parts: list):
        self.numbers, self.bounds, self.parts = numbers, np.array(bounds, np.uint64), parts

    def of_batch(self, wanted) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys, log p) that cover the arrays of keys that ``wanted()`` yields."""
        if len(self.parts) == 1:
            return self.parts[0].value
        keys = np.zeros(0, np.uint64)
        for some in wanted():
            keys = np.union1d(keys, some)
        cuts = np.searchsorted(keys, self.bounds)
        logp = np.full(len(keys), np.nan)
        for part, first, end in zip(self.parts, [0, *cuts], [*cuts, len(keys)]):
            if end > first:
                known, values = part.value
                at, hit = _find(known, keys[first:end])
                logp[first:end][hit] = values[at[hit]]
                if getattr(part, "_path", None):
                    del part._value  # the next use reads it from the worker's disk again
        seen = ~np.isnan(logp)
        return keys[seen], logp[seen]


GRAM_BITS = 8 * ORDER


def log_table(scores: DataFrame, part_rows: int | None = None) -> LogTable:
    """``scores`` (language, gram, logp) for look-ups in tasks."""
    part_rows = part_rows or PART_ROWS
    sc = scores.sparkSession.sparkContext
    names = scores.select("language").distinct().toArrow().column("language").to_pylist()
    if len(names) >= 1 << (63 - GRAM_BITS):
        raise ValueError(f"{len(names)} languages; at most {(1 << (63 - GRAM_BITS)) - 1} can be numbered")
    numbers = {name: i for i, name in enumerate(sorted(names))}
    shared = sc.broadcast(numbers)

    def number(batches):
        for batch in batches:
            of = batch.column(0).dictionary_encode()
            codes = np.array([shared.value[x] for x in of.dictionary.to_pylist()] or [0], np.int64)
            key = (codes[of.indices.to_numpy(zero_copy_only=False)] << GRAM_BITS) | batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(2)], names=["key", "logp"])

    rows = scores.mapInArrow(number, "key bigint, logp double")
    # sorted files: the scan of one part skips the others
    rows = cut_lineage(rows.sortWithinPartitions("key"))
    n = rows.count()
    bounds: list[int] = []
    if n > part_rows:
        k = -(-n // part_rows)
        bounds = sorted(set(rows.agg(F.percentile_approx("key", [i / k for i in range(1, k)], 10000)).first()[0]))
    parts = []
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = rows
        if low is not None:
            part = part.where(F.col("key") >= low)
        if high is not None:
            part = part.where(F.col("key") < high)
        got = part.toArrow()
        key = got.column("key").to_numpy().astype(np.uint64)
        rank = np.argsort(key)
        parts.append(sc.broadcast((key[rank], got.column("logp").to_numpy()[rank])))
    return LogTable(numbers, bounds, parts)


# ------------------------------------------------------------------ rules and verdict


def _repeats(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each value occurs elsewhere in the same text."""
    if not len(values):
        return np.zeros(0, bool)
    rank = np.lexsort((values, owner))
    v, o = values[rank], owner[rank]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    out = np.zeros(len(values), bool)
    out[rank[1:]] |= same
    out[rank[:-1]] |= same
    return out


def _rule_counts(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(offsets) - 1
    starts, ends, firsts = words(buf, offsets, SPACE_WORD)
    owner = np.repeat(np.arange(n), np.diff(firsts))
    hashes = SegmentHash(buf)
    byte_owner = np.repeat(np.arange(n), np.diff(offsets))
    char = SPACE_WORD[buf] & ((buf & 0xC0) != 0x80)
    counts = [np.diff(firsts), np.bincount(byte_owner[char], minlength=n), np.bincount(byte_owner[SYMBOLS[buf]], minlength=n)]
    line_start, end, text = lines(buf, offsets)
    has_word = np.searchsorted(starts, end) > np.searchsorted(starts, line_start)
    line_start, end, text = line_start[has_word], end[has_word], text[has_word]
    line = hashes(line_start, end)
    rank = np.lexsort((line, text))
    again = (line[rank][1:] == line[rank][:-1]) & (text[rank][1:] == text[rank][:-1])
    counts.append(np.bincount(text[rank][1:][again], minlength=n))
    window = window_hashes(hashes(starts, ends), 5)
    repeated = np.zeros(len(starts) + 1, np.int64)
    if len(window):
        whole = owner[: len(window)] == owner[4:]
        at = np.flatnonzero(whole)
        again = at[_repeats(window[at], owner[at])]
        np.add.at(repeated, again, 1)
        np.add.at(repeated, again + 5, -1)
    covered = np.cumsum(repeated)[:-1] > 0
    counts.append(np.bincount(owner[covered], minlength=n))
    return counts


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scorer(table: LogTable):
    numbers = table.numbers

    def distinct(column, languages):
        """Arrays of the keys in a batch's texts."""
        for first, end, buf, offsets in text_chunks(column, 1 << 20):
            gram, owner = _grams(buf, offsets)
            for language, own in _by_language(languages[first:end], owner):
                if len(gram[own]):
                    yield np.unique(gram[own]) | (U64(numbers[language]) << U64(GRAM_BITS))

    def score(batches):
        for batch in batches:
            size = batch.num_rows
            rules = np.zeros((len(RULES), size), np.int64)
            total, grams = np.zeros(size), np.zeros(size, np.int64)
            languages = batch.column(2).to_pylist()
            known, values = table.of_batch(lambda: distinct(batch.column(1), languages))
            for first, end, buf, offsets in text_chunks(batch.column(1), 1 << 20):
                rules[:, first:end] = _rule_counts(buf, offsets)
                gram, owner = _grams(buf, offsets)
                grams[first:end] = np.bincount(owner, minlength=end - first)
                for language, own in _by_language(languages[first:end], owner):
                    # sorted n-grams: equal ones are looked up once, and neighbours lie together
                    key = np.sort((gram[own] << U64(24)) | owner[own].astype(np.uint64))
                    if not len(key):
                        continue
                    code = key >> U64(24)
                    new = np.concatenate([[True], code[1:] != code[:-1]])
                    at, hit = _find(known, code[new] | (U64(numbers[language]) << U64(GRAM_BITS)))
                    if not hit.all():
                        raise ValueError("a text has n-grams that were not counted: the table changed between two reads")
                    logp = values[at][np.cumsum(new) - 1]
                    total[first:end] += np.bincount((key & U64((1 << 24) - 1)).astype(np.int64), logp, end - first)
            # on a fine grid, so that the order of the summands does not show
            cross = np.round(-total / np.maximum(grams, 1), 9)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(r) for r in rules], pa.array(cross, mask=grams == 0)],
                names=["row", "language", *RULES, "cross"],
            )

    return score


def quality(
    reports: DataFrame,
    report: str = "report",
    language: str = "lang",
    carry: list[str] | None = None,
    fences: float = 4.0,
    short: int = 500,
    least_words: int = 10,
    most_repeated: int = 20,
) -> DataFrame:
    """The columns in ``carry`` (default all) plus the rule counts, log_perplexity, its band, base_failed and kept.

    Rules on words split at white space: ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word equal to an earlier line), ``n_repeat_words`` (words in five-word windows found
    at least twice in the report); ``base_failed`` is fewer than ``least_words`` words or more than
    ``most_repeated`` percent of words in repeated windows.

    ``log_perplexity`` is the mean negative log probability per byte under the language's
    model, which is counted over all reports. Each language's band reaches ``fences``
    interquartile ranges below and above the quartiles of the reports that pass the rules (exact
    to one part in 10,000 of the ranks); for a report of n characters it is wider by the factor
    ``sqrt(1 + short / n)``, as a mean over few characters varies more. A report outside the band is not ``kept``.

    Defined results: null or empty reports have zero counts, no perplexity and fail the base rule; a
    null language counts as ``und``; repeated rows are judged one by one; added
    columns replace columns of the same name; an empty table gives an empty result.
    """
    counts = cut_lineage(count_ngrams(reports, report, language))
    table = log_table(cut_lineage(counted_probabilities(cut_lineage(kneser_ney(counts)))))
    df = reports.select(
        F.struct(*[F.col(f"`{c}`") for c in (reports.columns if carry is None else carry)]).alias("row"),
        F.col(f"`{report}`").alias("report"),
        F.coalesce(F.col(f"`{language}`").cast("string"), F.lit(UNKNOWN)).alias("language"),
    )
    schema = T.StructType([df.schema["row"]]).add("language", "string")
    for r in RULES:
        schema = schema.add(r, "long")
    scored = cut_lineage(df.mapInArrow(_scorer(table), schema.add("cross", "double")))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    quartiles = scored.where(~failed).groupBy("language").agg(F.percentile_approx("cross", [0.25, 0.75], 10000).alias("q"))
    bands = quartiles.select("language", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    judged = join_small(scored, bands, "language", F.xxhash64("cross", "word_chars"), "left")
    reach = fences * (F.col("q3") - F.col("q1")) * F.sqrt(1 + short / F.greatest(F.col("word_chars"), F.lit(1)))
    judged = judged.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    inside = F.coalesce(F.col("cross").between(F.col("low"), F.col("high")), F.lit(True))
    return unpacked(
        judged,
        **{r: r for r in RULES},
        log_perplexity="cross", band_low="low", band_high="high",
        base_failed=failed,
        kept=~failed & inside,
    )
