"""Benchmark decontamination of risk reports: a broadcast hash set of normalised test n-grams.

Text records of this project are the per-user risk reports (``user_id``, ``report``);
any other table works through the column arguments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import cut_lineage, unpacked
from .textbytes import LETTER_DIGIT_WORD, LOWER, SegmentHash, text_chunks, window_hashes, words

SPANS = "array<struct<first:bigint,last:bigint>>"


def _item_windows(column: pa.Array, size: int):
    """Per window of every item: (item row, words in the window, hash, window text)."""
    for first, _, raw, offsets in text_chunks(column):
        buf = LOWER[raw]
        starts, ends, firsts = words(buf, offsets, LETTER_DIGIT_WORD)
        hashes = SegmentHash(buf)(starts, ends)
        for i in range(len(offsets) - 1):
            a, b = int(firsts[i]), int(firsts[i + 1])
            length = min(size, b - a)
            if not length:
                continue
            own = window_hashes(hashes[a:b], length)
            for j, h in enumerate(own):
                parts = [buf[starts[a + j + k] : ends[a + j + k]].tobytes() for k in range(length)]
                yield first + i, length, int(h), b" ".join(parts)


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", size: int = 13) -> DataFrame:
    """(length, hash, window, items): each distinct window with the sorted ids, as text, of its items.

    Windows are ``size`` consecutive words; a shorter item is one window; an item
    without words has none. Items with a null id have windows but no entry in ``items``.
    """

    def cut(batches):
        for batch in batches:
            found = list(_item_windows(batch.column(1), size))
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    pa.array([f[1] for f in found], pa.int32()),
                    pa.array([np.uint64(f[2]).astype(np.int64) for f in found], pa.int64()),
                    pa.array([f[3] for f in found], pa.binary()),
                ],
                names=["item", "length", "hash", "window"],
            )

    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text"))
    rows = items.mapInArrow(cut, "item string, length int, hash bigint, window binary")
    return rows.groupBy("length", "hash", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _merge(spans: list[dict]) -> list[dict]:
    """Disjoint word ranges [first, last) in order."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["last"]:
            out[-1]["last"] = max(out[-1]["last"], s["last"])
        else:
            out.append(dict(s))
    return out


def _scanner(table, at: int):
    """mapInArrow function that adds the hits of one broadcast part of the windows to ``spans`` and ``items``.

    ``at``: place of the text among the fields of the row, which is sent once.
    """

    def scan(batches):
        lengths = table.value
        for batch in batches:
            by_name = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            spans, items = by_name["spans"].to_pylist(), by_name["items"].to_pylist()
            n_words = np.zeros(batch.num_rows, np.int64)
            for first, end, raw, offsets in text_chunks(by_name["row"].field(at)):
                buf = LOWER[raw]
                starts, ends, firsts = words(buf, offsets, LETTER_DIGIT_WORD)
                n_words[first:end] = np.diff(firsts)
                hashes = SegmentHash(buf)(starts, ends)
                for length, (known, texts) in lengths.items():
                    own = window_hashes(hashes, length)
                    if not len(own):
                        continue
                    order = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    for w in np.flatnonzero(known[order] == own):
                        i = int(np.searchsorted(firsts, w, "right")) - 1
                        if w + length > firsts[i + 1]:
                            continue
                        text = b" ".join(buf[starts[w + k] : ends[w + k]].tobytes() for k in range(length))
                        of = texts[int(own[w])].get(text)
                        if of is not None:
                            a = int(w - firsts[i])
                            row = first + i
                            spans[row].append({"first": a, "last": a + length})
                            items[row].extend(of)
            out = [
                by_name["row"],
                pa.array([_merge(s) for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                pa.array(n_words),
            ]
            yield pa.RecordBatch.from_arrays(out, names=["row", "spans", "items", "n_words"])

    return scan


def _part(windows: DataFrame, parts: int, p: int) -> dict:
    """Part ``p`` of the windows as {length: (sorted hashes, {hash: {window: items}})}."""
    part = windows.where(F.pmod("hash", F.lit(parts)) == p) if parts > 1 else windows
    table: dict[int, dict] = {}
    for r in part.toLocalIterator():
        key = int(np.int64(r["hash"]).astype(np.uint64))
        table.setdefault(r["length"], {}).setdefault(key, {})[bytes(r["window"])] = r["items"]
    return {length: (np.array(sorted(at), np.uint64), at) for length, at in table.items()}


def n_hit_of():
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["last"] - s["first"])


def is_contaminated():
    return (n_hit_of() > 0) & (20 * n_hit_of() >= F.col("n_words"))


def _judged(reports, benchmark, report, item_id, item_text, size, most_windows) -> DataFrame:
    sc = reports.sparkSession.sparkContext
    df = reports.select(F.struct("*").alias("row"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = T.StructType([df.schema[n] for n in ("row", "spans", "items")]).add("n_words", "long")
    windows = cut_lineage(benchmark_windows(benchmark, item_id, item_text, size))
    parts = max(1, -(-windows.count() // most_windows))
    for p in range(parts):
        found = _scanner(sc.broadcast(_part(windows, parts, p)), reports.columns.index(report))
        df = df.select("row", "spans", "items").mapInArrow(found, schema)
    return df


def contamination(
    reports: DataFrame,
    benchmark: DataFrame,
    report: str = "report",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    most_windows: int = 500_000,
) -> DataFrame:
    """All columns of the reports plus n_words, n_hit, items, spans and contaminated.

    Words are maximal runs of letters, digits and non-ASCII characters after lower-casing A-Z.
    ``spans`` holds disjoint word ranges [first, last) covered by a test window, ``items`` the
    ids of the items (as sorted strings) with an occurring window; ``contaminated`` is
    ``n_hit > 0 and 20 * n_hit >= n_words``. Every hash hit is verified on the words themselves.

    The window set is broadcast in parts of at most ``most_windows``; each part is one more
    narrow pass over the reports, so a large benchmark costs passes and never memory. No row is shuffled.

    Defined results: a null or empty report has no words and is clean; repeated rows are
    judged one by one; an empty benchmark marks nothing; added columns replace columns
    of the same name.
    """
    return unpacked(
        _judged(reports, benchmark, report, item_id, item_text, size, most_windows),
        n_words="n_words", n_hit=n_hit_of(), items="items", spans="spans", contaminated=is_contaminated(),
    )


def decontaminate(
    reports: DataFrame,
    benchmark: DataFrame,
    report: str = "report",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    most_windows: int = 500_000,
) -> DataFrame:
    """The reports without the contaminated ones, columns unchanged; arguments as in ``contamination``."""
    judged = _judged(reports, benchmark, report, item_id, item_text, size, most_windows)
    return judged.where(~is_contaminated()).select("row.*")
