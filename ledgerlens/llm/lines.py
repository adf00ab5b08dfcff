"""Substring deduplication of risk reports by hashing pieces of their lines.

Text records of this project are the per-user risk reports (``user_id``, ``report``), whose
lines recur from user to user; the column arguments name any other table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import cut_lineage, unpacked
from .textbytes import LOWER, SPACE_WORD, U64, SegmentHash, mix, text_chunks, words


# a unit ends after a word whose lower-cased bytes add up to a multiple of CUT, on average every CUT words
CUT, MIN_WORDS = 8, 25


def _unit_rows(batches):
    for batch in batches:
        for first, end, buf, offsets in text_chunks(batch.column(2)):
            low = LOWER[buf]
            word_start, word_end, _ = words(low, offsets, SPACE_WORD)
            if not len(word_start):
                continue
            text = np.searchsorted(offsets, word_start, "right") - 1
            line = np.cumsum(np.concatenate([[0], buf == 10]))[word_start]
            total = np.concatenate([[0], np.cumsum(low, dtype=np.int64)])
            closes = (total[word_end] - total[word_start]) % CUT == 0
            closes[:-1] |= (text[1:] != text[:-1]) | (line[1:] != line[:-1])
            closes[-1] = True
            last = np.flatnonzero(closes)
            begin = np.concatenate([[0], last[:-1] + 1])
            size = last - begin + 1
            digests = []
            for kind in (0, 1):
                # a unit's digest: its word hashes weighted by their place in the unit
                word = SegmentHash(low, kind)(word_start, word_end)
                place = (np.arange(len(word)) - np.repeat(begin, size)).astype(np.uint64)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(word + place * U64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
                digests.append(mix(sums[last + 1] - sums[begin] + size.astype(np.uint64)).astype(np.int64))
            char = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            text = text[begin]
            number = np.arange(len(begin)) - np.searchsorted(text, text)
            base = char[offsets[text]]
            take = pa.array(first + text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(number.astype(np.int32)), pa.array((char[word_start[begin]] - base).astype(np.int32)),
                    pa.array((char[word_end[last]] - base).astype(np.int32)), pa.array(size.astype(np.int32)), *[pa.array(d) for d in digests],
                ],
                names=["id", "version", "number", "first", "last", "words", "d1", "d2"],
            )


def _spans(units: list[dict], min_words: int) -> list[dict]:
    """Runs of consecutive units with at least ``min_words`` words together."""
    out, before, words_in_run = [], None, 0
    for u in sorted(units, key=lambda u: u["number"]):
        if before is not None and u["number"] == before + 1:
            out[-1]["last"], words_in_run = u["last"], words_in_run + u["words"]
        else:
            if out and words_in_run < min_words:
                out.pop()
            out.append({"first": u["first"], "last": u["last"]})
            words_in_run = u["words"]
        before = u["number"]
    if out and words_in_run < min_words:
        out.pop()
    return out


def _without(text: str, spans: list[dict]) -> str:
    at, out = 0, []
    for s in spans:
        out.append(text[at : s["first"]])
        at = s["last"]
    return "".join([*out, text[at:]])


def _cut_rows(at: int, min_words: int):
    """``at``: place of the text among the fields of the row, which is moved once."""

    def cut(batches):
        for batch in batches:
            spans = [_spans(u, min_words) if u else [] for u in batch.column(1).to_pylist()]
            texts = batch.column(0).field(at)
            kept = [_without(texts[i].as_py(), s) if s else None for i, s in enumerate(spans)]
            whole = pa.compute.if_else(pa.array([bool(s) for s in spans], pa.bool_()), pa.array(kept, pa.string()), texts.cast(pa.string()))
            listed = pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), whole, listed], names=["row", "kept", "spans"])

    return cut


def repeated_lines(reports: DataFrame, id_col: str = "user_id", report: str = "report") -> DataFrame:
    """(id, version, units): the units of each report that an earlier one has already, with number, first, last and words.

    Units are pieces of lines: a line is cut after every word whose lower-cased bytes add up to a multiple of ``CUT``, so
    equal passages are cut alike wherever they stand, and one other word costs its own unit and not the line. The digest (128 bits) covers the lower-cased (A-Z) words
    split at white space, so case and spacing do not matter. Equal digests over all reports form a group;
    the occurrence with the smallest (id, version, place) stays. ``first`` and ``last`` (exclusive) are characters
    of the original text, ``version`` is a hash of the text.
    """
    texts = reports.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{report}`").alias("version"), F.col(f"`{report}`").alias("report"))
    schema = T.StructType([texts.schema["id"]]).add("version", "long")
    for name in ("number", "first", "last", "words"):
        schema = schema.add(name, "integer")
    units = cut_lineage(texts.mapInArrow(_unit_rows, schema.add("d1", "long").add("d2", "long")))
    place = F.struct("id", "version", "number")
    groups = cut_lineage(units.groupBy("d1", "d2").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # joined without an aggregate on the digest, so the partition of a hot unit can be split
    gone = units.join(groups, ["d1", "d2"]).where(~place.eqNullSafe(F.col("kept")))
    return gone.groupBy("id", "version").agg(F.collect_set(F.struct("number", "first", "last", "words")).alias("units"))


def drop_repeated_lines(reports: DataFrame, id_col: str = "user_id", report: str = "report", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns, the report without its repeated passages, and removed_spans with their original offsets.

    A passage is a run of consecutive repeated units (see ``repeated_lines``) with at least ``min_words`` words together; it is cut out exactly,
    from its first to its last word. Shorter runs are stock phrases and stay.

    Defined results: null reports stay null and empty ones empty, without spans; very long reports are read whole; rows equal in id and text are one
    report; of different texts under one id the one with the smaller hash is the earlier; a null id ranks before all
    others; an empty table stays empty; an existing column ``removed_spans`` is replaced.
    """
    df = reports.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{report}`").alias("version"))
    gone = repeated_lines(reports, id_col, report).where(F.aggregate("units", F.lit(0), lambda t, u: t + u["words"]) >= min_words)
    gone = gone.select(F.col("id").alias("gone_id"), F.col("version").alias("gone_version"), "units")
    joined = df.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left")
    joined = joined.select("row", "units")
    schema = T.StructType([joined.schema["row"]]).add("kept", "string").add("spans", T.ArrayType(T.StructType().add("first", "long").add("last", "long")))
    out = joined.mapInArrow(_cut_rows(reports.columns.index(report), min_words), schema)
    order = [F.col(f"`{c}`") for c in reports.columns if c.lower() != "removed_spans"]
    return unpacked(out, **{report: "kept", "removed_spans": "spans"}).select(*order, "removed_spans")
