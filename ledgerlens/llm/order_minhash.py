"""Near-duplicate risk reports by Order MinHash, verified by banded alignment.

Text records of this project are the per-user risk reports (``user_id``, ``report``); the
column arguments name any other. K-mers are shingles of five consecutive words, labelled with
their occurrence number in the report.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .membership import members
from .rows import byte_batches, cut_lineage, drop_written
from .textbytes import LETTER_DIGIT_WORD, LOWER, U64, SegmentHash, mix, seeds, text_chunks, window_hashes, words

SHINGLE = 5
SKETCHES = 16
PICKS = 3
# linear way only: rounds in which members of a bucket that a centre did not take meet centres of finer buckets
REFINEMENTS = 2
# bytes of sequences that a worker holds at once
BATCH_BYTES = 4 << 20
# exact way only: members of a bucket up to which its texts of different groups all meet; larger ones go by their rare shingles (the links are the same)
WHOLE = 4
# rows of a key in a block of its pairs; bits of the slots that shingles are counted in
BLOCK = 512
COUNT_BITS = 22
# 64-bit words of a text's parity bits, which bound how far two texts differ
PARITY_WORDS = 8
PARITY = [f"bits{i}" for i in range(PARITY_WORDS)]


def _shingles(buf: np.ndarray, offsets: np.ndarray):
    """Per text: (word hashes, shingle hashes); fewer than five words are one shingle."""
    starts, ends, firsts = words(buf, offsets, LETTER_DIGIT_WORD)
    hashes = SegmentHash(buf)(starts, ends)
    windows = window_hashes(hashes, SHINGLE)
    for a, b in zip(firsts[:-1], firsts[1:]):
        n = b - a
        if n >= SHINGLE:
            yield hashes[a:b], windows[a : b - SHINGLE + 1]
        else:
            yield hashes[a:b], window_hashes(hashes[a:b], n) if n else hashes[a:b]


def _occurrences(values: np.ndarray) -> np.ndarray:
    """0 for the first place of a value, 1 for the second, and so on."""
    rank = np.argsort(values, kind="stable")
    v = values[rank]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    at = np.arange(len(v))
    out = np.empty(len(v), np.uint64)
    out[rank] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """``SKETCHES`` hashes, each of the ``PICKS`` smallest labelled shingles in text order."""
    labelled = mix(shingles + _occurrences(shingles) * U64(0x9E3779B97F4A7C15))
    values = labelled[None, :] * (seeds(SKETCHES, 3) | U64(1))[:, None]
    picks = min(PICKS, len(labelled))
    at = np.argpartition(values, picks - 1, axis=1)[:, :picks] if picks < len(labelled) else np.tile(np.arange(picks), (SKETCHES, 1))
    chosen = labelled[np.sort(at, axis=1)]
    out = np.zeros(SKETCHES, np.uint64)
    for j, factor in enumerate(seeds(picks, 13) | U64(1)):
        out += chosen[:, j] * factor
    return mix(out)


def _sketch_rows(batches):
    for batch in batches:
        n = batch.num_rows
        digest = np.zeros((n, 2), np.uint64)
        n_words = np.zeros(n, np.int64)
        bands = np.zeros((n, SKETCHES), np.uint64)
        for first, _, raw, offsets in text_chunks(batch.column(1)):
            for i, (word, shingle) in enumerate(_shingles(LOWER[raw], offsets), first):
                n_words[i] = len(word)
                if len(word):
                    place = np.arange(1, len(word) + 1, dtype=np.uint64)
                    digest[i] = mix(word * (place | U64(1)) + place).sum(), mix(mix(word + place) ^ U64(17)).sum()
                    bands[i] = sketch(shingle)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(n_words),
                pa.array(digest[:, 0].astype(np.int64)),
                pa.array(digest[:, 1].astype(np.int64)),
                pa.ListArray.from_arrays(np.arange(0, (n + 1) * SKETCHES, SKETCHES, dtype=np.int32), bands.ravel().astype(np.int64)),
            ],
            names=["id", "version", "n_words", "d1", "d2", "bands"],
        )


def _sequence_rows(wanted):
    """Shingles of the texts that may be in a pair; the joins that follow drop the few others."""

    def emit(batches):
        for batch in batches:
            some = np.flatnonzero(wanted.value.holds(batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint64)))
            picked = batch.take(pa.array(some))
            for first, end, raw, offsets in text_chunks(picked.column(1)):
                seq = [shingle.astype(np.uint64).tobytes() for _, shingle in _shingles(LOWER[raw], offsets)]
                part = picked.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(seq, pa.binary())], names=["id", "version", "seq"])

    return emit


def _in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two multisets."""
    (ux, cx), (uy, cy) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    return int(np.minimum(cx[i], cy[j]).sum())


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = 0.8) -> float:
    """Shingles matched in order over all shingles of both (a Jaccard similarity that order can lower).

    The longest common subsequence is taken within the band outside of which no alignment
    can reach ``least``, one machine-word-parallel row per shingle; 0 if the lengths or the shingles in any order rule it out.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    band = int((n + m) * (1 - least) / (1 + least)) + 1
    same = a[: min(n, m)] == b[: min(n, m)]
    head = int(np.argmin(same)) if not same.all() else len(same)
    x, y = a[head:], b[head:]
    same = x[::-1][: min(len(x), len(y))] == y[::-1][: min(len(x), len(y))]
    tail = (int(np.argmin(same)) if not same.all() else len(same)) if len(same) else 0
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    matched = head + tail
    # shingles in common in any order bound those matched in order
    most = matched + _in_common(x, y)
    if most / (n + m - most) < least:
        return 0.0
    x, y = x.tolist(), y.tolist()
    if x and y:
        places: dict[int, list[int]] = {}
        for j, v in enumerate(y):
            places.setdefault(v, []).append(j)
        # bit k of ``row`` is place ``low + k`` of y, 0 where a match ends; places below the band are counted and leave
        low, row, size = 0, (1 << min(len(y), band + 1)) - 1, min(len(y), band + 1)
        for i, v in enumerate(x):
            leave = max(0, i - band) - low
            if leave > 0:
                out = min(leave, size)
                matched += out - (row & ((1 << out) - 1)).bit_count()
                row >>= out
                low, size = low + leave, size - out
            grow = min(len(y), i + band + 1) - low - size
            if grow > 0:
                row |= ((1 << grow) - 1) << size
                size += grow
            hits, own = 0, places.get(v, ())
            for j in own[bisect_left(own, low) : bisect_right(own, low + size - 1)] if own else ():
                hits |= 1 << (j - low)
            if hits:
                both = row & hits
                row = ((row + both) | (row - both)) & ((1 << size) - 1)
        matched += size - row.bit_count()
    return matched / (n + m - matched)


def _residual_sketch(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sketches of the shingles that ``own`` has beyond ``other``, in text order; what a template gives to both is gone."""
    left = own[~np.isin(own, other)]
    return sketch(left) if len(left) else np.zeros(SKETCHES, np.uint64)


def _verifier(least: float):
    """Similarity of each pair; below ``least`` also the residual sketches of the ends that met a centre."""

    def verify(batches):
        for batch in batches:
            similarity, rest = np.zeros(batch.num_rows), ([], [])
            centres = [batch.column(k).to_pylist() for k in (4, 5)]
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                similarity[i] = aligned_similarity(a, b, least)
                apart = similarity[i] < least
                rest[0].append(_residual_sketch(a, b).astype(np.int64) if apart and centres[1][i] else None)
                rest[1].append(_residual_sketch(b, a).astype(np.int64) if apart and centres[0][i] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(similarity, pa.float64()), *[pa.array(r, pa.list_(pa.int64())) for r in rest]],
                names=["a", "b", "similarity", "rest_a", "rest_b"],
            )

    return verify


def _members(keys: DataFrame) -> DataFrame:
    """(key, id, low, drawn, n) of buckets with two members or more; low is the smallest member, drawn a drawn one.

    The two centres are found by a map-side combined
    aggregate; the join back has no aggregate behind it, so a hot bucket's partition can be split.
    """
    draw = F.struct(F.xxhash64("id", "key").alias("h"), "id")
    centres = keys.groupBy("key").agg(F.min("id").alias("low"), F.max(draw).alias("drawn"), F.count("*").alias("n"))
    centres = cut_lineage(centres.where("n > 1").select("key", "low", F.col("drawn.id").alias("drawn"), "n"))
    out = cut_lineage(keys.join(centres, "key").select("key", "id", "low", "drawn", "n"))
    drop_written(centres)
    return out


def _stars(members: DataFrame) -> DataFrame:
    """(a, b, centre_a, centre_b) with a < b: every member of a bucket with both centres. Linear in the bucket's size."""
    pairs = members.select("id", F.explode(F.array_distinct(F.array("low", "drawn"))).alias("centre")).where("id <> centre")
    both = pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"), "centre")
    return both.groupBy("a", "b").agg(F.max(F.col("centre") == F.col("a")).alias("centre_a"), F.max(F.col("centre") == F.col("b")).alias("centre_b"))


def _parts(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``pairs`` whose ends are in different groups of (id, part)."""
    out = pairs
    for end in ("a", "b"):
        out = out.join(groups.select(F.col("id").alias(end), F.col("part").alias(f"part_{end}")), end, "left")
    apart = F.coalesce("part_a", "a") != F.coalesce("part_b", "b")
    return out.where(apart).select(*pairs.columns)


def _finer_keys(apart: DataFrame, depth: int) -> DataFrame:
    """(key, id): an end that a centre did not take goes by the centre and each sketch of what the centre lacks."""
    out = None
    for end, other in (("a", "b"), ("b", "a")):
        keys = F.transform(f"rest_{end}", lambda x, i: F.xxhash64(F.lit(depth), F.col(other), i, x))  # noqa: B023
        rows = apart.where(F.col(f"rest_{end}").isNotNull()).select(F.explode(keys).alias("key"), F.col(end).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _needed(least: float):
    """Shingles that two texts of a link have in common at least."""
    return F.ceil(least / (1 + least) * (F.col("size_x") + F.col("size_y")) - 1e-9)


def _meetings(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(x, y, their sizes and places) for each key that a pair of different groups shares, and the table written; ``rows`` are (key, id, part, size, place, short, bits0, ...).

    The text with fewer shingles (``size``; of equal ones the smaller id) must be a ``short`` row of the key, and lengths that rule a link out are left out.
    Keys are shingles that all texts sort alike, or buckets of ``place`` null. Two bounds are judged in the join, before a pair is a row: of one
    key they share (at most as many shingles in common before it as the earlier place, and from it on as the shorter rest), and of the parity bits:
    a shingle that one of two texts has turns one bit, so they differ in at least as many shingles as bits.
    Of the largest group of a key no two members meet, and the members of a hot key meet in blocks.
    """
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("c"))
    main = parts.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.sum("c").alias("n"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = cut_lineage(rows.join(main, "key"))
    named = lambda end: [F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("part", "size", "place", *PARITY)]]
    differing = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in PARITY), F.lit(0))
    common = F.least("place_x", "place_y") + F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    near = F.col("place_x").isNull() | ((common >= _needed(least)) & (differing <= F.col("size_x") + F.col("size_y") - 2 * _needed(least)))
    out = None
    for short, long in ((F.col("part") != F.col("main"), F.lit(True)), (F.col("part") == F.col("main"), F.col("part") != F.col("main"))):
        x = rows.where(F.col("short") & short).select("key", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), *named("x"))
        y = rows.where(long).select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *named("y"))
        in_order = (F.col("size_x") < F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("x") < F.col("y")))
        fits = in_order & (F.col("part_x") != F.col("part_y")) & (F.col("size_x") >= least * F.col("size_y"))
        met = x.join(y, ["key", "block"]).where(fits & near).select("x", "y", "size_x", "size_y", "place_x", "place_y")
        out = met if out is None else out.unionByName(met)
    return out, rows


def _cross_pairs(rows: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) with a < b of different groups that may be links, of ``_meetings``; also returns the tables written on the way.

    A shingle that two texts share lies before the last key they share, or after it
    in both, so the keys they share and the shorter rest bound what they have in common; pairs that cannot reach ``least`` are left out.
    """
    met, rows = _meetings(rows, least)
    met = met.groupBy("x", "y").agg(
        F.count("*").alias("n"), F.max("size_x").alias("size_x"), F.max("size_y").alias("size_y"), F.max("place_x").alias("place_x"), F.max("place_y").alias("place_y")
    )
    most = F.col("n") + F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) - 1
    enough = F.col("place_x").isNull() | (most >= _needed(least))
    return cut_lineage(met.where(enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), [rows]


def _labelled(column) -> list[np.ndarray]:
    """Occurrence-labelled shingles of the sequences of a batch: sets of 64-bit values."""
    shingles = (np.frombuffer(x, np.uint64) for x in column.to_pylist())
    return [mix(x + _occurrences(x) * U64(0x9E3779B97F4A7C15)) if len(x) else x for x in shingles]


def _count_slots(batches):
    for batch in batches:
        slots = np.concatenate([np.zeros(0, U64), *_labelled(batch.column(1))]) >> U64(64 - COUNT_BITS)
        some, n = np.unique(slots.astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n.astype(np.int32))], names=["slot", "n"])


def _parity(labelled: np.ndarray) -> np.ndarray:
    """Bits that every shingle of a text turns once: equal shingles of two texts cancel."""
    at = (mix(labelled ^ U64(0xD6E8FEB86659FD93)) % U64(64 * PARITY_WORDS)).astype(np.int64)
    odd = np.bincount(at, minlength=64 * PARITY_WORDS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _prefix_rows(shared, least: float):
    def emit(batches):
        counts = shared.value
        for batch in batches:
            take, keys, place, short, size, bits = [], [], [], [], [], []
            for i, x in enumerate(_labelled(batch.column(1))):
                n = len(x)
                if not n:
                    continue
                long_prefix = n - int(np.ceil(least * n - 1e-9)) + 1
                short_prefix = n - int(np.ceil(2 * least / (1 + least) * n - 1e-9)) + 1
                rank = np.lexsort((x, counts[(x >> U64(64 - COUNT_BITS)).astype(np.int64)]))[:long_prefix]
                take.append(np.full(len(rank), i))
                keys.append(x[rank])
                place.append(np.arange(len(rank)))
                short.append(np.arange(len(rank)) < short_prefix)
                size.append(np.full(len(rank), n))
                bits.append(np.tile(_parity(x), (len(rank), 1)))
            if take:
                # a text's sequence is not repeated with its rows
                rows = batch.select([0, 2]).take(pa.array(np.concatenate(take)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).astype(np.int64)), rows.column(0), rows.column(1), pa.array(np.concatenate(size).astype(np.int32)),
                        pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(short)), *[pa.array(b) for b in np.concatenate(bits).T.copy()],
                    ],
                    names=["key", "id", "part", "size", "place", "short", *PARITY],
                )

    return emit


def _rare_pairs(texts: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of ``_cross_pairs`` for the members of large buckets, (id, seq, part), without all pairs of a bucket.

    Shingles are put in one order, rarest first (by counts of hash slots; any order gives the same links). If the similarity of two
    texts reaches ``least``, the first ``n - ceil(2 * least / (1 + least) * n) + 1`` of the n shingles of the
    shorter one share a shingle with the first ``m - ceil(least * m) + 1`` of the longer one, so no link is lost. Texts of one template
    below ``least`` meet only if they share rare shingles.
    """
    # counts beyond 2**31 - 1 sort alike
    n = F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")
    with byte_batches(texts.sparkSession, BATCH_BYTES):
        got = texts.mapInArrow(_count_slots, "slot int, n int").groupBy("slot").agg(n).toArrow()
        counts = np.zeros(1 << COUNT_BITS, np.int32)
        counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
        shared = texts.sparkSession.sparkContext.broadcast(counts)
        rows = cut_lineage(texts.mapInArrow(_prefix_rows(shared, least), ", ".join(["key bigint, id bigint, part bigint, size int, place int, short boolean", *[f"{c} bigint" for c in PARITY]])))
    pairs, written = _cross_pairs(rows, least)
    return pairs, [rows, *written]


def _groups(reports: DataFrame, id_col: str, report: str, least: float, exact: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, links): rows have id, version and the words' digest; texts have the digest, the number of
    the text, its first (id, version), its group and its number of links; links are between numbers of texts.
    """
    source = reports.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{report}`").alias("report"), F.xxhash64(f"`{report}`").alias("version")
    )
    id_type = source.schema["id"].dataType.simpleString()
    rows = cut_lineage(source.mapInArrow(_sketch_rows, f"id {id_type}, version bigint, n_words bigint, d1 bigint, d2 bigint, bands array<bigint>"))
    digest = ["n_words", "d1", "d2"]
    # equal words: one text, with a number; a row's own bands equal those of its text
    some = rows.where("n_words > 0")
    reps = some.groupBy(*digest).agg(F.min(F.struct("id", "version")).alias("first"))
    reps = cut_lineage(reps.select(*digest, F.monotonically_increasing_id().alias("node"), "first.id", "first.version"))
    bands = some.join(reps, [*digest, "id", "version"]).groupBy("node").agg(F.first("bands").alias("bands"))
    single = F.transform("bands", lambda x, i: F.xxhash64(F.lit(1), i, x))
    double = F.transform("bands", lambda x, i: F.xxhash64(F.lit(2), i, x, F.get("bands", (i + 1) % SKETCHES)))
    met = _members(bands.select(F.col("node").alias("id"), F.explode(F.concat(single, double)).alias("key")))
    pairs = cut_lineage(_stars(met))
    # every text of a later round is a member of a first bucket, and every member meets a centre
    ends = met.groupBy(F.col("id").alias("node")).agg(F.count("*").alias("_n"))
    ends = cut_lineage(reps.join(ends, "node", "left_semi").select("node", "id", "version"))
    wanted = reports.sparkSession.sparkContext.broadcast(members(ends.select(F.xxhash64("id", "version").alias("hash")), "hash"))
    found = source.withColumn("hash", F.xxhash64("id", "version")).mapInArrow(_sequence_rows(wanted), f"id {id_type}, version bigint, seq binary")
    found = found.groupBy("id", "version").agg(F.min("seq").alias("seq"))
    sequences = cut_lineage(found.join(ends, ["id", "version"]).select("node", "seq"))
    done = [met, pairs, ends, sequences]  # tables nobody reads once the texts have their groups
    left = sequences.select(F.col("node").alias("a"), F.col("seq").alias("seq_a"))
    right = sequences.select(F.col("node").alias("b"), F.col("seq").alias("seq_b"))

    def verified(pairs: DataFrame, finer: bool) -> DataFrame:
        centres = ["centre_a", "centre_b"] if finer else [F.lit(False).alias("centre_a"), F.lit(False).alias("centre_b")]
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "seq_a", "seq_b", *centres)
        with byte_batches(reports.sparkSession, BATCH_BYTES):
            return cut_lineage(both.mapInArrow(_verifier(least), "a bigint, b bigint, similarity double, rest_a array<bigint>, rest_b array<bigint>"))

    def merged(groups: DataFrame, more: DataFrame) -> DataFrame:
        """The groups after further links: components of the groups, which are few, in place of all texts."""
        ends = more.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("_n")).select("id", F.col("id").alias("part"))
        known = groups.unionByName(ends.join(groups, "id", "left_anti"))
        joined = more
        for end in ("a", "b"):
            joined = joined.join(known.select(F.col("id").alias(end), F.col("part").alias(f"part_{end}")), end)
        roots = components(joined.select("part_a", "part_b").where("part_a <> part_b"))
        known = known.join(roots.withColumnRenamed("node", "part"), "part", "left")
        return cut_lineage(known.select("id", F.coalesce("component", "part").alias("part")))

    judged = verified(pairs, not exact)
    links = cut_lineage(judged.where(F.col("similarity") >= least).select("a", "b", "similarity"))
    groups = cut_lineage(components(links.select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("part")))
    done += [judged, groups]
    if exact:
        finer, written = _apart_pairs(met, reps, sequences, groups, pairs.select("a", "b"), least)
        rounds = [finer]
        done += written
    else:
        rounds = range(1, REFINEMENTS + 1)
    tried = pairs.select("a", "b")
    for finer in rounds:
        if not exact:
            apart = _parts(judged.where(F.col("similarity") < least), groups)
            members_of = _members(_finer_keys(apart, finer))
            finer = cut_lineage(_parts(_stars(members_of), groups).join(tried, ["a", "b"], "left_anti"))
            done.append(members_of)
        judged = verified(finer, not exact)
        done += [finer, judged]
        more = judged.where(F.col("similarity") >= least).select("a", "b", "similarity")
        tried = tried.unionByName(finer.select("a", "b"))
        if not more.isEmpty():
            done.append(links)
            links = cut_lineage(links.unionByName(more))
            groups = merged(groups, more)
            done.append(groups)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    texts = (
        reps.join(groups.select(F.col("id").alias("node"), "part"), "node", "left")
        .join(degree, "node", "left")
        .select(*digest, "node", "id", "version", F.coalesce("part", "node").alias("part"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    texts = cut_lineage(texts)
    for table in [*done, reps]:
        drop_written(table)
    return rows, texts, links


def _apart_pairs(met: DataFrame, reps: DataFrame, sequences: DataFrame, groups: DataFrame, tried: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs not yet tried between texts of different groups that may be links, of all texts that share a bucket with another group; and the tables written."""
    size = F.greatest(F.col("n_words") - (SHINGLE - 1), F.lit(1)).cast("int").alias("size")
    # two members have met, and three if the centres are two
    open_ = met.where((F.col("n") > 3) | ((F.col("n") == 3) & (F.col("low") == F.col("drawn"))))
    placed = open_.select("key", "id", "n").join(groups, "id", "left").withColumn("part", F.coalesce("part", "id"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    placed = cut_lineage(placed.join(mixed, "key", "left_semi"))
    few = placed.where(F.col("n") <= WHOLE).join(reps.select(F.col("node").alias("id"), size), "id")
    few = few.select("key", "id", "part", "size", F.lit(None).cast("int").alias("place"), F.lit(True).alias("short"), *[F.lit(None).cast("bigint").alias(c) for c in PARITY])
    hot = placed.where(F.col("n") > WHOLE).groupBy("id").agg(F.min("part").alias("part"))
    hot = cut_lineage(sequences.withColumnRenamed("node", "id").join(hot, "id").select("id", "seq", "part"))
    met_few, some = _cross_pairs(few, least)
    met_hot, others = _rare_pairs(hot, least)
    both = met_few.unionByName(met_hot).groupBy("a", "b").agg(F.count("*").alias("_n")).drop("_n")
    return cut_lineage(both.join(tried, ["a", "b"], "left_anti")), [placed, hot, met_few, met_hot, *some, *others]


def near_duplicates(reports: DataFrame, id_col: str = "user_id", report: str = "report", least: float = 0.8, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(classes, links).

    ``classes``: one row per input row with id, text_id (smallest id of the reports with the same words), class_id
    (smallest id of its group of near duplicates) and n_links (verified links of its text).
    ``links``: a, b, similarity, between different texts, each named by the smallest id of its text, a <= b.

    Reports with equal words are one text. A text has ``SKETCHES`` Order MinHash sketches: each picks the
    ``PICKS`` smallest occurrence-labelled shingles and keeps them in text order. Texts that
    share a sketch, or two neighbouring sketches, meet the centres of that bucket, and a pair is a link
    if its aligned similarity reaches ``least``. Then all members of a bucket that are still in different groups meet, by their rarest
    shingles in buckets of more than ``WHOLE``, so that no similar pair that shares a bucket stays apart; the pairs can grow with the square of a bucket
    of texts that share rare shingles and are no links. Groups are the connected components of the links.
    ``links`` are the ones that were verified on this way: they hold a group together and are not all similar pairs within it.
    Without ``exact`` the pairs stay linear and some are lost: a member that a centre did not take is
    sketched anew by the shingles that the centre lacks, and meets the centres of these finer buckets, ``REFINEMENTS`` times.

    Defined results: a report without words (null, empty) links to nothing; rows with a null id are left
    out; rows that repeat an id count once per row in ``classes``, each under the group of its own
    words; fewer than five words match equal words only; very long reports are aligned within the band, at a cost of
    length times band. Extra columns are ignored.
    """
    rows, texts, links = _groups(reports, id_col, report, least, exact)
    least_id = texts.groupBy("part").agg(F.min("id").alias("class_id"))
    named = texts.join(least_id, "part").select("n_words", "d1", "d2", F.col("id").alias("text_id"), "class_id", "n_links")
    classes = rows.select("id", "n_words", "d1", "d2").join(cut_lineage(named), ["n_words", "d1", "d2"], "left")
    names = texts.select("node", F.col("id").alias("text_id"))
    ends = links.join(names.select(F.col("node").alias("a"), F.col("text_id").alias("x")), "a").join(names.select(F.col("node").alias("b"), F.col("text_id").alias("y")), "b")
    return (
        classes.select(
            "id", F.coalesce("text_id", "id").alias("text_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        ),
        ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity"),
    )


def keep_one_each(reports: DataFrame, id_col: str = "user_id", report: str = "report", least: float = 0.8) -> DataFrame:
    """One report of each group of near duplicates stays: the one with the smallest id; columns unchanged.

    Defined results: reports with a null id and reports without words stay, but of rows equal in id and text one stays;
    rows that repeat an id with other words are other reports, judged by their own group; an empty table stays empty; very long
    reports as in ``near_duplicates``; extra columns are carried.
    """
    rows, texts, _ = _groups(reports, id_col, report, least, True)
    roots = texts.groupBy("part").agg(F.min(F.struct("id", "version")).alias("first")).select("first.id", "first.version")
    wordless = rows.where("n_words = 0").select("id", "version")
    kept = roots.unionByName(wordless).groupBy("id", "version").agg(F.count("*").alias("_n")).drop("_n")
    df = reports.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{report}`").alias("version"))
    # copies of a row that are equal in id and text: the one with the smallest hash of all columns
    chosen = df.join(kept, ["id", "version"], "left_semi").groupBy("id", "version").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return df.where("id IS NULL").select("row").unionByName(chosen.select("row")).select("row.*")
