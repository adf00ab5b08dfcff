"""Nothing is left out where an operator once kept a bounded part of its groups or table."""

import random

import numpy as np
import pytest
from brute import kneser_ney, lower, near_classes

from ledgerlens.llm import order_minhash, perplexity


@pytest.mark.parametrize("part_rows", [None, 3000])
def test_every_ngram_counts(spark, sf_dir, monkeypatch, part_rows):
    if part_rows:
        monkeypatch.setattr(perplexity, "PART_ROWS", part_rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 80").selectExpr("doc_id AS user_id", "text AS report", "lang")
    got = {r["user_id"]: r["log_perplexity"] for r in perplexity.quality(docs).collect()}
    rows = docs.collect()
    seen = 0
    for language in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == language]
        log_p, _ = kneser_ney([r["report"] for r in own], perplexity.ORDER)
        known = {}
        for r in own:
            words = lower(r["report"]).split()
            if not words:
                continue
            text = (" " * (perplexity.ORDER - 1) + " ".join(words) + " ").encode()
            grams = [text[i : i + perplexity.ORDER] for i in range(len(text) - perplexity.ORDER + 1)]
            want = -np.mean([known[g] if g in known else known.setdefault(g, log_p(g)) for g in grams])
            assert abs(got[r["user_id"]] - want) < 2e-9
            seen += 1
    assert seen > 70


@pytest.mark.parametrize("whole", [64, 10_000])
def test_pairs_inside_a_hot_template(spark, monkeypatch, whole):
    """300 texts of one template, mutually just below 0.8, with a partner just above it for every third."""
    monkeypatch.setattr(order_minhash, "WHOLE", whole)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]

    def changed(words, spots, mark):
        out = list(words)
        for at in spots:
            out[at] = f"{mark}{at}"
        return out

    rows = []
    for i in range(300):
        text = changed(base, rng.sample(range(0, 300, 5), 7), f"u{i}_")
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(changed(text, rng.sample(range(2, 300, 5), 4), f"v{i}_"))))
    want = near_classes(rows)
    planted = [i for i in range(0, 300, 3) if want[1000 + i] == want[i] == i]
    assert len(planted) > 90 and len(set(want.values())) > 250
    df = spark.createDataFrame(rows, "user_id bigint, report string")
    got = {r["id"]: r["class_id"] for r in order_minhash.near_duplicates(df, exact=True)[0].collect()}
    assert got == want
    if whole == 64:  # the linear rounds alone: nothing joined that is apart, nine tenths of the partners found
        got = {r["id"]: r["class_id"] for r in order_minhash.near_duplicates(df)[0].collect()}
        assert all(want[got[i]] == want[i] for i in want)
        assert sum(got[1000 + i] == got[i] for i in planted) >= 0.9 * len(planted)


def test_default_does_not_rest_on_rounds(spark, monkeypatch):
    """The query's and the stage's way gives the classes of brute force without any finer bucket."""
    monkeypatch.setattr(order_minhash, "REFINEMENTS", 0)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]

    def changed(words, spots, mark):
        out = list(words)
        for at in spots:
            out[at] = f"{mark}{at}"
        return out

    rows = []
    for i in range(150):
        text = changed(base, rng.sample(range(0, 300, 5), 8), f"u{i}_")
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(changed(text, rng.sample(range(2, 300, 5), 6), f"v{i}_"))))
    want = near_classes(rows)
    assert len({i for i in range(0, 150, 3) if want[1000 + i] == want[i]}) > 40
    df = spark.createDataFrame(rows, "user_id bigint, report string")
    got = {r["id"]: r["class_id"] for r in order_minhash.near_duplicates(df)[0].collect()}
    assert got == want
    assert sorted(r["user_id"] for r in order_minhash.keep_one_each(df).collect()) == sorted(set(want.values()))


def test_far_texts_of_a_template_are_no_pairs(spark):
    """Texts of one template that share their rarest shingles and differ behind them: only the pairs that can be links are read, and none of those is lost."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(80):
        out = list(base)
        for at in rng.sample(range(0, 300, 5), 20):  # one of two words, so no shingle is rare
            out[at] = f"v{at}"
        rows.append((2 * i, out))
        rows.append((2 * i + 1, [w if j != 7 else "x" for j, w in enumerate(out)]))
    labelled = {}
    for i, words in rows:
        buf = np.frombuffer(" ".join(words).encode(), np.uint8)
        (_, shingles), = order_minhash._shingles(buf, np.array([0, len(buf)]))
        labelled[i] = shingles.astype(np.uint64)
    texts = spark.createDataFrame([(i, s.tobytes(), i) for i, s in labelled.items()], "id bigint, seq binary, part bigint")
    got = {(r["a"], r["b"]) for r in order_minhash._rare_pairs(texts, 0.8)[0].collect()}
    links = {(a, b) for a in labelled for b in labelled if a < b and order_minhash.aligned_similarity(labelled[a], labelled[b]) >= 0.8}
    assert len(links) >= 80 and links <= got
    assert len(got) <= 2 * len(links)
