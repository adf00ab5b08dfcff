"""Every stage of the pipeline on its own input, against plain versions; and the registered queries."""

import pytest
from brute import SPACED, contamination, kept_lines, near_classes

import corpus_pipeline
from ledgerlens.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, spark.createDataFrame(out[-1], docs.schema), sf_dir)
        out.append(docs.collect())
    return out


def rows(step):
    return sorted((r["doc_id"], r["text"]) for r in step)


def test_stages(steps, spark, sf_dir):
    start, language, near, lines, clean, mixed = steps
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_lines", "test_passages", "mixture"]
    gone = {r["doc_id"] for r in start} - {r["doc_id"] for r in language}
    assert all(r["doc_id"] not in gone or len(r["text"] or "") < 40 for r in start) and len(gone) <= 0.02 * len(start)
    classes = near_classes(rows(language))
    assert rows(near) == [(d, t) for d, t in rows(language) if classes[d] == d]
    want = [(d, text) for (d, _), (text, _) in zip(rows(near), kept_lines(rows(near)))]
    assert rows(lines) == want and all(r["n_chars"] == len(r["text"]) for r in lines)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {c[0] for c in contamination(rows(lines), items) if c[-1]}
    assert rows(clean) == [(d, t) for d, t in rows(lines) if d not in bad]
    for a, b in zip(steps, steps[1:-1]):
        assert a[0].__fields__ == b[0].__fields__
    total = sum(len(SPACED.findall(r["text"] or "")) for r in clean)
    taken = sum(r["taken_tokens"] for r in mixed)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean} and total // 2 - 100 <= taken <= total // 2


def test_run_is_the_stages(spark, sf_dir, steps):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["taken_tokens"]) for r in got) == sorted((r["doc_id"], r["taken_tokens"]) for r in steps[-1])


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
