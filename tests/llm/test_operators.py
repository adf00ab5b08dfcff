"""Every corpus operator against a plain version, and on null, empty, long, repeated and clashing rows."""

import base64
import hashlib
import random

import numpy as np
import pytest
from brute import ALNUM, contamination, kept_lines, kneser_ney, lower, near_classes, removed_bytes, rules

from ledgerlens.llm import decontaminate, langid, licenses, lines, mixing, order_minhash, perplexity, phrases, urls, warc
from ledgerlens.llm.components import components

ODD = [None, "", " \n\t\n", "one", "a b c d", "#*$%&|<> 12 !", "é ç ü\nñ", "X" * 300, "aaaa " * 80]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    out = [(r[0], r[1], r[2]) for r in rows]
    n = max(r[0] for r in out)
    out += [(n + 1 + i, t, "en" if i % 2 else None) for i, t in enumerate(ODD)]
    long = " ".join(t for _, t, _ in out[:60] if t)
    out.append((n + 100, long * 3, "en"))
    return sorted(out)


@pytest.fixture(scope="module")
def reports(spark, docs):
    # extra columns with names that the operators use for their own
    rows = [(*r, "extra", 7, 1.5) for r in docs]
    schema = "user_id bigint, report string, lang string, row string, id int, score double"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def empty(df):
    return df.where("user_id < -1")


def test_contamination(spark, sf_dir, docs, reports):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [(900, None), (901, ""), (902, "one"), (903, "a b c d")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {r[0]: r[1:] for r in contamination([(d, t) for d, t, _ in docs], items)}
    for parts in (500_000, 700):
        out = decontaminate.contamination(reports, bench, most_windows=parts).collect()
        assert len(out) == len(docs) and out[0]["row"] == "extra" and out[0]["id"] == 7
        for r in out:
            ids = hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
            assert (r["n_words"], r["n_hit"], len(r["items"]), ids, r["contaminated"]) == want[r["user_id"]]
    kept = decontaminate.decontaminate(reports, bench)
    assert kept.columns == reports.columns and kept.count() == sum(not w[-1] for w in want.values())
    assert decontaminate.decontaminate(reports, bench.where("item_id < 0")).count() == len(docs)
    assert decontaminate.decontaminate(empty(reports), bench).count() == 0


def test_repeated_lines(spark, docs, reports):
    out = {r["user_id"]: r for r in lines.drop_repeated_lines(reports).collect()}
    for (d, t, _), (text, spans) in zip(docs, kept_lines([(d, t) for d, t, _ in docs])):
        assert out[d]["report"] == text and [tuple(s) for s in out[d]["removed_spans"]] == spans
        assert [t[a:b] for a, b in spans] == [t[s["first"] : s["last"]] for s in out[d]["removed_spans"]]
    assert lines.drop_repeated_lines(empty(reports)).count() == 0
    # equal rows are one report; a null id is the earliest
    words = [f"w{i}" for i in range(30)]
    text, other = " ".join(words), "  ".join(words).upper()
    rows = [(None, f"{text}\nx"), (1, f"{other}\ny"), (1, f"{other}\ny"), (2, f"q\n{text}"), (3, " ".join(words[:20])), (4, None), (5, "")]
    twice = spark.createDataFrame(rows, "user_id bigint, report string")
    got = sorted((r["user_id"] or 0, r["report"] or "") for r in lines.drop_repeated_lines(twice).collect())
    assert got == [(0, f"{text}\nx"), (1, "\ny"), (1, "\ny"), (2, "q\n"), (3, " ".join(words[:20])), (4, ""), (5, "")]
    # one other word inside a long line costs its own unit, not the passage
    long = [f"v{i}" for i in range(200)]
    near = [*(f"u{i}" for i in range(40)), *long[:100], "other", *long[101:], *(f"t{i}" for i in range(40))]
    pair = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(near))], "user_id bigint, report string")
    first, second = sorted((r["user_id"], r["report"]) for r in lines.drop_repeated_lines(pair).collect())
    assert first[1] == " ".join(long) and len(second[1].split()) < 81 + 4 * 8 * 3 and "other" in second[1]


def test_repeated_strings(spark, docs, reports):
    out = {r["user_id"]: r for r in phrases.drop_repeated_strings(reports).collect()}
    for (d, t, _), gone in zip(docs, removed_bytes([(d, t) for d, t, _ in docs])):
        b = (t or "").encode()
        assert bytes(out[d]["kept"]) == bytes(c for c, g in zip(b, gone) if not g)
        mask = np.zeros(len(b), bool)
        for s in out[d]["spans"]:
            mask[s["first"] : s["last"]] = True
        assert mask.tolist() == gone
    assert phrases.drop_repeated_strings(empty(reports)).count() == 0
    same = "".join(random.Random(3).choices("abcdefgh ", k=400))
    rows = spark.createDataFrame([("b", same), ("b", same), ("a", same[50:260]), (None, same[:120])], "user_id string, report string")
    got = sorted(((r["user_id"] or "", len(r["kept"])) for r in phrases.drop_repeated_strings(rows).collect()))
    # the null id has bytes 0..120, "a" then loses nothing (70 bytes in common), "b" loses 0..260
    assert got == [("", 120), ("a", 210), ("b", 140), ("b", 140)]


def test_phrases_of_a_long_text_are_cut_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 101, 5000).astype(np.uint8)
    buf[3000:3600] = buf[500:1100]
    from ledgerlens.llm.textbytes import SegmentHash

    monkeypatch.setattr(phrases, "BLOCK", 333)
    seen = np.zeros(5000, int)
    for text, start, count, _, _ in phrases.cut_phrases(SegmentHash(buf), np.array([0, 2000, 2000, 5000]), 100):
        for s, n in zip(start, count):
            seen[s : s + n] += 1
    assert seen[:1901].tolist() == [1] * 1901 and not seen[1901:2000].any() and seen[2000:4901].tolist() == [1] * 2901


def test_near_duplicates(spark, docs, reports):
    classes, links = order_minhash.near_duplicates(reports)
    got = {r["id"]: r["class_id"] for r in classes.collect()}
    assert got == near_classes([(d, t) for d, t, _ in docs])
    assert all(r["a"] < r["b"] and r["similarity"] >= 0.8 for r in links.collect())
    kept = order_minhash.keep_one_each(reports)
    assert kept.columns == reports.columns
    assert sorted(r["user_id"] for r in kept.collect()) == sorted(set(got.values()))
    assert order_minhash.near_duplicates(empty(reports))[0].count() == 0
    odd = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (3, "A, b!"), (5, None), (6, "")], "user_id bigint, report string")
    assert sorted((r["id"], r["class_id"]) for r in order_minhash.near_duplicates(odd)[0].collect()) == [(3, 3), (4, 3), (4, 3), (5, 5), (6, 6)]
    assert sorted((r["user_id"] or 0) for r in order_minhash.keep_one_each(odd).collect()) == [0, 3, 5, 6]
    # an id with two unlike texts: each is judged by its own words
    x, y = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    twice = spark.createDataFrame([(1, x), (1, y), (2, y + " z"), (3, x), (1, x)], "user_id bigint, report string")
    assert sorted((r["user_id"], r["report"]) for r in order_minhash.keep_one_each(twice).collect()) == [(1, x), (1, y)]


def test_near_copies_of_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(300)] = f"v{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    for i in range(400, 500):  # share a passage only
        rows.append((i, " ".join(base[:60] + [f"u{i}_{k}" for k in range(60)])))
    df = spark.createDataFrame(rows, "user_id bigint, report string")
    got = {r["id"]: r["class_id"] for r in order_minhash.near_duplicates(df)[0].collect()}
    assert {got[i] for i in range(400)} == {0} and all(got[i] == i for i in range(400, 500))


def test_aligned_similarity():
    a = np.arange(1, 101, dtype=np.uint64)
    assert order_minhash.aligned_similarity(a, a) == 1
    b = a.copy()
    b[50:55] = 999
    assert order_minhash.aligned_similarity(a, b) == 95 / 105
    swapped = np.concatenate([a[50:], a[:50]])  # the same set in another order
    assert order_minhash.aligned_similarity(a, swapped) < 0.8
    rng = np.random.default_rng(4)
    for size in (1, 7, 60, 400):  # the banded rows against the plain table
        for _ in range(20):
            x = rng.integers(0, max(2, size // 3), size).astype(np.uint64)
            y = np.delete(x, rng.integers(0, size, size // 12))
            y[rng.integers(0, len(y), len(y) // 15)] = 10**6
            n, m, band = len(x), len(y), int((len(x) + len(y)) * 0.2 / 1.8) + 1
            best = np.zeros((n + 1, m + 1), int)
            for i in range(n):
                for j in range(m):
                    best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + 1 if x[i] == y[j] and abs(i - j) <= band else 0)
            k = best[n, m]
            plain = k / (n + m - k) if min(n, m) >= 0.8 * max(n, m) else 0.0
            got = order_minhash.aligned_similarity(x, y)
            assert got == plain or max(got, plain) < 0.8
    assert order_minhash.aligned_similarity(a, a[:70]) == 0 and order_minhash.aligned_similarity(a, a[:0]) == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(30)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r[0]: r[1] for r in components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_language(spark, sf_dir, docs, reports):
    known = reports.where("user_id % 4 <> 2")
    model = langid.train_language_model(known)
    assert set(model.languages) == {"de", "en", "es", "fr"}
    out = {r["user_id"]: r for r in langid.identify_language(reports, model).collect()}
    held = [(d, lang) for d, t, lang in docs if d % 4 == 2 and d < 200]
    assert sum(out[d]["lang_pred"] == lang for d, lang in held) >= 0.95 * len(held)
    for d, t, _ in docs:
        if not t or not any(c.isalpha() for c in t):
            assert (out[d]["lang_pred"], out[d]["score"], out[d]["rejected"]) == ("und", 0.0, True)
        else:
            assert out[d]["lang_pred"] in model.languages and 0 <= out[d]["score"] <= 1
    assert sum(out[d]["rejected"] for d, t, _ in docs if d < 200) <= 2
    assert langid.train_language_model(empty(reports)) is None
    assert langid.keep_identified(reports, None).count() == len(docs)
    many = spark.createDataFrame([(i, f"word {i}", f"l{i % 300}") for i in range(900)], "user_id bigint, report string, lang string")
    sample = langid.labelled_sample(many, "report", "lang", "user_id", 2)
    assert {x for _, x in sample} == {f"l{i}" for i in range(300)}
    with pytest.raises(ValueError):
        langid.labelled_sample(many, "report", "lang", "user_id", 2, most_languages=299)
    none = langid.identify_language(reports, None).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and len(none) == len(docs)
    assert langid.identify_language(empty(reports), model).count() == 0


def test_quality_rules(docs, reports):
    out = {r["user_id"]: r for r in perplexity.quality(reports).collect()}
    assert len(out) == len(docs)
    for d, t, _ in docs:
        want = rules(t)
        assert tuple(out[d][c] for c in perplexity.RULES) == want
        assert out[d]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (out[d]["base_failed"] and out[d]["kept"])
    assert sum(not r["kept"] and not r["base_failed"] for r in out.values()) <= 0.1 * len(docs)
    assert perplexity.quality(empty(reports)).count() == 0


def test_kneser_ney(spark, docs, reports):
    few = reports.where("user_id < 12").withColumn("lang", reports.user_id.cast("string").substr(1, 0))  # one language named ''
    model = perplexity.hash_arrays(perplexity.kneser_ney(perplexity.count_ngrams(few)))
    log_p, texts = kneser_ney([t for d, t, _ in docs if d < 12], perplexity.ORDER)
    rng = random.Random(1)
    grams = [b[i : i + 5] for b in texts for i in rng.sample(range(len(b) - 5), 30)] + [b"zzzzz", b"the q", b"q the", b"     "]
    packed = np.array([int.from_bytes(g, "big") for g in grams], np.uint64)
    got = perplexity.log_probabilities(model, "", packed)
    want = np.array([log_p(g) for g in grams])
    assert (np.abs(got - want) < 1e-4).mean() > 0.99  # an n-gram may lose its slot to another
    # the model is a distribution over the next byte
    for context in (b"the ", b"zzzz", b" and"):
        grams = np.array([int.from_bytes(context + bytes([c]), "big") for c in range(256)], np.uint64)
        assert abs(np.exp(perplexity.log_probabilities(model, "", grams)).sum() - 1) < 0.02


def test_licenses(spark, docs):
    more = [
        (9001, "X. Released under the MIT License. mit  LICENSE"), (9002, "Licensed under CC BY-NC 4.0."), (9003, "cc by nothing"),
        (9004, "This work is licensed under the GNU General Public License, version 3."), (9005, "license mit"), (9006, "mit\u212a license"), (9007, "M\u0130T LICENSE"),
        (None, "Licensed under the Apache License, Version 2.0."), (9004, "x"),
    ]
    rows = [(d, t) for d, t, _ in docs] + more
    files = spark.createDataFrame([(*r, 1) for r in rows], "file_id bigint, content string, words int")
    out = licenses.scan_licenses(files).collect()
    assert len(out) == len(rows)
    got = {(r["file_id"], r["content"]): r for r in out}
    for d, t in rows:
        w, places, found = ALNUM.findall(lower(t)), [], set()
        for phrase, label in licenses.BASE_PHRASES:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            found |= {label} if at else set()
        r = got[d, t]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted(found)))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert found <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[9002, more[1][1]]["labels"] == "cc-by-nc" and got[9003, more[2][1]]["labels"] == "" and got[9001, more[0][1]]["labels"] == "mit"
    score = {(r["file_id"], r["content"]): r["score"] for r in licenses.scan_licenses(files.repartition(7)).collect()}
    assert score == {k: r["score"] for k, r in got.items()}
    assert licenses.scan_licenses(files.where("file_id < -5")).count() == 0


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    return lower(rest[:end]), path


def test_urls(spark, sf_dir):
    pages = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    odd = [
        None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "http://net/en/", "http://evilnet/x", "http://example.net/en/1?x://y", "x://m.example.com/de/#a",
        "x://a.org/fr", "x://a.org/fr/", "http://casino.poker.com/bets", "http://caf\u00c9.Org/fr/a\nb", "a://b://c/d", "http://a.net?/en/",
    ]
    rows = pages + [(1000 + i, u, None) for i, u in enumerate(odd)] + [(1000, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, host string")
    out = urls.filter_urls(df).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path = host_path(r["url"])
        assert (r["host"], r["path"]) == (host, path)
        fits = [(f"{h}{p}", v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert r["rule"] == best[0] and (best[1] is None or r["verdict"] == best[1])
        assert r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1
    by_url = {r["url"]: r for r in out}
    assert by_url["http://casino.poker.com/bets"]["verdict"] == "block"
    assert urls.filter_urls(df.where("page_id < 0")).count() == 0


def test_name_split(spark):
    counts = spark.createDataFrame([("free", 50), ("bets", 20), ("fre", 1), ("ebets", 1), ("e", 3)], "word string, n bigint")
    names = spark.createDataFrame([("freebets",), ("betsfree",), ("qx",)], "name string")
    got = {r[0]: r[1] for r in urls.segment_names(names, counts).collect()}
    assert got["freebets"] == ["free", "bets"] and got["betsfree"] == ["bets", "free"] and "".join(got["qx"]) == "qx"


def test_warc(spark):
    html = "<html lang='x'><html lang=\"en\"><title> A\n b </title><script>no</script><!-- no --><body><p>One &amp;lt; <b>two</b></p><a href=\"/l\">L</a><br>end"
    http = "HTTP/1.1 404 Not Found\r\nContent-Type: Text/HTML; charset=utf-8\r\nX-A: 1\r\n\r\n"
    rows = [
        (1, "<urn:uuid:1>", "http://a/", "2020-01-01T00:00:00Z", http + html), (2, "<urn:uuid:2>", None, None, "HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n..."),
        (3, None, "u", "d", None), (4, "<urn:uuid:4>", "u", "d", "HTTP/1.0 200 OK\r\ncontent-type: text/plain\r\n\r\nplain <b>\r\n\r\nx"), (5, "5", "u", "d", "only a head"),
    ]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id bigint, warc_record_id string, warc_target_uri string, warc_date string, block string, content string")
    out = warc.derive_records(df).collect()
    by = {(r["page_id"], r["record_type"]): r for r in out}
    assert set(by) == {(1, "metadata"), (1, "conversion"), (2, "metadata"), (3, "metadata"), (4, "metadata"), (4, "conversion"), (5, "metadata")}
    text = by[1, "conversion"]
    assert text["content"] == "A b\nOne &lt; two\nL\nend" and text["refers_to"] == "<urn:uuid:1>"
    meta = by[1, "metadata"]
    assert "http-status: 404\r\nhttp-header: Content-Type: Text/HTML; charset=utf-8\r\nhttp-header: X-A: 1\r\ntitle: A b\r\nlanguage: en\r\noutlink: /l\r\n" in meta["content"]
    assert f"WARC-Concurrent-To: {text['record_id']}\r\n" in meta["record"] and f"WARC-Concurrent-To: {meta['record_id']}\r\n" in text["record"]
    assert by[4, "conversion"]["content"] == "plain <b>\r\n\r\nx" and "WARC-Target-URI" not in by[2, "metadata"]["record"]
    for r in out:
        sha = "sha1:" + base64.b32encode(hashlib.sha1(r["content"].encode()).digest()).decode()
        assert r["block_digest"] == sha and r["content_length"] == len(r["content"].encode())
        head, body = r["record"].split("\r\n\r\n", 1)
        assert body == r["content"] + "\r\n\r\n" and f"WARC-Block-Digest: {sha}" in head and f"Content-Length: {r['content_length']}" in head
    payload = ("sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode())
    assert meta["source_digest"] == payload
    assert warc.derive_records(df.where("page_id < 0")).count() == 0


def test_mixture(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        side, level = ("train", "high") if i < 200 else (rng.choice(["train", "predict"]), rng.choice(["low", "high", None]))
        rows.append((i, "t " * rng.randrange(0, 40), side, level, rng.randrange(3), "x"))
    rows += [(900, None, "train", "low", 1, "x"), (900, "", "train", "low", 1, "x"), (901, "a b", None, None, None, "x"), (902, "a " * 30, "predict", "low", 0, "x"), (902, "a " * 30, "predict", "low", 0, "x")]
    df = spark.createDataFrame(rows, "user_id bigint, report string, data_source string, risk_level string, career int, leaf string")
    weights = spark.createDataFrame(
        [(["train"], 3.0), (["predict"], 1.0), (["train", "high"], 5.0), (["train", "low"], 1.0), (["predict", "low"], 0.0), (["train", "high", "2"], -1.0)], "path array<string>, weight double"
    )
    size = lambda t: len((t or "").split())
    for budget in (50, 3000, 20000, 10**6):
        out = mixing.mix_to_weights(df, weights, budget, epochs=2).collect()
        leaves = {}
        for r in rows:
            key = (r[2] or "", r[3] or "", "" if r[4] is None else str(r[4]))
            leaves[key] = leaves.get(key, 0) + size(r[1])
        given = shares({k: 2 * v for k, v in leaves.items() if v}, {tuple(r[0]): r[1] for r in weights.collect()}, budget)
        taken = {}
        for r in out:
            key = (r["data_source"] or "", r["risk_level"] or "", "" if r["career"] is None else str(r["career"]))
            n = size(r["report"])
            assert r["taken_tokens"] == r["copies"] * n + r["part_tokens"] and 0 <= r["part_tokens"] < n and r["copies"] <= 2 and r["leaf"] == "x"
            taken[key] = taken.get(key, 0) + r["taken_tokens"]
        assert taken == {k: int(v + 1e-6) for k, v in given.items() if int(v + 1e-6)}
    first = {(r["user_id"], r["taken_tokens"]) for r in mixing.mix_to_weights(df, weights, 3000).collect()}
    assert first == {(r["user_id"], r["taken_tokens"]) for r in mixing.mix_to_weights(df.repartition(7), weights, 3000).collect()}
    assert first != {(r["user_id"], r["taken_tokens"]) for r in mixing.mix_to_weights(df, weights, 3000, seed=2).collect()}
    assert mixing.mix_to_weights(df.where("user_id < 0"), weights, 100).count() == 0
    assert mixing.mix_to_weights(df, weights.limit(0), 0).count() == 0


def shares(capacity, weights, budget):
    """Budgets of the leaves by filling one node after the other."""
    w = lambda path: max(weights.get(path, 1.0), 0.0)
    live = {k: v for k, v in capacity.items() if all(w(k[: d + 1]) > 0 for d in range(len(k)))}

    def fill(path, amount):
        depth = len(path)
        children = {}
        for k, v in live.items():
            if k[:depth] == path:
                children[k[: depth + 1]] = children.get(k[: depth + 1], 0) + v
        got, left, open_ = {}, float(amount), dict(children)
        while open_:
            rate = left / sum(w(c) for c in open_)
            full = [c for c in open_ if open_[c] <= w(c) * rate]
            if not full:
                got |= {c: w(c) * rate for c in open_}
                break
            for c in full:
                got[c] = float(open_.pop(c))
                left -= got[c]
        if depth + 1 == 3:
            return got
        return {k: v for c, a in got.items() for k, v in fill(c, a).items()}

    return fill((), budget)
