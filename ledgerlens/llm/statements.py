"""SQL statements of the operators that SQL can express, over the given tables."""

from __future__ import annotations

from . import licenses, urls, warc

STRINGS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, octet_length(encode(COALESCE(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
mark AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 AS gap FROM dup),
island AS (SELECT doc_id, i, count(*) FILTER (gap) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM island GROUP BY doc_id, g),
piece AS (SELECT doc_id, a, b, COALESCE(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _digest(value: str) -> str:
    groups = f"list_transform(range(0, 8), lambda g: ('0x' || substr(sha1({value}), (5 * g + 1)::INT, 5))::BIGINT)"
    letters = f"list_transform(list_transform([15, 10, 5, 0], lambda k: (x >> k) & 31), lambda v: substr('{warc.BASE32}', (v + 1)::INT, 1))"
    return f"('sha1:' || array_to_string(list_transform({groups}, lambda x: array_to_string({letters}, '')), ''))"


def _uuid(*parts: str) -> str:
    h = "md5(concat_ws(chr(10), " + ", ".join(f"COALESCE({p}, '')" for p in parts) + "))"
    cut = ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"('<urn:uuid:' || concat_ws('-', {cut}) || '>')"


def _line(name: str, value: str) -> str:
    return f"COALESCE('{name}: ' || {value} || chr(13) || chr(10), '')"


def warc_statement() -> str:
    crlf = "chr(13) || chr(10)"
    blanks = r"'[\x09-\x0D\x20]+'"
    text = "html"
    for pattern, to in ((r"(?s)<!--.*?-->", "''"), (r"(?is)<script\b.*?</script>", "''"), (r"(?is)<style\b.*?</style>", "''"), (r"[\x09-\x0D\x20]+", "' '"), (warc.LINE_TAGS, "chr(10)"), (r"<[^>]*>", "''")):
        text = f"regexp_replace({text}, {_quoted(pattern)}, {to}, 'g')"
    for name, value in warc.ENTITIES:
        text = f"replace({text}, {_quoted(name)}, {_quoted(value)})"
    text = f"regexp_replace({text}, ' *\\n[ \\n]*', chr(10), 'g')"
    text = f"regexp_replace(regexp_replace({text}, '^[ \\n]+', ''), '[ \\n]+$', '')"
    title = f"""trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), {blanks}, ' ', 'g'))"""
    links = """array_to_string(list_transform(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1), lambda u: 'outlink: ' || u || chr(13) || chr(10)), '')"""
    fields = " || ".join(
        [_line("source-record", "source"), _line("source-block-digest", "block_sha"), _line("source-payload-digest", "payload_sha"), _line("http-status", "'200'"),
         "'http-header: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)", _line("title", f"nullif({title}, '')"),
         _line("language", """nullif(regexp_extract(html, '(?i)<html\\b[^>]*\\blang="([^"]*)"', 1), '')"""), links]
    )
    head = " || ".join(
        ["'WARC/1.1' || " + crlf, _line("WARC-Type", "record_type"), _line("WARC-Record-ID", "record_id"), _line("WARC-Date", "'1970-01-01T00:00:00Z'"), _line("WARC-Target-URI", "url"),
         _line("WARC-Refers-To", "source"), _line("WARC-Refers-To-Target-URI", "url"), _line("WARC-Refers-To-Date", "'1970-01-01T00:00:00Z'"), _line("WARC-Concurrent-To", "other"),
         _line("WARC-Block-Digest", "content_sha"), _line("WARC-Source-Payload-Digest", "payload_sha"), _line("Content-Type", "content_type"), _line("Content-Length", "size::VARCHAR"), crlf]
    )
    ids = "source, url, '1970-01-01T00:00:00Z', sha1(block)"
    return f"""
WITH p AS (
  SELECT page_id, url, COALESCE(html, '') AS html, {_uuid("'response'", "page_id::VARCHAR")} AS source,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || {crlf} || COALESCE(html, '') AS block FROM pages),
q AS (
  SELECT *, {_digest("block")} AS block_sha, {_digest("html")} AS payload_sha, {_uuid("'metadata'", *ids.split(", "))} AS metadata_id, {_uuid("'conversion'", *ids.split(", "))} AS conversion_id FROM p),
r AS (
  SELECT page_id, url, source, payload_sha, 'metadata' AS record_type, metadata_id AS record_id, conversion_id AS other, 'application/warc-fields' AS content_type, {fields} AS content FROM q
  UNION ALL SELECT page_id, url, source, payload_sha, 'conversion', conversion_id, metadata_id, 'text/plain; charset=UTF-8', {text} FROM q),
z AS (SELECT *, octet_length(encode(content)) AS size, {_digest("content")} AS content_sha FROM r)
SELECT page_id, record_type, record_id, source AS refers_to, url AS target_uri, content_type, size::BIGINT AS content_length, content_sha AS block_digest,
  payload_sha AS source_digest, content, {head} || content || {crlf} || {crlf} AS record FROM z"""


def license_statement(per_template: int = 6, least: float = 0.7) -> str:
    words = f"regexp_extract_all(translate(COALESCE(text, ''), '{urls.UPPER}', '{urls.LOWERCASE}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    rows = ", ".join(f"({i}, '{label}', '{text}'.split(' '))" for i, (label, text, _) in enumerate(licenses.TEMPLATES))
    phrases = []
    for i, (_, text, wanted) in enumerate(licenses.TEMPLATES):
        for phrase in wanted:
            parts, p = text.split(), phrase.split()
            at = next(k for k in range(len(parts)) if parts[k : k + len(p)] == p)
            phrases.append(f"({i}, {at}, '{phrase}'.split(' '))")
    base = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = '{p}'.split(' '))) AS pos FROM d"
        for p, label in licenses.BASE_PHRASES
    )
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
tpl(template, label, words) AS (VALUES {rows}),
must(template, place, phrase) AS (VALUES {", ".join(phrases)}),
tw AS (SELECT template, label, unnest(words) AS word, unnest(range(0, len(words))) AS place FROM tpl),
df AS (SELECT word, count(*) AS files FROM (SELECT doc_id, unnest(list_distinct(w)) AS word FROM d) WHERE word IN (SELECT word FROM tw) GROUP BY word),
idf AS (SELECT tw.*, round(ln(((SELECT count(*) FROM d) + 1.0) / (COALESCE(files, 0) + 1.0)) + 1.0, 6)::DECIMAL(12, 6) AS idf FROM tw LEFT JOIN df USING (word)),
rare AS (SELECT * FROM idf QUALIFY row_number() OVER (PARTITION BY template ORDER BY idf DESC, place) <= {per_template}),
ix AS (SELECT *, sum(idf) OVER (PARTITION BY template) AS total FROM rare),
hit AS (SELECT doc_id, word, pos FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d) WHERE word IN (SELECT word FROM ix)),
vote AS (SELECT doc_id, template, label, pos - place AS shift, sum(idf)::DOUBLE / max(total)::DOUBLE AS share FROM hit JOIN ix USING (word) GROUP BY ALL HAVING sum(idf)::DOUBLE / max(total)::DOUBLE >= {least}),
fit AS (
  SELECT v.* FROM vote v JOIN d USING (doc_id) WHERE NOT EXISTS (
    SELECT 1 FROM must m WHERE m.template = v.template AND (v.shift + m.place < 0 OR d.w[v.shift + m.place + 1 : v.shift + m.place + len(m.phrase)] <> m.phrase))),
b AS ({base}),
bs AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION ALL SELECT doc_id, label FROM fit) GROUP BY doc_id),
fs AS (SELECT doc_id, max(share) AS share FROM fit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, COALESCE(bs.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, COALESCE(bs.labels, '') AS base_labels,
  COALESCE(al.labels, '') AS labels, CASE WHEN bs.n > 0 THEN 1.0 ELSE least(1.0, COALESCE(share, 0.0)) END::DOUBLE AS score
FROM d LEFT JOIN bs ON bs.doc_id = d.doc_id LEFT JOIN al ON al.doc_id = d.doc_id LEFT JOIN fs ON fs.doc_id = d.doc_id"""
