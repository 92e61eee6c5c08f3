"""DuckDB SQL for the corpus queries that SQL can express."""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, ''), md5(text))), 1, 15))::BIGINT AS shuffle
  FROM {docs}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM d GROUP BY source
), w AS (SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::BIGINT::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::BIGINT::DOUBLE AS level
  FROM w WINDOW f AS (ORDER BY cap::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, least(coalesce((SELECT level FROM l WHERE level * weight < cap ORDER BY cap::DOUBLE / weight::DOUBLE, rank LIMIT 1) * weight, cap::DOUBLE), cap::DOUBLE) AS target
  FROM l
), q AS (
  SELECT d.doc_id, d.size, d.shuffle, t.source_size, t.target, t.rank, row_number() OVER () AS row_id,
         sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.shuffle, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, sum(size) OVER (ORDER BY (copy * source_size + upto)::DOUBLE / target, rank, copy, shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS total
  FROM q, (VALUES (0), (1), (2)) AS v(copy) WHERE size > 0
), k AS (
  SELECT row_id, sum(size) AS taken FROM c WHERE total <= (SELECT sum(source_size) FROM t) GROUP BY row_id
)
"""
MIXED = MIX + "SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (row_id)"
PAGES = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), g AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.b = v.r GROUP BY reach.a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON v.r = c.a LEFT JOIN n ON v.r = n.a
"""


def quality_sql(docs: str, keep: str) -> str:
    """The judged rows of ``docs``; ``keep`` lists the columns wanted of d (input) and v (verdict)."""
    from netloom.llm import quality_rules as q

    lists = ", ".join(f"'{w}'" for w in q.vocabulary())
    known = ", ".join(f"'{k}'" for k in sorted(q.COMMON_WORDS))
    rest, classes = "t", []
    for _, pattern in q.CLASSES:
        less = f"regexp_replace({rest}, '{pattern}', '', 'g')"
        classes.append(f"(length({rest}) - length({less}))::BIGINT")
        rest = less
    classes.append(f"length({rest})::BIGINT")
    js = "sqrt(greatest(list_sum(list_transform(list_zip({0}, {1}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END)) / 2, 0))"
    share = "list_transform({0}, lambda x: x / greatest(list_sum({0}), 1)::DOUBLE)"
    bins = (len(q.CLASSES) + 1, len(q.vocabulary()) + 1)
    sums = [f"[{', '.join(f'sum({c}[{i + 1}])' for i in range(k))}] AS {c}" for c, k in zip(("chars", "common"), bins, strict=True)]
    return rf"""
WITH d AS (SELECT *, coalesce(text, '') AS t, row_number() OVER () AS row_id FROM {docs}
), w AS (SELECT row_id, lang, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), h AS (SELECT row_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (SELECT row_id, count(DISTINCT i + o) AS n FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS c FROM h), (VALUES (0), (1), (2)) AS v(o) WHERE c > 1 GROUP BY row_id
), l AS (SELECT row_id, (count(*) - count(DISTINCT x))::BIGINT AS n FROM (SELECT row_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY row_id
), f AS (
  SELECT w.row_id, lang, len(ws)::BIGINT AS n_words, [{', '.join(classes)}] AS chars,
         list_append(list_transform([{lists}], lambda v: len(list_filter(ws, lambda x: x = v))::BIGINT), len(list_filter(ws, lambda x: x NOT IN ({lists})))::BIGINT) AS common,
         coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN l USING (row_id) LEFT JOIN r USING (row_id)
), p AS (SELECT lang, {', '.join(sums)} FROM f WHERE lang IN ({known}) GROUP BY lang
), j AS (
  SELECT f.row_id, p.lang = f.lang AS own, {js.format(share.format("f.chars"), share.format("p.chars"))} AS jc, {js.format(share.format("f.common"), share.format("p.common"))} AS jw
  FROM f, p WHERE n_words > 0
), m AS (SELECT row_id, coalesce(min(jc) FILTER (own), min(jc)) AS jc, coalesce(min(jw) FILTER (own), min(jw)) AS jw FROM j GROUP BY row_id
), v AS (
  SELECT row_id, n_words, list_sum(chars)::BIGINT - chars[2] AS word_chars, chars[5] AS n_symbols, n_dup_lines, n_repeat_words,
         n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN NOT base_failed AND word_chars >= {q.MIN_CHARS} THEN jc END AS char_distance,
         CASE WHEN NOT base_failed AND n_words >= {q.MIN_WORDS_FOR_COMMON} THEN jw END AS word_distance,
         NOT base_failed AND coalesce(char_distance <= {q.MAX_CHAR_DISTANCE}, true) AND coalesce(word_distance <= {q.MAX_WORD_DISTANCE}, true) AS kept
  FROM f LEFT JOIN m USING (row_id)
)
SELECT {keep} FROM d JOIN v USING (row_id)
"""


ORACLES = {
    "op1_mix_sources": MIXED.replace("{docs}", "documents"),
    "op6_warc": PAGES,
    "op8_embedding_near_dedup": VECTORS,
    "op9_quality_rules": quality_sql("documents", "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"),
}
