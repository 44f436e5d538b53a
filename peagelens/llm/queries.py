"""Named queries over the given tables, one for each operator, and their SQL where it exists."""

from pyspark.sql import DataFrame, SparkSession

from peagelens.llm import (
    decision_list,
    decontaminate,
    importance,
    licences,
    mixing,
    pairwise,
    secret_scan,
    simhash,
    site_tree,
    spelling,
    toxicity,
    url_filter,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(_table(spark, sf_dir, "pages"), model)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"), licences.train(spark))
    return found.drop("notices")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return decision_list.judge(docs, decision_list.fit(docs, _table(spark, sf_dir, "labels")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pairwise.score(docs, pairwise.fit(docs, _table(spark, sf_dir, "labels")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(_table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_warc, op3_licences, op4_quality_rules, op5_quality_classifier, op6_secret_scan,
        op7_simhash, op8_decontamination, op9_toxicity, op10_mixing, op11_html_extraction,
        op12_spelling_variants, op13_importance_resampling,
    )
}

ORACLES = {
    "op2_warc": """
WITH facts AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM facts
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
FROM firsts
""",
    "op8_decontamination": r"""
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT n FROM windows
), doc_grams AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
    FROM (
        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc_words, sizes WHERE len(w) >= n
    )
), hits AS (
    SELECT doc_id, item_id, i, g.n FROM doc_grams AS g JOIN windows AS x ON g.n = x.n AND g.gram = x.gram
), hit_words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
    FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words AS d LEFT JOIN hit_words AS h USING (doc_id) LEFT JOIN hit_items AS t USING (doc_id)
""",
    "op10_mixing": r"""
WITH rows AS (
    SELECT doc_id, source,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS key
    FROM documents
), totals AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
    FROM rows GROUP BY source
), limits AS (
    SELECT *,
           CAST(sum(source_size) OVER () AS BIGINT)
             - coalesce(CAST(sum(3 * source_size) OVER b AS BIGINT), 0) AS left_over,
           CAST(sum(w) OVER () AS BIGINT) - coalesce(CAST(sum(w) OVER b AS BIGINT), 0) AS units
    FROM totals
    WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
    SELECT *, left_over / units > 3 * source_size / w AS capped FROM limits
), goals AS (
    SELECT source, source_size,
           CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
                ELSE CAST(sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0) AS BIGINT)
                     / CAST(sum(CASE WHEN NOT capped THEN w END) OVER () AS BIGINT) * w END AS target
    FROM capped
), budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM goals
), keyed AS (
    SELECT source, key, CAST(sum(size) AS BIGINT) AS held FROM rows GROUP BY source, key
), running AS (
    SELECT k.source, k.key, k.held, b.target - b.passes * b.source_size AS budget,
           CAST(sum(k.held) OVER (PARTITION BY k.source ORDER BY k.key) AS BIGINT) - k.held AS below
    FROM keyed AS k JOIN budgets AS b ON k.source IS NOT DISTINCT FROM b.source
), cuts AS (
    SELECT source, max(CASE WHEN below + held <= budget OR below + held - budget < budget - below THEN key END) AS cut
    FROM running WHERE budget > 0 AND below < budget GROUP BY source
)
SELECT r.doc_id, r.size, b.source_size, b.target,
       r.size * (b.passes + CASE WHEN r.key <= coalesce(c.cut, -1) THEN 1 ELSE 0 END) AS taken
FROM rows AS r
JOIN budgets AS b ON r.source IS NOT DISTINCT FROM b.source
LEFT JOIN cuts AS c ON r.source IS NOT DISTINCT FROM c.source
""",
}

#: crc32 of the UTF-8 bytes of each text f of a table named wanted: one table entry for each byte value, one step a byte.
_CRC32 = """
crc_table AS (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(0, 256)) AS b)
), crc_steps AS (
    SELECT f, hex(encode(f)) AS bytes, 1 AS i, 4294967295::BIGINT AS c FROM wanted
    UNION ALL
    SELECT f, bytes, i + 2, xor(c >> 8, v)
    FROM crc_steps JOIN crc_table ON b = xor(c, CAST('0x' || substr(bytes, i, 2) AS BIGINT)) & 255
    WHERE i < length(bytes)
), crcs AS (
    SELECT f, xor(c, 4294967295::BIGINT) AS h FROM crc_steps WHERE i > length(bytes)
)"""

ORACLES["op12_spelling_variants"] = r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{7,}')) AS run
    FROM documents
), counted AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS f, run, count(*) AS n FROM runs GROUP BY ALL
), wanted AS (
    SELECT DISTINCT f FROM counted
), """ + _CRC32 + r""", read_as AS (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM counted JOIN crcs USING (f)
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM read_as WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), shorter AS (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), deleted AS (
    SELECT DISTINCT s.word AS a, w.word AS b FROM shorter AS s JOIN words AS w ON s.part = w.word
), near AS (
    SELECT a, b FROM deleted UNION ALL SELECT b, a FROM deleted
    UNION ALL
    SELECT x.word, y.word FROM shorter AS x JOIN shorter AS y ON x.i = y.i AND x.part = y.part AND x.word <> y.word
), best AS (
    SELECT a AS word, count(*) AS n_near, arg_min(b, struct_pack(less := -n, word := b)) AS other, max(n) AS other_n
    FROM near JOIN words ON words.word = b GROUP BY a
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
           CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
    FROM words LEFT JOIN best USING (word)
), chains AS (
    SELECT word, word AS root, form AS further FROM formed
    UNION ALL
    SELECT c.word, f.word, f.form FROM chains AS c JOIN formed AS f ON c.further = f.word
)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN (SELECT word, root FROM chains WHERE further IS NULL) USING (word)
"""

ORACLES["op13_importance_resampling"] = r"""
WITH RECURSIVE doc_words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), target_words AS (
    SELECT regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), doc_features AS (
    SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM doc_words
), target_features AS (
    SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM target_words
), held AS (
    SELECT doc_id, f, count(*) AS n FROM doc_features GROUP BY ALL
), aimed AS (
    SELECT f, count(*) AS n FROM target_features GROUP BY f
), wanted AS (
    SELECT f FROM held UNION SELECT f FROM aimed
), """ + _CRC32 + r""", s AS (
    SELECT h % 10000 AS bucket, CAST(sum(n) AS DOUBLE) AS s FROM held JOIN crcs USING (f) GROUP BY 1
), t AS (
    SELECT h % 10000 AS bucket, CAST(sum(n) AS DOUBLE) AS t FROM aimed JOIN crcs USING (f) GROUP BY 1
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln(
        (coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000)
        / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS BIGINT) AS gain
    FROM s FULL JOIN t USING (bucket)
), weighed AS (
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
    FROM held JOIN crcs USING (f) JOIN gains ON bucket = h % 10000 GROUP BY doc_id
), scored AS (
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
               (CAST('0x' || substr(sha256('7:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))
               AS BIGINT) AS score
    FROM doc_words AS d LEFT JOIN weighed USING (doc_id)
), placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 25 // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
