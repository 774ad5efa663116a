"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runloom.llm import (
    decontamination, exact_dedup, harmonic, importance, language, line_dedup, near_dedup, packing, pii, quality, ranked_search,
    substring_dedup, url_rules,
)
from runloom.llm.stage import fold_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check_sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if check_sql is not None:
            CHECKS[function.__name__] = check_sql
        return function

    return register


@query(r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
    FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
    doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id ROWS UNBOUNDED PRECEDING)
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.filter(fold_of("doc_id", 3) != 1))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), s AS (
    SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM w WHERE len(words) >= 50
), h AS (
    SELECT doc_id, pos, md5(array_to_string(words[pos : pos + 49], ' ')) AS h FROM s
), f AS (
    SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS low FROM h
), g AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM f WHERE low < doc_id
), k AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w
), r AS (
    SELECT k.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept
    FROM k ANTI JOIN g USING (doc_id, pos) GROUP BY k.doc_id
)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, md5(array_to_string(words[pos : pos + 4], ' ')) AS h
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS pos FROM w WHERE len(words) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), e AS (
    SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, reached) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached
), c AS (
    SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


@query()
def op11_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack(table(spark, sf_dir, "documents"), with_ids=False)


@query(r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
    FROM documents
), b AS (
    SELECT item_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
    FROM benchmark
), v AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[pos : pos + least(len(words), 10) - 1], ' ') AS body
    FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS pos FROM b WHERE len(words) > 0)
), sizes AS (
    SELECT DISTINCT n FROM v
), s AS (
    SELECT doc_id, pos, n, array_to_string(words[pos : pos + n - 1], ' ') AS body
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM d CROSS JOIN sizes WHERE len(words) >= n)
), h AS (
    SELECT DISTINCT s.doc_id, s.pos, s.n, v.item_id FROM s JOIN v ON s.body = v.body AND s.n = v.n
), c AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM h) GROUP BY doc_id
), i AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
""")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query()
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(fold_of("doc_id", 4) != 2))
    found = language.identify(docs, model)
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query(r"""
WITH l AS (
    SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents
), w AS (
    SELECT doc_id, pos, lines[pos : pos + 2] AS body
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM l WHERE len(lines) >= 3)
), n AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS n FROM w
), g AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + 3)) AS pos FROM n WHERE n > 1
), k AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM l
), r AS (
    SELECT k.doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY pos) AS kept FROM k ANTI JOIN g USING (doc_id, pos) GROUP BY k.doc_id
)
SELECT l.doc_id, len(lines) AS n_lines, len(lines) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM l LEFT JOIN r USING (doc_id)
""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents"))
    def count_of(k: int, kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}")

    counts = [count_of(k, kind) for k, kind in enumerate(pii.KINDS)]
    # Terms come behind the base kinds where two spans start together.
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["kind"] - a["kind"])
    every = F.when(F.size("terms") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "terms"), order))
    return found.select(
        "doc_id", *counts, F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"), pii.span_list(every).alias("spans"))


# The rules of the contract (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(r"""
WITH u AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM u
), r(rule_host, rule_path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
    SELECT page_id, host, path, rule_host || rule_path AS rule, verdict, length(rule_host || rule_path) AS n
    FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), b AS (
    SELECT page_id, arg_max(rule, n) AS rule, arg_max(verdict, n) AS verdict FROM f GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (page_id)
""")
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rules_of(spark, URL_RULES))


@query(r"""
WITH RECURSIVE texts AS (
    SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
), w AS (
    SELECT row_number() OVER () AS k, side, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
    FROM texts
), f AS (
    SELECT k, side, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w
), n AS (
    SELECT k, side, feature, count(*) AS n FROM f GROUP BY ALL
), r(step, x, v) AS (
    SELECT 0, x::BIGINT, x::BIGINT FROM range(256) t(x)
    UNION ALL SELECT step + 1, x, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM r WHERE step < 8
), tab AS (
    SELECT list(v ORDER BY x) AS tab FROM r WHERE step = 8
), h AS (
    SELECT feature, hex(encode(feature)) AS code FROM (SELECT DISTINCT feature FROM n)
), b AS (
    SELECT feature, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(code) // 2 + 1),
        lambda i: ('0x' || substr(code, CAST(2 * i - 1 AS BIGINT), 2))::BIGINT)),
        lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS bucket
    FROM h, tab
), c AS (
    SELECT side, bucket, sum(n)::BIGINT AS n FROM n JOIN b USING (feature) GROUP BY ALL
), g AS (
    SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM c WHERE side = 0) + 10000)::DOUBLE
        / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM c WHERE side = 1) + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM (FROM c WHERE side = 0) s LEFT JOIN (FROM c WHERE side = 1) t USING (bucket)
), m AS (
    SELECT k, sum(n * gain)::DOUBLE AS total FROM n JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY k
), d AS (
    SELECT doc_id, len(words) AS n_words, greatest(2 * len(words) - 1, 0) AS n_features,
        CAST(floor(coalesce(total, 0) / greatest(2 * len(words) - 1, 1)) AS BIGINT) AS weight,
        ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
    FROM w LEFT JOIN m USING (k) WHERE side = 0 AND doc_id IS NOT NULL
), s AS (
    SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM d
), p AS (
    SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place FROM s
)
SELECT doc_id, n_features, weight, score,
    CASE WHEN place <= 25 * (SELECT count(*) FROM s WHERE n_words >= 20) // 100 THEN place END AS rank
FROM p
""")
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query(r"""
WITH d AS (
    SELECT doc_id, unnest(list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
    FROM documents
), q AS (
    SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
    FROM benchmark
), lengths AS (
    SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
), totals AS (
    SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), f AS (
    SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term
), w AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, totals GROUP BY term, n_docs
), s AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM q JOIN f USING (term) JOIN w USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
), r AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 50
""")
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
