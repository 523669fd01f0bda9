"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, html, infill, lexical, mixing, packing, pii, quality, secrets, simhash, topk, toxicity, urls
from gridloom.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    code = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), code.alias("fingerprint"), F.col("component").alias("component_id"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256.0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


#: The rules of the query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _of_place(n: int):
    return lambda x: x["place"] == n


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["place"] < len(secrets.BASE_RULES))
    counts = [F.array_size(F.filter("found", _of_place(n))).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(secrets.BASE_RULES)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.described(base), 256).alias("base_sha256"), secrets.described(F.col("found")).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scores.select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), limit=3)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
    return found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.transform(table(spark, sf_dir, "documents"))
    digests = [F.sha2(c, 256).alias(n) for n, c in (("output_sha256", F.col("output")), ("restored_sha256", infill.restored(F.col("output"), F.col("form"))))]
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.array_size(F.filter("base", _of_place(n))).cast("long").alias(f"n_{k.name}") for n, k in enumerate(pii.KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.described(F.col("base")), 256).alias("base_sha256"), secrets.described(F.col("found")).alias("spans"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_secret_scans": op6_secret_scans,
    "op7_toxicity": op7_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_mix_sources": op9_mix_sources,
    "op10_html_extraction": op10_html_extraction,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_personal_data": op13_personal_data,
}

_CHECKS = "\n".join(
    f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{verdict} {name}/{rest}'"
    for verdict, name, rest in ((v, *r.split("/", 1)) for v, r in sorted(URL_RULES, key=lambda x: -len(x[1])))
)
_SPANS = r"""(SELECT list({{'start': CAST(b AS INTEGER), 'place': {place}, 'kind': '{kind}', 'end': CAST(b + length(m) AS INTEGER)}}) FROM (
    SELECT m, c, sum(length(gap) + length(m)) OVER (ORDER BY i) - length(m) AS b FROM (
        SELECT unnest(regexp_extract_all(t, '{pattern}', 0)) AS m, unnest(regexp_extract_all(t, '{pattern}', {group})) AS c,
            unnest(string_split_regex(t, '{pattern}')[1:len(regexp_extract_all(t, '{pattern}', 0))]) AS gap, generate_subscripts(regexp_extract_all(t, '{pattern}', 0), 1) AS i
    )) WHERE length(c) >= {least})"""
_ALL_SPANS = ",\n".join(
    "coalesce(" + _SPANS.format(place=n, kind=r.kind, pattern=r.pattern.replace("'", "''"), group=r.group, least=r.least) + ", [])"
    for n, r in enumerate(secrets.BASE_RULES + secrets.MORE_RULES)
)

ORACLES = {
    "op11_ranked_lexical_search": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '{lexical.TERM}') AS terms FROM documents
        ), c AS (SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0
        ), s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM c
        ), p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM c) GROUP BY r, term
        ), q AS (
            SELECT item_id, text, term, count(*) AS times FROM (
                SELECT item_id, text, unnest(regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '{lexical.TERM}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term), s
        ), x AS (
            SELECT item_id, text, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
            FROM q JOIN p USING (term) JOIN w USING (term) JOIN c USING (r), s GROUP BY ALL
        ), o AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
        ) SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
    """,
    "op12_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), n AS (
            SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM d
        ), c AS (
            SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                length(array_to_string(units[1:least(h[1] % (n + 1), h[2] % (n + 1))], '')) AS a, length(array_to_string(units[1:greatest(h[1] % (n + 1), h[2] % (n + 1))], '')) AS b FROM n
        ), p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c
        ) SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
    """,
    "op5_url_filters": rf"""
        WITH RECURSIVE p AS (
            SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
        ), j AS (SELECT *, CASE {_CHECKS} END AS hit FROM p
        ), s AS (
            SELECT host, 2 * count(*) FILTER (hit LIKE 'allow%') > count(*) AS trust, 2 * count(*) FILTER (hit LIKE 'block%') > count(*) AS distrust FROM j WHERE host <> '' GROUP BY host
        ), seeds AS (SELECT 'trust' AS kind, host FROM s WHERE trust UNION ALL SELECT 'distrust', host FROM s WHERE distrust
        ), l AS (
            SELECT host AS src, CASE WHEN regexp_matches(u, '(?i)^[a-z][a-z0-9+.-]*://') THEN translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') WHEN starts_with(u, '//') THEN translate(regexp_extract('http:' || u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') WHEN regexp_matches(u, '(?i)^[a-z][a-z0-9+.-]*:') THEN '' ELSE base END AS dst FROM (
                SELECT host, CASE WHEN regexp_matches(e, '(?i)^[a-z][a-z0-9+.-]*://') THEN translate(regexp_extract(e, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') WHEN starts_with(e, '//') THEN translate(regexp_extract('http:' || e, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') WHEN regexp_matches(e, '(?i)^[a-z][a-z0-9+.-]*:') THEN '' ELSE '' END AS base, unnest(us) AS u FROM (
                    SELECT host, regexp_extract(html, '(?i)<base\b[^>]*?\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) AS e, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) AS us FROM p))
        ), n AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
        ), b AS (SELECT 'trust' AS kind, src AS a, dst AS b, n FROM n UNION ALL SELECT 'distrust', dst, src, n FROM n
        ), w AS (
            SELECT kind, a, b, 0.85 * n / sum(n) OVER (PARTITION BY kind, a) AS w FROM b
            UNION ALL SELECT kind, '*', host, 0.15 / count(*) OVER (PARTITION BY kind) FROM seeds
            UNION ALL SELECT DISTINCT kind, '*', '*', 1.0 FROM seeds
        ), r AS (
            SELECT 0 AS step, kind, '*' AS host, 1.0::DOUBLE AS score FROM (SELECT DISTINCT kind FROM seeds)
            UNION ALL SELECT r.step + 1, w.kind, w.b, CAST(sum(w.w * r.score) AS DOUBLE) FROM r JOIN w ON w.kind = r.kind AND w.a = r.host WHERE r.step < 20 GROUP BY ALL
        ), x AS (
            SELECT host FROM r WHERE step = 20 AND host <> '*' GROUP BY host
            HAVING coalesce(sum(score) FILTER (kind = 'distrust'), 0) > coalesce(sum(score) FILTER (kind = 'trust'), 0)
        ) SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, coalesce(split_part(hit, ' ', 1), CASE WHEN host IN (FROM x) THEN 'block' END, 'allow') AS verdict FROM j
    """,
    "op6_secret_scans": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
        ), f AS (SELECT doc_id, list_sort(flatten([{_ALL_SPANS}])) AS found FROM d
        ), g AS (
            SELECT doc_id, found, list_filter(found, lambda x: x.place < 3) AS base FROM f
        ) SELECT doc_id, CAST(len(list_filter(found, lambda x: x.place = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(found, lambda x: x.place = 1)) AS BIGINT) AS n_access,
            CAST(len(list_filter(found, lambda x: x.place = 2)) AS BIGINT) AS n_hex,
            sha256(coalesce(array_to_string(list_transform(base, lambda x: x.kind || ':' || x.start || ':' || x."end"), ','), '')) AS base_sha256,
            coalesce(array_to_string(list_transform(found, lambda x: x.kind || ':' || x.start || ':' || x."end"), ','), '') AS spans FROM g
    """,
    "op2_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.c, d.c) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.c) = len(d.c) WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        ) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op4_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
        ), g AS (
            SELECT doc_id, norm, first_value(doc_id) OVER o AS keep_id, row_number() OVER o = 1 AS kept, count(*) OVER (PARTITION BY norm) AS group_size FROM n WINDOW o AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
        ) SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op9_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                CAST(((((coalesce(doc_id, 0) % 2147483647) + 2147483647) % 2147483647) * 48271) % 2147483647 AS BIGINT) >> 21 AS block FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
        ), l AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level FROM s
            WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
            SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target,
                ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l
        ), p AS (
            SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size DESC, block, doc_id NULLS FIRST) AS place FROM d
        ), c AS (
            SELECT p.doc_id, p.size, t.source_size, t.target, t.u, p.place, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
            FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
        ) SELECT doc_id, size, source_size, target, CAST(least(3, floor(u + place * rate) - floor(u + (place - 1) * rate)) AS BIGINT) * size AS taken FROM c
    """,
}
