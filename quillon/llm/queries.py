"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, fill_in_middle, html_text, langid, media, mixing, packing, pii, secret_scan, simhash, suffix_dedup, url_filter, vector_codes
from quillon.llm.common import documents, remove, shared_folder


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(documents(spark, sf_dir))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules first, then all: the second scan runs only the pairs that the ledger does not have."""
    ledger = f"{shared_folder(spark).rstrip('/')}/secret-ledger-{uuid.uuid4().hex}"
    found = secret_scan.scan_into(ledger, documents(spark, sf_dir), secret_scan.BASE, secret_scan.RULES)
    remove(spark, ledger)  # what was found is saved
    return secret_scan.report(found)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(documents(spark, sf_dir))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return vector_codes.with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(documents(spark, sf_dir))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_exact_dedup, op3_pii_surrogates, op4_secret_scans, op5_media_columns, op6_suffix_array_dedup, op7_simhash_near_dedup, op8_source_mixing, op9_html_extraction, op10_language_id, op11_url_filters, op12_vector_codes, op13_fill_in_middle)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _spans_sql(rule: secret_scan.Rule) -> str:
    """(start, end, own) of each match: lengths of the gaps and matches before it summed up."""
    p = rule.pattern.replace("'", "''")
    own = f"length(regexp_extract(hits[i], '{p}', {rule.group}))"
    return f"""list_filter(list_transform(range(1, len(hits) + 1), lambda i: struct_pack(
        s := CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT),
        n := CAST(length(hits[i]) AS BIGINT), own := {own})), lambda x: x.own >= {rule.least})"""


def _secrets_sql() -> str:
    rules = secret_scan.RULES
    each = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS k, unnest({_spans_sql(r)}) AS x FROM (
            SELECT doc_id, regexp_extract_all(t, '{(p := r.pattern.replace("'", "''"))}') AS hits, string_split_regex(t, '{p}') AS gaps FROM texts)"""
        for k, r in enumerate(rules)
    )
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(secret_scan.BASE))
    one = f"{names}[k + 1] || ':' || x.s || ':' || (x.s + x.n)"
    return f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({each}),
        sums AS (SELECT doc_id, {counts}, string_agg({one}, ',' ORDER BY x.s, k) AS spans,
                 string_agg({one}, ',' ORDER BY x.s, k) FILTER (WHERE k < {len(secret_scan.BASE)}) AS base FROM found GROUP BY doc_id)
        SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)},
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts t LEFT JOIN sums USING (doc_id)"""


def _codes_sql() -> str:
    """Each round's assignment and codebook as tables of their own; squared distances are whole numbers below 2^53, so doubles are exact."""
    nearest = lambda book: f"""SELECT vec_id, label, p, min(struct_pack(d := CAST(xx - 2 * list_inner_product(x, y) + yy AS BIGINT), e := e)) AS b
        FROM parts JOIN {book} USING (p) GROUP BY ALL"""
    size = "list_inner_product"
    tables = [f"""whole AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(1024 * CAST(v AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        f"""parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x, {size}(x, x) AS xx FROM whole, range(4) AS t(p))""",
        f"""book0 AS MATERIALIZED (SELECT p, e, y, {size}(y, y) AS yy FROM (SELECT p, x AS y, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256)"""]
    for k in range(vector_codes.ROUNDS):
        tables.append(f"near{k} AS MATERIALIZED ({nearest(f'book{k}')})")
        tables.append(f"""means{k} AS (SELECT p, e, list(m ORDER BY i) AS y FROM (SELECT p, b.e AS e, i, floor(sum(x[i]) / count(*)) AS m FROM near{k} JOIN parts USING (vec_id, p), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL) GROUP BY ALL)""")
        tables.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.y, o.y) AS y, {size}(coalesce(m.y, o.y), coalesce(m.y, o.y)) AS yy FROM book{k} o LEFT JOIN means{k} m USING (p, e))")
    last = f"book{vector_codes.ROUNDS}"
    return f"""WITH {", ".join(tables)}, final AS ({nearest(last)}),
        codes AS (SELECT vec_id, label, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM final GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) FROM {last}) AS codebooks_sha256
        FROM codes"""


ORACLES = {
    "op2_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW same AS (PARTITION BY t)""",
    "op4_secret_scans": _secrets_sql(),
    "op6_suffix_array_dedup": """
        WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        windows AS (SELECT doc_id, b, unnest(range(1, n - 98)) AS i FROM texts WHERE n >= 100),
        hashed AS (SELECT doc_id, i, md5(b[i:i + 99]) AS h FROM windows),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM hashed) WHERE k > 1),
        marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM again),
        islands AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
        spans AS (SELECT doc_id, list(struct_pack(a := a, z := z) ORDER BY a) AS s, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM islands GROUP BY doc_id)
        SELECT t.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN s IS NULL THEN hex(b) ELSE list_aggregate(list_transform(range(1, len(s) + 2), lambda k:
                   hex(b[CASE WHEN k = 1 THEN 1 ELSE s[k - 1].z END : CASE WHEN k > len(s) THEN n ELSE s[k].a - 1 END])), 'string_agg', '') END)) AS kept_sha256
        FROM texts t LEFT JOIN spans USING (doc_id)""",
    "op8_source_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS mark,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
            FROM documents),
        sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        placed AS (SELECT *, (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 AS place FROM sums),
        weighed AS (SELECT *, CAST([5, 2, 1][CAST(place AS INTEGER) + 1] AS DOUBLE) AS weight FROM placed),
        levels AS (
            SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                      / sum(weight) OVER (by_level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed WINDOW by_level AS (ORDER BY source_size / weight, source NULLS LAST)),
        aims AS (SELECT source, source_size, place, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM levels),
        run AS (
            SELECT s.doc_id, s.size, a.source_size, a.place, a.target, CAST(round(a.target) AS BIGINT) AS quota,
                   CASE WHEN a.source_size > 0 THEN CAST(round(a.target) AS BIGINT) // a.source_size ELSE 0 END AS passes,
                   CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.mark, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
        parts AS (SELECT *, least(greatest(quota - passes * source_size - start, 0), size) AS part FROM run),
        shares AS (SELECT *, CASE WHEN quota > 0 THEN CAST(start AS DOUBLE) / CAST(quota AS DOUBLE) ELSE 0 END AS x FROM parts)
        SELECT doc_id, size, source_size, target, passes * size + part AS taken,
               passes + CASE WHEN 2 * part > size THEN 1 ELSE 0 END AS copies,
               CASE WHEN passes * size + part > 0 THEN CASE place
                    WHEN 1 THEN x
                    WHEN 0 THEN CASE WHEN x > 0 THEN 2 * x / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2 * x)) ELSE 0 END
                    ELSE CASE WHEN x > 0 THEN 2 * x / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * x)) ELSE 0 END END END AS position
        FROM shares""",
    "op12_vector_codes": _codes_sql(),
    "op13_fill_in_middle": r"""
        WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        cut AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i:i + 7] AS BIGINT)) AS d FROM drawn),
        ranked AS (
            SELECT *, CAST(len(lines) AS BIGINT) AS n, least(d[1] % (len(lines) + 1), d[2] % (len(lines) + 1)) AS a, greatest(d[1] % (len(lines) + 1), d[2] % (len(lines) + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM cut),
        pieces AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM ranked)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM pieces""",
}
