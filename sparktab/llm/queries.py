"""The registered queries of this folder and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .compression import codebook_text, compress
from .contamination import find_benchmark
from .exact import decide_copies
from .extraction import extract_text
from .licenses import find_licenses
from .mixing import mix_sources, with_targets
from .pieces import encode_texts
from .resampling import resample
from .scoring import score_texts
from .secret_spans import find_secrets
from .simhash import near_duplicates
from .spelling import count_words, spelling_variants
from .units import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op6_benchmark_contamination",
    rf"""
    WITH d AS (
      SELECT row_number() OVER () AS row_no, doc_id,
             regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
    i AS (
      SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    iw AS (
      SELECT DISTINCT item_id, least(10, len(w)) AS n, w[s : s + least(10, len(w)) - 1] AS win
      FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM iw),
    dw AS (
      SELECT row_no, n, s, w[s : s + n - 1] AS win
      FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
    hits AS (SELECT row_no, s, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
    words AS (
      SELECT row_no, count(DISTINCT p) AS n_hit
      FROM (SELECT row_no, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
    items AS (
      SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT row_no, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL)
      GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (row_no) LEFT JOIN items USING (row_no)
    """,
)
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op9_exact_dedup",
    """
    WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, row_no DESC) = 1 AS kept,
           sha256(t) AS text_sha256
    FROM d
    """,
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide_copies(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op8_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", width=3, distance=3)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op3_sentencepiece")
def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", piece_model()))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_digests(encoded: DataFrame, *more: Column) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
        *more,
    )


@query("op2_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        words = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(words, ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        sha256(joined(F.filter("spans", lambda s: s["kind"] != "random"))).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op4_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["phrase"])
    starts = F.transform(base, lambda p: p["begin"])

    def labels(places: Column | str) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


@query("op10_quality_resampling")
def quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resample(docs, table(spark, sf_dir, "labels"))
    return found.select(
        F.col("row.c0").alias("doc_id"),
        "n_grams",
        F.round("log_weight", 6).alias("log_weight"),
        F.round("sample_key", 6).alias("sample_key"),
        "kept",
    )


@query("op7_attention_lm")
def attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), piece_model())


@query("op5_unit_dedup")
def unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["begin"].cast("string"), s["end"].cast("string")))
    sizes = F.transform("removed", lambda s: s["end"] - s["begin"])
    return found.select(
        "doc_id",
        F.size("removed").cast("bigint").alias("n_removed"),
        F.aggregate(sizes, F.lit(0), lambda total, size: total + size).cast("bigint").alias("removed_chars"),
        F.array_join(spans, ",").alias("removed_spans"),
        "text",
    )


@query("op1_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "main_blocks", "all_blocks")


@query("op11_spelling_variants")
def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_words(table(spark, sf_dir, "documents"), "doc_id", "text", least_chars=5, least_count=3, slip_every=97)
    return spelling_variants(words, ratio=2).select("word", "form", "root", "n", "n_near", "form_n")


def _lloyd_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Every round as three steps: nearest entries, sums per entry, moved codebooks."""
    steps = []

    def nearest(n: int) -> str:
        return f"""
        m{n} AS MATERIALIZED (
          SELECT r, j, min(d * {entries} + e) AS m
          FROM (SELECT p.r, p.j, c.e,
                       CAST(p.xx - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT) AS d
                FROM p JOIN c{n} c ON p.j = c.j)
          GROUP BY ALL)"""

    for n in range(rounds):
        steps += [
            nearest(n),
            f"""
            s{n} AS MATERIALIZED (
              SELECT j, m % {entries} AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
              FROM (SELECT r, j, m, x, unnest(range(1, len(x) + 1)) AS i FROM m{n} JOIN p USING (r, j)) GROUP BY ALL)""",
            f"""
            c{n + 1} AS MATERIALIZED (
              SELECT c.j, c.e, coalesce(u.x, c.x) AS x
              FROM c{n} c LEFT JOIN (
                SELECT j, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x FROM s{n} GROUP BY j, e) u
              ON c.j = u.j AND c.e = u.e)""",
        ]
    return f"""
    WITH k AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
             [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
      FROM embeddings
      WHERE len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
    q AS (SELECT r, v, len(v) // {parts} AS w, unnest(range({parts})) AS j FROM k),
    p AS MATERIALIZED (
      SELECT r, j, v[j * w + 1 : (j + 1) * w] AS x, list_dot_product(v[j * w + 1 : (j + 1) * w], v[j * w + 1 : (j + 1) * w]) AS xx
      FROM q),
    c0 AS (SELECT j, r AS e, x FROM p WHERE r < {entries}),
    {",".join(steps)},
    {nearest(rounds)},
    f AS (
      SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY j) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error
      FROM m{rounds} GROUP BY r),
    b AS (
      SELECT sha256(string_agg(array_to_string([CAST(y AS BIGINT) FOR y IN x], ','), ',' ORDER BY j, e)) AS codebooks_sha256
      FROM c{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM f JOIN k USING (r), b
    """


@query("op12_vector_codes", _lloyd_sql(8, 16, 6, 4096))
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks, _ = compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", parts=8, entries=16, rounds=6, scale=4096)
    digits = F.transform("code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0"))
    return codes.select(
        F.col("id").alias("vec_id"),
        F.array_join(digits, "").alias("code"),
        "error",
        "label_error",
        sha256(F.lit(codebook_text(codebooks))).alias("codebooks_sha256"),
    )


@query(
    "op13_source_mix",
    r"""
    WITH d AS MATERIALIZED (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             CAST('0x' || substr(md5(concat_ws('|', '13', CAST(doc_id AS VARCHAR))), 1, 15) AS BIGINT) AS key
      FROM documents),
    s AS (
      SELECT source, sum(size) AS size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS weight
      FROM d GROUP BY source),
    o AS (
      SELECT *, row_number() OVER (ORDER BY size / weight, source NULLS LAST) AS nth FROM s),
    h AS (
      SELECT *, coalesce(sum(2.0 * size) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(size) OVER () AS whole
      FROM o),
    l AS (
      SELECT arg_min((1.5 * whole - held) / free, nth) AS level
      FROM h WHERE (1.5 * whole - held) / free * weight <= 2.0 * size),
    t AS (SELECT source, size, CAST(least(coalesce(level, 0) * weight, 2.0 * size) AS DOUBLE) AS target FROM s, l),
    f AS (
      SELECT source, size AS whole, target, flow // greatest(size, 1) AS times, flow - flow // greatest(size, 1) * size AS extra
      FROM (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS flow FROM t)),
    r AS (
      SELECT d.*, CAST(floor(log2(d.size + 0.5)) AS INT) AS class, row_number() OVER () AS row_no FROM d),
    c AS (
      SELECT r.*, whole, target, times, extra,
             sum(r.size) OVER (PARTITION BY r.source, class ORDER BY key, doc_id NULLS FIRST, r.size, row_no) AS inside,
             floor(extra * CAST(sum(r.size) OVER (PARTITION BY r.source, class) AS DOUBLE) / whole) AS part,
             sum(r.size) OVER (PARTITION BY r.source, class) AS words
      FROM r JOIN f ON r.source IS NOT DISTINCT FROM f.source WHERE r.size > 0),
    g AS (
      SELECT source, class, coalesce(max(CASE WHEN inside <= part THEN inside END), 0) AS fitted, any_value(words) AS words, any_value(extra) AS extra
      FROM c GROUP BY source, class),
    m AS (
      SELECT *, extra - sum(fitted) OVER (PARTITION BY source) AS missing,
             coalesce(sum(words - fitted) OVER (PARTITION BY source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM g),
    z AS (
      SELECT row_no, c.size * (times + CASE WHEN c.extra > 0 AND (inside <= fitted OR (missing > 0 AND 2 * (inside - fitted + before) - c.size <= 2 * missing)) THEN 1 ELSE 0 END) AS taken
      FROM c JOIN m ON c.source IS NOT DISTINCT FROM m.source AND c.class = m.class)
    SELECT doc_id, CAST(r.size AS BIGINT) AS size, CAST(f.whole AS BIGINT) AS source_size, f.target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
    FROM r JOIN f ON r.source IS NOT DISTINCT FROM f.source LEFT JOIN z USING (row_no)
    """,
)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, sources = mix_sources(
        table(spark, sf_dir, "documents"), "doc_id", "text", "source", weights=[3.0, 1.0, 2.0], share=1.5, most=2, seed=13
    )
    return with_targets(mixed, sources).withColumnRenamed("id", "doc_id")
