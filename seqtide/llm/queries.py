"""The registered queries of the corpus operators, with the SQL of the same rows where DuckDB can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives as ar
from . import centroids as ce
from . import decontaminate as dc
from . import exact_dedup as ed
from . import html_text as ht
from . import infilling as fm
from . import jaccard_join as jj
from . import language_model as lm
from . import line_dedup as ld
from . import packing as pk
from . import personal_data as pd
from . import quality as ql
from . import substring_dedup as sd
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op1_benchmark_decontamination",
    r"""
    WITH w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
               UNION ALL
               SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
    p AS (SELECT side, id, l, unnest(range(1, len(l) - 3)) AS pos FROM w WHERE len(l) >= 5),
    s AS (SELECT DISTINCT side, id, array_to_string(list_slice(l, pos, pos + 4), ' ') AS g FROM p),
    n AS (SELECT id, count(*) AS item_shingles FROM s WHERE side = 1 GROUP BY id),
    m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared_shingles FROM s d JOIN s i ON d.g = i.g AND d.side = 0 AND i.side = 1 GROUP BY ALL)
    SELECT doc_id, item_id, item_shingles, shared_shingles FROM m JOIN n ON n.id = item_id WHERE 100 * shared_shingles >= 80 * item_shingles
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ht.extract_text(table(spark, sf_dir, "pages"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ql.quality_scores(docs, ql.train(docs, table(spark, sf_dir, "labels")))


@query("op2_ngram_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jj.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), order=3)


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pd.personal_data(table(spark, sf_dir, "documents"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pk.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


@query(
    "op8_exact_dedup",
    r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
           sha256(body) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY body)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.exact_dedup(table(spark, sf_dir, "documents"))


@query(
    "op9_line_dedup",
    r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    w AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS pos, l FROM t WHERE len(l) >= 3),
    h AS (SELECT doc_id, pos, array_to_string(list_slice(l, pos + 1, pos + 3), chr(10)) AS win FROM w),
    r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM h),
    g AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM r WHERE k > 1),
    n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE NOT near) AS n_spans, list(line) AS gone
          FROM (SELECT doc_id, line, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line) = line - 1, false) AS near FROM g)
          GROUP BY doc_id)
    SELECT t.doc_id, len(l)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(CASE WHEN gone IS NULL THEN body
                  ELSE array_to_string([l[i + 1] FOR i IN range(0, len(l)) IF NOT list_contains(gone, i)], chr(10)) END) AS kept_sha256
    FROM t LEFT JOIN n ON t.doc_id = n.doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ld.line_dedup(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sd.substring_dedup(table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_centroid_clustering", ce.sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ce.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)


@query(
    "op12_fill_in_middle",
    r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    k AS (SELECT *, len(l) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
          CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
    p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:], '') AS suf FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(body) AS restored_sha256
    FROM p
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, percent=100, spm_percent=50)
    back = fm.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query(
    "op13_warc",
    """
    WITH t AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    r AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest,
                 row_number() OVER (PARTITION BY body ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY body) AS kept FROM t)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND k > 1 THEN kept END AS refers_to
    FROM r
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ar.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
