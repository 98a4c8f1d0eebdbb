"""The queries of the text operators: each takes (spark, sf_dir) and returns its result over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scored

    return scored(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated_spans

    found = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op4_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recompress import removed

    found = removed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bwt_dedup import removed

    found = removed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import matched

    return matched(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linedup import deduplicated

    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches and a repeated delivery: all documents; revised counts where several lines lost the last one; toxic documents out."""
    import uuid

    from .common import scratch_root
    from .rollup import TokenLedger, counted

    docs = table(spark, sf_dir, "documents")
    ledger = TokenLedger(spark, f"{scratch_root(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.commit("1-load", counted(docs).withColumn("op", F.lit("insert")))
    cut = docs.where(F.locate("\n", "text") > 0).withColumn("text", F.regexp_replace("text", r"\n[^\n]*\z", ""))
    revised = counted(cut).withColumn("op", F.lit("revise"))
    ledger.commit("2-last-lines", revised)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    gone = ledger.live().join(toxic, "doc_id", "left_semi")
    ledger.commit("3-toxic", gone.withColumn("op", F.lit("delete")))
    ledger.commit("2-last-lines", revised)
    return ledger.totals()


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .product_codes import product_codes

    return product_codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .align import linked

    return linked(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_score, op2_decontaminate, op3_packing, op4_recompress, op5_bwt_dedup, op6_imatch, op7_simhash, op8_line_dedup, op9_quality, op10_token_rollup, op11_html_text, op12_product_codes, op13_align)}


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), runs AS (
  SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM lines
), later AS (
  SELECT doc_id, i, line, j IS NOT NULL AND row_number() OVER (PARTITION BY j IS NULL, line, next ORDER BY doc_id, i) > 1 AS starts,
    strlen(line) >= 200 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS alone FROM runs
), judged AS (
  SELECT *, starts OR alone OR coalesce(lag(starts) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM later
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS run FROM judged
)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_removed, count_if(run)::BIGINT AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM edges GROUP BY doc_id
"""

OP10_SQL = r"""
WITH kept AS (
  SELECT source, lang, regexp_replace(text, '\n[^\n]*\z', '') AS text FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
), counted AS (
  SELECT source, lang, 'spaced-1' AS version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'alnum-1', len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM kept
)
SELECT source, lang, version, count(*) AS docs, sum(n)::BIGINT AS tokens FROM counted GROUP BY ALL
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH w AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
iw AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
ip AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS p FROM iw WHERE len(ws) > 0)),
dp AS (SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w, (SELECT DISTINCT k FROM ip) WHERE len(ws) >= k)),
hit AS (SELECT DISTINCT doc_id, p, dp.k, item_id FROM dp JOIN ip ON dp.k = ip.k AND dp.phrase = ip.phrase),
pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p : p + 49], ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
old AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY words) AS first FROM win) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
judged AS (SELECT word.doc_id, word, i, max((old.p IS NOT NULL)::INT) OVER (PARTITION BY word.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone
  FROM word LEFT JOIN old ON old.doc_id = word.doc_id AND old.p = word.i),
kept AS (SELECT doc_id, count_if(gone)::BIGINT AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS s FROM judged GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    from .product_codes import oracle

    return {"op12_product_codes": oracle(), "op2_decontaminate": OP2_SQL, "op4_recompress": OP4_SQL, "op8_line_dedup": OP8_SQL, "op10_token_rollup": OP10_SQL}
