"""Registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_folder, ensure_checkpoint_dir, settle, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), size=400).drop("text")


#: The mixture of the query: as even as this share of the full entropy, no source more often than this.
MIX_ENTROPY, MIX_REPEATS, MIX_BLOCK = 0.9999, 1.25, 100_000


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, n_tokens

    docs = settle(table(spark, sf_dir, "documents").select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens")))
    out = mix(docs, tokens="n_tokens", entropy_share=MIX_ENTROPY, max_repeats=MIX_REPEATS, budget_share=1.0, block_tokens=MIX_BLOCK, seed=7)
    return out.select("doc_id", "source", "n_tokens", "weight", "copies", "block", "block_order")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_common_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_common_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("line_n").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import annotate

    return annotate(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archive, write_archive

    folder = f"{ensure_checkpoint_dir(spark)}/skylume-warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), folder, min_bytes=100)
    found = settle(read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    delete_folder(spark, folder)
    return found


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import annotate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = annotate(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_texts
    from .langid import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, train_when=fold() != 1, held_out=F.coalesce(fold() == 1, F.lit(False)))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold, predict, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold() != 0))
    return predict(docs.select("doc_id", "text", F.coalesce(fold() == 0, F.lit(False)).alias("held_out")), model).drop("text")


def _mixing_sql(steps: int = 5, ways: int = 64) -> str:
    """The bisection is unrolled: a pair of brackets (entropy, repetitions) for each step."""
    h = lambda parts: f"('0x' || substr(md5({parts}), 1, 15))::BIGINT"
    steps_sql = ""
    for name, good, below in (("e", f"h >= {MIX_ENTROPY} * (SELECT ln(count(*)) FROM live)", True), ("r", f"r <= {MIX_REPEATS}", False)):
        steps_sql += f", {name}0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)"
        for k in range(steps):
            pick = f"coalesce(max(k) FILTER (WHERE {good}), 0)" if below else f"coalesce(min(k) FILTER (WHERE {good}), {ways})"
            a, b = ("j", f"least(j + 1, {ways})") if below else ("greatest(j - 1, 0)", "j")
            steps_sql += f"""
, {name}{k}g AS (SELECT k, lo + (hi - lo) * k / {ways} AS a FROM {name}{k}, (SELECT unnest(range({ways + 1})) AS k))
, {name}{k}m AS (SELECT k, ln(sum(exp(a * ln(p)))) - first(a) * sum(exp(a * ln(p)) * ln(p)) / sum(exp(a * ln(p))) AS h,
    max(exp(a * ln(p)) / t) * (SELECT sum(t) FROM live) / sum(exp(a * ln(p))) AS r FROM {name}{k}g, live GROUP BY k)
, {name}{k}j AS (SELECT {pick} AS j FROM {name}{k}m)
, {name}{k + 1} AS (SELECT lo + (hi - lo) * ({a}) / {ways} AS lo, lo + (hi - lo) * ({b}) / {ways} AS hi FROM {name}{k}, {name}{k}j)"""
    return rf"""
WITH docs AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS s, coalesce(doc_id::VARCHAR, '') AS id,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n FROM documents
), sources AS (SELECT s, sum(n)::BIGINT AS t FROM docs GROUP BY s
), live AS (SELECT s, t, t / (SELECT sum(t)::DOUBLE FROM sources) AS p FROM sources WHERE t > 0){steps_sql}
, alpha AS (SELECT CASE WHEN (SELECT count(*) FROM live) < 2 THEN 1.0 ELSE greatest(e{steps}.lo, r{steps}.hi) END AS a FROM e{steps}, r{steps}
), weighted AS (
  SELECT s, t, round(exp(a * ln(p)) / sum(exp(a * ln(p))) OVER (), 9) AS weight FROM live, alpha
), budgets AS (
  SELECT *, floor(weight * (SELECT sum(t)::DOUBLE FROM sources))::BIGINT AS budget FROM weighted
), parts AS (
  SELECT s, t, weight, budget // t AS passes, budget % t AS rest, greatest(1, ceil(t / {float(MIX_BLOCK)}))::BIGINT AS blocks FROM budgets
), placed AS (
  SELECT docs.*, coalesce(weight, 0) AS weight, coalesce(passes, 0) AS passes, coalesce(rest, 0) AS rest,
    {h("'7b|' || id")} % coalesce(blocks, 1) AS block, {h("'7d|' || id")} AS o FROM docs LEFT JOIN parts USING (s)
), ordered AS (SELECT *, {h("'7o|' || s || '|' || block")} AS block_order FROM placed
), sums AS (SELECT s, rest, block, block_order, sum(n) AS n FROM ordered WHERE rest > 0 GROUP BY ALL
), runs AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY block_order, block) AS upto FROM sums
), cut AS (
  SELECT s, arg_min(block, block_order) AS cut_block, min(block_order) AS cut_order, arg_min(rest - upto + n, block_order) AS room
  FROM runs WHERE upto > rest GROUP BY s
), inside AS (
  SELECT s, o, room, sum(n) AS n FROM ordered JOIN cut USING (s) WHERE block = cut_block GROUP BY ALL
), reach AS (SELECT s, o, room, sum(n) OVER (PARTITION BY s ORDER BY o) AS upto FROM inside
), last AS (SELECT s, max(o) AS last_order FROM reach WHERE upto <= room GROUP BY s)
SELECT doc_id, source, n AS n_tokens, weight, passes + CASE WHEN rest > 0 AND (coalesce(block_order < cut_order, false)
    OR coalesce(block = cut_block AND o <= last_order, false)) THEN 1 ELSE 0 END AS copies, block, block_order
FROM ordered LEFT JOIN cut USING (s) LEFT JOIN last USING (s)
"""


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
  count(*) FILTER (common.k IS NOT NULL)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.k = common.k
GROUP BY doc_id
"""

OP7_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages
), f AS (SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.html = p.html
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 10) AS m FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark) WHERE len(w) > 0
), bp AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM b),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS g FROM bp),
sizes AS (SELECT DISTINCT m FROM b),
dp AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m),
hits AS (
  SELECT dp.doc_id, dp.p, dp.m, bw.item_id FROM dp JOIN bw ON bw.m = dp.m AND bw.g = array_to_string(dp.w[dp.p:dp.p + dp.m - 1], ' ')
), places AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_mixing": op2_mixing,
        "op3_line_dedup": op3_line_dedup,
        "op4_pii": op4_pii,
        "op5_simhash": op5_simhash,
        "op6_quality": op6_quality,
        "op7_warc": op7_warc,
        "op8_decontaminate": op8_decontaminate,
        "op9_hmm": op9_hmm,
        "op10_langid": op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": _mixing_sql(),
        "op3_line_dedup": OP3_SQL,
        "op7_warc": OP7_SQL,
        "op8_decontaminate": OP8_SQL,
    }
