"""Queries of the corpus problems (2 and 5 to 9) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.shared import table, written
from quadrille.llm import copies, distinct_runs, encode, frequent, pack, truncated

SHARE = 0.005


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent(table(spark, d, "temporal_quads"), ["p", "o"], SHARE).select("field", "item")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent(table(spark, d, "temporal_quads"), ["p", "o"], SHARE).select("field", "item", "n")


def p6_distinct(spark: SparkSession, d: str) -> DataFrame:
    return distinct_runs.distinct_counts(table(spark, d, "temporal_quads"))


def p6_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same counts out of two stored partial results, of the days up to a date and of all other rows."""
    q = table(spark, d, "temporal_quads")
    early = F.coalesce(F.col("t") < F.lit("2022-07-01").cast("date"), F.lit(False))
    return distinct_runs.stored_counts([q.where(early), q.where(~early)])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    c = copies.copies(table(spark, d, "triple_feed"))
    return c.where(F.col("keep_id") != F.col("rec_id")).select("keep_id", F.col("rec_id").alias("copy_id"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    c = copies.copies(table(spark, d, "triple_feed"))
    return c.where(F.col("keep_id") == F.col("rec_id")).select("keep_id", "n")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and those whose ids stand for exactly the bytes of their text (none for null texts)."""
    docs = table(spark, d, "documents")
    back = encode.decode(encode.encode(docs))
    same = F.col("bytes") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select("doc_id", "text").join(back, "doc_id", "left").agg(F.count("*").alias("n_docs"), F.count_if(same).alias("n_equal"))


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, and what breaks the rules: documents lost or cut needlessly, tokens left out or packed twice, containers over capacity, containers beyond the least number and 1 %."""
    packed = written(pack.pack(table(spark, d, "documents")), "packed")
    cap = pack.CAPACITY
    size = encode.encode(table(spark, d, "documents")).select("doc_id", F.size("ids").cast("long").alias("size"))
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.count_distinct("first_token").alias("starts"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    j = size.join(docs, "doc_id", "left")
    lost = F.col("pieces").isNull() | ((F.col("pieces") > 1) & (F.col("size") <= cap))
    wrong = ~((F.col("tokens") == F.col("size")) & (F.col("starts") == F.col("pieces")) & (F.col("end") == F.col("size")))
    a = j.agg(F.count("*").alias("n_docs"), F.count_if(lost).alias("lost_or_cut"), F.count_if(wrong).alias("tokens_wrong"), F.sum("size").alias("total"))
    boxes = packed.groupBy("container").agg(F.sum("n_tokens").alias("filled")).agg(F.count_if(F.col("filled") > cap).alias("too_full"), F.count_if(F.col("filled") > 0).alias("boxes"))
    return a.join(F.broadcast(boxes)).select("n_docs", "lost_or_cut", "tokens_wrong", "too_full", (F.col("boxes") <= F.ceil(F.col("total") / cap) * 1.01 + 1).alias("tight"))  # one row each


def p2_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The heavy values, and whether the sketch's estimate is within a tenth of the threshold of the exact count."""
    f = frequent.frequent(table(spark, d, "temporal_quads"), ["p", "o"], SHARE)
    return f.select("field", "item", (F.abs(F.col("estimate") - F.col("n")) <= F.col("n") / F.col("share") * SHARE / 10).alias("near"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated.judged(table(spark, d, "documents")).where("cut").select("doc_id")


def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncated.by_source(truncated.judged(table(spark, d, "documents")))


def p9_by_way(spark: SparkSession, d: str) -> DataFrame:
    return truncated.judged(table(spark, d, "documents")).where("cut").select("doc_id", "by")


def p9_at_spikes(spark: SparkSession, d: str) -> DataFrame:
    """What built-in expressions find by source: texts at spikes, and those of them without terminal punctuation."""
    s = truncated.at_spikes(table(spark, d, "documents"))
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("at_spike").alias("n_at_spike"), F.count_if(F.col("at_spike") & ~F.col("ended")).alias("n_stops"))


def p9_spikes(spark: SparkSession, d: str) -> DataFrame:
    return truncated.spikes(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p2_estimates, p5_found, p5_records, p6_distinct, p6_merged, p7_ids, p7_roundtrip, p8_containers, p8_rules, p9_found, p9_by_way, p9_by_source, p9_at_spikes, p9_spikes)}

_HEAVY = f"""
SELECT '{{c}}' AS field, {{c}} AS item, count(*) AS n FROM temporal_quads WHERE {{c}} IS NOT NULL
GROUP BY {{c}} HAVING count(*) >= {SHARE} * (SELECT count({{c}}) FROM temporal_quads)
"""
_BOTH = _HEAVY.format(c="p") + " UNION ALL " + _HEAVY.format(c="o")
_SETS = """
SELECT CASE grouping(t, p, src_file) WHEN 3 THEN 't' WHEN 5 THEN 'p' WHEN 6 THEN 'src_file' WHEN 1 THEN 't,p'
       WHEN 2 THEN 't,src_file' WHEN 4 THEN 'p,src_file' ELSE 't,p,src_file' END AS dims, t, p, src_file, '{c}' AS field,
       count(DISTINCT {c}) AS n_distinct
FROM temporal_quads WHERE {c} IS NOT NULL
GROUP BY GROUPING SETS ((t), (p), (src_file), (t, p), (t, src_file), (p, src_file), (t, p, src_file))
"""
_SAME = r"""
SELECT rec_id, list_transform(['subject', 'predicate', 'object'], lambda n: lower(regexp_replace(
         list_filter(fields, lambda f: f[1] = n)[1][2], '[^\p{L}\p{Nd}]', '', 'g'))) AS c
FROM (SELECT rec_id, CASE WHEN ltrim(record) LIKE '{%'
        THEN list_transform(json_keys(record), lambda k: [lower(trim(k)), json_extract_string(record, '$."' || k || '"')])
        ELSE list_transform(string_split(record, '|'), lambda f: [lower(trim(string_split(f, '=')[1])), string_split(f, '=')[2]]) END AS fields
      FROM triple_feed WHERE record IS NOT NULL)
"""
_KEPT = f"SELECT rec_id, min(rec_id) OVER (PARTITION BY c) AS keep_id, count(*) OVER (PARTITION BY c) AS n FROM ({_SAME})"
_CELL = "power(2, CAST('0x' || substr(md5(text), 1, 2) AS INTEGER) % 64)::HUGEINT"
_LENGTHS = f"""
SELECT source, measure, CAST(length AS INTEGER) AS length, count(*) AS n, bit_count(bit_or(cell)) AS cells FROM (
  SELECT source, 'chars' AS measure, length(text) AS length, {_CELL} AS cell FROM documents WHERE length(text) > 0
  UNION ALL SELECT source, 'bytes', strlen(text), {_CELL} FROM documents WHERE length(text) > 0) GROUP BY ALL
"""
_AROUND, _NEAR = truncated.AROUND, truncated.NEAR
_SPIKES = f"""
SELECT source, measure, length, n, longer FROM (
  SELECT *, greatest(CASE WHEN length > {_NEAR + 1} THEN (coalesce(sum(d) OVER (w RANGE BETWEEN {_AROUND} PRECEDING AND {_NEAR + 1} PRECEDING), 0) + 1) / greatest(1, least({_AROUND}, length - 1) - {_NEAR}) ELSE 0 END,
         (coalesce(sum(d) OVER (w RANGE BETWEEN {_NEAR + 1} FOLLOWING AND {_AROUND} FOLLOWING), 0) + 1) / {_AROUND - _NEAR}) AS usual,
         count(*) OVER (PARTITION BY source, measure) AS tried, CAST(sum(n) OVER (PARTITION BY source, measure) - sum(n) OVER w AS BIGINT) AS longer
  FROM (SELECT *, CAST(CASE WHEN cells < 64 THEN least(n, greatest(cells, round(-64 * ln(1 - cells / 64)))) ELSE n END AS DOUBLE) AS d FROM ({_LENGTHS}))
  WINDOW w AS (PARTITION BY source, measure ORDER BY length))
WHERE d > usual AND d * ln(d / usual) - d + usual >= ln(tried / {truncated.CHANCE})
"""
_BLANK = "'" + truncated.BLANKS + "'"
_TAILS = f"""
SELECT *, rtrim(regexp_replace(tail, $re${truncated.MARKS}$re$, ''), {_BLANK}) AS core FROM (
  SELECT *, right(last, {truncated.TAIL}) AS tail FROM (
    SELECT source, length(text) AS chars, strlen(text) AS bytes, regexp_extract(rtrim(text, {_BLANK}), '([^\n]*)$', 1) AS last FROM documents))
"""
ORACLE_SQL = {
    "p9_spikes": _SPIKES,
    "p9_at_spikes": f"""
        WITH s AS ({_SPIKES}), t AS (SELECT *, EXISTS (SELECT 1 FROM s WHERE s.source IS NOT DISTINCT FROM t.source AND ((measure = 'chars' AND length = chars) OR (measure = 'bytes' AND length = bytes))) AS at_spike,
            coalesce((regexp_matches(core, $re${truncated.ENDS}$re$) AND NOT regexp_matches(tail, $re${truncated.HALF}$re$)) OR NOT regexp_matches(last, '\\p{{L}}'), true) AS ended FROM ({_TAILS}) t)
        SELECT source, count(*) AS n_docs, count(*) FILTER (at_spike) AS n_at_spike, count(*) FILTER (at_spike AND NOT ended) AS n_stops FROM t GROUP BY source""",
    "p5_found": f"SELECT keep_id, rec_id AS copy_id FROM ({_KEPT}) WHERE rec_id <> keep_id",
    "p5_records": f"SELECT keep_id, n FROM ({_KEPT}) WHERE rec_id = keep_id",
    "p2_found": f"SELECT field, item FROM ({_BOTH})",
    "p2_counts": _BOTH,
    "p2_estimates": f"SELECT field, item, true AS near FROM ({_BOTH})",
    "p7_roundtrip": "SELECT count(*) AS n_docs, count(*) AS n_equal FROM documents",
    "p8_rules": "SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS lost_or_cut, CAST(0 AS BIGINT) AS tokens_wrong, CAST(0 AS BIGINT) AS too_full, true AS tight FROM documents",
    "p6_distinct": "SELECT *, CAST(n_distinct AS DOUBLE) * (CAST(n_distinct AS DOUBLE) - 1) / 36893488147419103232.0::DOUBLE AS collision_bound FROM ("
    + _SETS.format(c="s") + " UNION ALL " + _SETS.format(c="o") + ")",
}
ORACLE_SQL["p6_merged"] = ORACLE_SQL["p6_distinct"]
