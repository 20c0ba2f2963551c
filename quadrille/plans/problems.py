"""Queries of the general problems 1, 3 and 4 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.shared import table
from quadrille.operators import history as H
from quadrille.operators import skew
from quadrille.sources import quad_lines as L

SHARE = 0.05


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return L.faulty(table(spark, d, "quad_lines")).select("line_id")


def p1_quads(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_quads(table(spark, d, "quad_lines")).where(F.col("reason").isNull()).select("line_id", "s", "p", "o", "t")


def p1_faults_by_file(spark: SparkSession, d: str) -> DataFrame:
    return L.fault_counts(table(spark, d, "quad_lines"))


def p1_rate_by_file(spark: SparkSession, d: str) -> DataFrame:
    p = L.parse_quads(table(spark, d, "quad_lines"), keep=("file_name",))
    return p.groupBy("file_name").agg(F.count("*").alias("n_lines"), F.count("reason").alias("n_faulty"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    quads = skew.hot_keys(table(spark, d, "temporal_quads"), "p", SHARE, tie=["quad_id"])
    pages = skew.hot_keys(table(spark, d, "log_chunk_meta"), "pid", SHARE, tie=["page_no"])
    pick = lambda df, rel: df.select(F.lit(rel).alias("rel"), F.col("k").cast("string").alias("hot_key"))
    return pick(quads, "temporal_quads").unionAll(pick(pages, "log_chunk_meta"))


def p3_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct subjects, objects and days of every predicate (null is a group of its own)."""
    q = table(spark, d, "temporal_quads")
    s = skew.per_key(q, "p", "s", tie=["quad_id"]).select("k", F.col("n").alias("n_rows"), F.col("runs").alias("n_s"))
    o = skew.per_key(q, "p", "o", tie=["quad_id"]).select("k", F.col("runs").alias("n_o"))
    t = skew.per_key(q, "p", "t", tie=["quad_id"]).select("k", F.col("runs").alias("n_t"))
    both = s.join(o, s["k"].eqNullSafe(o["k"])).drop(o["k"])
    return both.join(t, both["k"].eqNullSafe(t["k"])).drop(t["k"]).withColumnRenamed("k", "p").select("p", "n_rows", "n_s", "n_o", "n_t")


def p3_pages(spark: SparkSession, d: str) -> DataFrame:
    """Headers, distinct pages and space used (the greatest a page has) of every pid."""
    m = skew.per_key(table(spark, d, "log_chunk_meta"), "pid", "page_no", value="used_space")
    return m.select(F.col("k").alias("pid"), F.col("n").alias("n_rows"), F.col("runs").alias("pages"), F.col("vsum").alias("space"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    h = H.stored_history(table(spark, d, "change_log"))
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    return h.select("s", "p", "o", day("t_from").alias("t_from"), day("t_to").alias("t_to"))


def p4_version(spark: SparkSession, d: str) -> DataFrame:
    return H.stored_version(table(spark, d, "change_log"), "2022-12-31")


QUERIES = {f.__name__: f for f in (p1_found, p1_quads, p1_faults_by_file, p1_rate_by_file, p3_found, p3_predicates, p3_pages, p4_found, p4_version)}

# A line by its description, with string functions: it is read from both ends. Its tail is the dot, the
# day and the blanks between, its head subject and predicate, and what lies between is the object.
_TRIMMED = "CASE WHEN line LIKE '%' || chr(13) THEN left(line, length(line) - 1) ELSE line END"
_BLANKS = "chr(32) || chr(9)"
_IRI = lambda x: f"length({x}) > 2 AND left({x}, 1) = '<' AND right({x}, 1) = '>' AND translate(substr({x}, 2, length({x}) - 2), ' <>\"' || chr(9), '') = substr({x}, 2, length({x}) - 2)"
_LINES = f"""
SELECT *, coalesce({_IRI('s_')} AND {_IRI('p_')} AND day IS NOT NULL AND parted AND (({_IRI('o_')}) OR literal IS NOT NULL), false) AS good
FROM (
  SELECT *, rtrim(ltrim(rest, {_BLANKS}), {_BLANKS}) AS o_, right(rest, 1) IN (' ', chr(9)) AND left(rest, 1) IN (' ', chr(9)) AS parted,
         -- a literal: its closing quote is the last one, an even number of backslashes stands before each end, and only a tag follows
         CASE WHEN starts_with(body, '"') AND tail_of IN ('', 'tag') AND length(inner_) > 0
               AND NOT contains(replace(replace(inner_, '\\\\', ''), '\\"', ''), '"') AND NOT ends_with(replace(inner_, '\\\\', ''), '\\') THEN inner_ END AS literal
  FROM (
    SELECT *, substr(body, 2, length(body) - 1 - coalesce(strpos(reverse(body), '"'), 0)) AS inner_,
           CASE WHEN after = '' THEN '' WHEN starts_with(after, '@') AND len(list_filter(string_split(substr(after, 2), '-'), lambda x: translate(lower(x), 'abcdefghijklmnopqrstuvwxyz0123456789', '') <> '' OR x = '')) = 0
                     AND translate(lower(string_split(substr(after, 2), '-')[1]), 'abcdefghijklmnopqrstuvwxyz', '') = '' THEN 'tag'
                WHEN starts_with(after, '^^') AND {_IRI('substr(after, 3)')} THEN 'tag' ELSE 'other' END AS tail_of
    FROM (
      SELECT *, ltrim(rtrim(rest, {_BLANKS}), {_BLANKS}) AS body, right(rtrim(rest, {_BLANKS}), greatest(strpos(reverse(rtrim(rest, {_BLANKS})), '"') - 1, 0)) AS after
      FROM (
        SELECT *, CASE WHEN left(p_on, 1) IN (' ', chr(9)) AND strpos(ltrim(p_on, {_BLANKS}), '>') > 0 THEN left(ltrim(p_on, {_BLANKS}), strpos(ltrim(p_on, {_BLANKS}), '>')) END AS p_,
               substr(ltrim(p_on, {_BLANKS}), strpos(ltrim(p_on, {_BLANKS}), '>') + 1) AS rest
        FROM (
          SELECT *, left(core, strpos(core, '>')) AS s_, substr(core, strpos(core, '>') + 1) AS p_on
          FROM (
            SELECT *, CASE WHEN length(day_) = 12 AND left(day_, 1) = '<' AND right(day_, 1) = '>' AND length(translate(substr(day_, 2, 10), '0123456789', '')) = 2 AND substr(day_, 6, 1) = '-' AND substr(day_, 9, 1) = '-'
                           AND dotted THEN try_cast(substr(day_, 2, 10) AS DATE) END AS day, left(undotted, length(undotted) - 12) AS core
            FROM (
              SELECT *, right(undotted, 12) AS day_
              FROM (
                SELECT *, ends_with(said, '.') AS dotted, rtrim(left(said, length(said) - 1), {_BLANKS}) AS undotted
                FROM (SELECT *, ltrim(rtrim({_TRIMMED}, {_BLANKS}), {_BLANKS}) AS said, trim(line, chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND NOT starts_with(line, '#') AS says FROM quad_lines)))))))))
"""
_PATCH = """
SELECT s, p, o, t, arg_max(upper(trim(op)), seq) AS op FROM change_log
WHERE op IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL GROUP BY s, p, o, t
"""
_SPELLS = f"""
SELECT s, p, o, t AS t_from, op, lead(t) OVER w AS t_to FROM (
  SELECT *, lag(op) OVER (PARTITION BY s, p, o ORDER BY t) AS was FROM ({_PATCH}))
WHERE op IS DISTINCT FROM coalesce(was, 'DELETE') WINDOW w AS (PARTITION BY s, p, o ORDER BY t)
"""
ORACLE_SQL = {
    "p1_rate_by_file": f"SELECT file_name, count(*) AS n_lines, count(*) FILTER (NOT good) AS n_faulty FROM ({_LINES}) WHERE says GROUP BY file_name",
    "p1_found": f"SELECT line_id FROM ({_LINES}) WHERE says AND NOT good",
    "p1_quads": rf"""
        SELECT line_id, substr(s_, 2, length(s_) - 2) AS s, substr(p_, 2, length(p_) - 2) AS p,
               CASE WHEN literal IS NULL THEN substr(o_, 2, length(o_) - 2) ELSE array_to_string(list_transform(string_split(literal, '\\'),
                   lambda x: regexp_replace(replace(replace(replace(x, '\t', chr(9)), '\n', chr(10)), '\r', chr(13)), '\\(.)', '\1', 'g')), '\') END AS o, day AS t
        FROM ({_LINES}) WHERE says AND good""",
    "p3_found": f"""
        SELECT 'temporal_quads' AS rel, p AS hot_key FROM temporal_quads WHERE p IS NOT NULL
        GROUP BY p HAVING count(*) >= {SHARE} * (SELECT count(*) FROM temporal_quads)
        UNION ALL SELECT 'log_chunk_meta', CAST(pid AS VARCHAR) FROM log_chunk_meta WHERE pid IS NOT NULL
        GROUP BY pid HAVING count(*) >= {SHARE} * (SELECT count(*) FROM log_chunk_meta)""",
    "p3_predicates": """SELECT p, count(*) AS n_rows, count(DISTINCT s) AS n_s, count(DISTINCT o) AS n_o, count(DISTINCT t) AS n_t
        FROM temporal_quads GROUP BY p""",
    "p3_pages": """SELECT pid, CAST(sum(n) AS BIGINT) AS n_rows, count(page_no) AS pages, CAST(coalesce(sum(used), 0) AS BIGINT) AS space
        FROM (SELECT pid, page_no, count(*) AS n, max(used_space) AS used FROM log_chunk_meta GROUP BY pid, page_no) GROUP BY pid""",
    "p4_found": f"""SELECT s, p, o, strftime(t_from, '%Y-%m-%d') AS t_from, coalesce(strftime(t_to, '%Y-%m-%d'), '') AS t_to
        FROM ({_SPELLS}) WHERE op = 'INSERT'""",
    "p4_version": f"""SELECT s, p, o, t_from FROM ({_SPELLS}) WHERE op = 'INSERT' AND t_from <= DATE '2022-12-31'
        AND (t_to IS NULL OR t_to > DATE '2022-12-31')""",
}
