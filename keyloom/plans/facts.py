"""Fact tables derived from the star-schema tables, alike in Spark and in SQL.

Definitions come from ``part``, usages from ``lineitem`` and ``part``, dynamic usages from
``supplier``, suppression directives from ``orders``, literals from ``documents`` and
``conversations``, edits from ``events``, graph edges from ``customer``.
Every row of each table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_KEY = "concat(p_type, '.', replace(p_name, ' ', '_'))"


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_size")
    return p.select(
        F.col("p_partkey").alias("ord"),
        F.expr(_KEY).alias("key"),
        F.expr("element_at(array('en', 'de', 'fr', 'es'), cast(p_partkey % 4 as int) + 1)").alias("locale"),
        F.expr("case when p_partkey % 11 <> 0 then concat('ns', p_partkey % 5) end").alias("namespace"),
        F.expr("case when p_partkey % 7 = 0 then array(concat('ns', (p_partkey + 1) % 5)) end").alias("namespaces"),
        F.expr("concat('locales/', p_partkey % 4, '/f', p_partkey % 13, '.json')").alias("rel_path"),
        F.expr("cast(p_size as bigint)").alias("line"),
        F.expr("1 + p_partkey % 7").alias("column"),
        F.expr("0.5D + (p_partkey % 6) / 10D").alias("confidence"),
        F.col("p_name").alias("value"),
    )


DEFINITIONS = """
definitions AS (
  SELECT p_partkey AS ord, p_type || '.' || replace(p_name, ' ', '_') AS key,
    (['en', 'de', 'fr', 'es'])[(p_partkey % 4) + 1] AS locale,
    CASE WHEN p_partkey % 11 <> 0 THEN 'ns' || (p_partkey % 5) END AS namespace,
    CASE WHEN p_partkey % 7 = 0 THEN ['ns' || ((p_partkey + 1) % 5)] END AS namespaces,
    'locales/' || (p_partkey % 4) || '/f' || (p_partkey % 13) || '.json' AS rel_path,
    CAST(p_size AS BIGINT) AS line, 1 + p_partkey % 7 AS "column",
    0.5::DOUBLE + (p_partkey % 6) / 10::DOUBLE AS confidence, p_name AS value
  FROM part
)"""


def usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr(_KEY).alias("k"))
    return load(spark, sf_dir, "lineitem").select(*cols).join(p, "l_partkey").select(
        F.expr("case when l_linenumber = 7 or length(k) % 3 = 0 then concat('GONE.', k) else k end").alias("key"),
        F.expr("case when l_suppkey % 9 <> 0 then concat('ns', l_suppkey % 5) end").alias("namespace"),
        F.expr("cast(null as array<string>)").alias("namespaces"),
        F.expr("concat('src/m', l_orderkey % 50, '.tsx')").alias("rel_path"),
        F.col("l_orderkey").alias("line"),
        F.expr("cast(l_linenumber as bigint)").alias("column"),
        F.expr("0.4D + (l_suppkey % 7) / 10D").alias("confidence"),
        F.expr("l_suppkey % 13 = 0").alias("suppress_unused_only"),
        F.expr("element_at(array('i18next', 'react-intl', 'vue-i18n'), cast(l_suppkey % 3 as int) + 1)").alias("library"),
    )


USAGES = """
usages AS (
  SELECT CASE WHEN l_linenumber = 7 OR length(p_type || '.' || p_name) % 3 = 0 THEN 'GONE.' ELSE '' END || p_type || '.' || replace(p_name, ' ', '_') AS key,
    CASE WHEN l_suppkey % 9 <> 0 THEN 'ns' || (l_suppkey % 5) END AS namespace,
    'src/m' || (l_orderkey % 50) || '.tsx' AS rel_path, l_orderkey AS line, CAST(l_linenumber AS BIGINT) AS "column",
    0.4::DOUBLE + (l_suppkey % 7) / 10::DOUBLE AS confidence, l_suppkey % 13 = 0 AS suppress_unused_only,
    (['i18next', 'react-intl', 'vue-i18n'])[(l_suppkey % 3) + 1] AS library
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def dynamic_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return s.select(
        F.col("s_suppkey").alias("ord"),
        F.expr("concat('src/dyn', s_suppkey % 20, '.tsx')").alias("rel_path"),
        F.col("s_suppkey").alias("line"),
        F.lit(1).cast("long").alias("column"),
        F.expr("case when s_suppkey % 3 <> 0 then concat('ns', s_suppkey % 5) end").alias("namespace"),
        F.expr("cast(null as array<string>)").alias("namespaces"),
        F.expr("case when s_suppkey % 4 = 0 then array(element_at(array('ECONOMY.', 'SMALL.', 'PROMO.'), cast(s_suppkey % 3 as int) + 1)) else array() end").alias("prefixes"),
        F.expr("case when s_suppkey % 4 = 1 then array(element_at(array('_ring', '_bolt', '_widget'), cast(s_suppkey % 3 as int) + 1)) else array() end").alias("suffixes"),
        F.expr("case when s_suppkey % 4 = 2 then array(element_at(array('red_', 'blue_', 'small_'), cast(s_suppkey % 3 as int) + 1)) else array() end").alias("contains"),
        F.expr("s_suppkey % 50 = 0").alias("covers_namespace"),
    )


DYNAMIC = """
dynamic_usages AS (
  SELECT s_suppkey AS ord, 'src/dyn' || (s_suppkey % 20) || '.tsx' AS rel_path, s_suppkey AS line, 1::BIGINT AS "column",
    CASE WHEN s_suppkey % 3 <> 0 THEN 'ns' || (s_suppkey % 5) END AS namespace,
    CASE WHEN s_suppkey % 4 = 0 THEN (['ECONOMY.', 'SMALL.', 'PROMO.'])[(s_suppkey % 3) + 1] END AS prefix,
    CASE WHEN s_suppkey % 4 = 1 THEN (['_ring', '_bolt', '_widget'])[(s_suppkey % 3) + 1] END AS suffix,
    CASE WHEN s_suppkey % 4 = 2 THEN (['red_', 'blue_', 'small_'])[(s_suppkey % 3) + 1] END AS part,
    s_suppkey % 50 = 0 AS covers_namespace
  FROM supplier
)"""


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file"), F.col("text"))
    c = load(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("file"), "text")
    return d.union(c).select("file", F.posexplode(F.split("text", "\n"))).select(
        "file", (F.col("pos") + 1).cast("long").alias("line"), F.col("col").alias("text")
    )


LITERALS = """
literals AS (
  SELECT file, CAST(i AS BIGINT) AS line, parts[i] AS text
  FROM (SELECT file, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i
        FROM (SELECT 'd' || doc_id AS file, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations))
)"""


def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return o.select(
        F.expr("concat('src/m', o_custkey % 50, '.tsx')").alias("rel_path"),
        F.col("o_orderkey").alias("line"),
        F.expr("case o_orderstatus when 'F' then 'disable' when 'O' then 'enable' else case when o_orderkey % 2 = 0 then 'ignore' else 'ignore-next' end end").alias("kind"),
        F.expr("case when o_custkey % 3 = 0 then array() when o_custkey % 3 = 1 then array('missing-key') else array('missing-key', 'unused-key') end").alias("rules"),
    )


DIRECTIVES = """
directives AS (
  SELECT 'src/m' || (o_custkey % 50) || '.tsx' AS rel_path, o_orderkey AS line,
    CASE o_orderstatus WHEN 'F' THEN 'disable' WHEN 'O' THEN 'enable' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'ignore' ELSE 'ignore-next' END END AS kind,
    CASE WHEN o_custkey % 3 = 0 THEN [] WHEN o_custkey % 3 = 1 THEN ['missing-key'] ELSE ['missing-key', 'unused-key'] END AS rules
  FROM orders
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges: customer -> customer div 3, with a confidence."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return c.select(
        F.col("c_custkey").alias("caller"), F.expr("c_custkey div 3").alias("callee"),
        F.expr("0.5D + floor(pmod(c_acctbal, 50)) / 100D").alias("confidence"),
    )


EDGES = """
edges AS (
  SELECT c_custkey AS caller, c_custkey // 3 AS callee,
    0.5::DOUBLE + floor(((c_acctbal % 50) + 50) % 50) / 100::DOUBLE AS confidence
  FROM customer
)"""
