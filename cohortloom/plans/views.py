"""Cohort views over the given tables, as Spark frames and as SQL with the same meaning.

entity = customer, sample = order, label/severity from account balance and nation, probability from
order price; a raw id carries the spelling noise the resolution has to undo.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.plans.registry import table

# Expressions both engines read alike.
ENTITY_KEY = "concat('C', lpad(cast(o_custkey as string), 6, '0'))"
CUSTOMER_KEY = "concat('C', lpad(cast(c_custkey as string), 6, '0'))"
RAW_ID = f"""case o_orderkey % 10
  when 3 then translate({ENTITY_KEY}, '0158', 'OISB')
  when 5 then concat('  ', lower({ENTITY_KEY}), chr(9))
  when 7 then concat('X', {ENTITY_KEY})
  when 9 then concat('Z', cast(o_orderkey as string))
  else {ENTITY_KEY} end"""


def name_of(key: str) -> str:
    return (
        f"case when {key} % 3 = 0 then concat('N', cast(cast(floor({key} / 6) as bigint) as string))"
        f" else concat('U', cast({key} as string)) end"
    )


CANDIDATE = f"case when o_orderkey % 10 = 7 then {name_of('o_custkey')} else '' end"
LABEL = "case when c_custkey % 20 = 7 then null when c_acctbal > 4500 then 1 else 0 end"
SEVERITY = "case when c_custkey % 20 = 7 then null when c_acctbal > 4500 then 1 + c_nationkey % 3 else 0 end"
PROB = "least(1.0, o_totalprice / 500000.0)"
SPLIT_OF = "case when {h} in ('0', '1') then 'val' when {h} in ('2', '3') then 'test' when {h} = '4' then 'unlabelled' else 'train' end"


def split_expr(key: str) -> str:
    return SPLIT_OF.format(h=f"substr(md5(cast({key} as string)), 1, 1)")


CTE = {
    "samples": f"samples AS (SELECT o_orderkey AS sample_id, o_custkey AS entity_id,"
    f" CAST(year(o_orderdate) AS INTEGER) AS year, CAST({PROB} AS DOUBLE) AS prob, o_totalprice AS price,"
    " o_orderstatus AS status, o_orderpriority AS priority FROM orders)",
    "outcomes": f"outcomes AS (SELECT c_custkey AS entity_id, CAST({LABEL} AS INTEGER) AS label,"
    f" CAST({SEVERITY} AS INTEGER) AS severity, c_acctbal AS balance, c_nationkey AS nation,"
    " c_mktsegment AS segment FROM customer)",
    "labelled": "labelled AS (SELECT s.*, o.label, o.severity FROM samples s JOIN outcomes o USING (entity_id)"
    " WHERE o.label IS NOT NULL)",
    "splits": f"splits AS (SELECT c_custkey AS entity_id, {split_expr('c_custkey')} AS split FROM customer)",
    "raw": f"raw AS (SELECT o_orderkey AS sample_id, CAST(year(o_orderdate) AS INTEGER) AS year, {RAW_ID} AS raw_id,"
    f" {CANDIDATE} AS candidate_name FROM orders)",
    "reg_a": f"reg_a AS (SELECT {CUSTOMER_KEY} AS entity_id FROM customer)",
    "reg_b": "reg_b AS (SELECT DISTINCT concat('C', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS entity_id FROM events)",
    "known": "known AS (SELECT entity_id, bool_or(a) AS in_a, bool_or(b) AS in_b FROM (SELECT entity_id, true AS a,"
    " false AS b FROM reg_a UNION ALL SELECT entity_id, false, true FROM reg_b) GROUP BY entity_id)",
    "names": f"names AS (SELECT name, min(entity_id) AS entity_id FROM (SELECT {name_of('c_custkey')} AS name,"
    f" {CUSTOMER_KEY} AS entity_id FROM customer) GROUP BY name HAVING count(DISTINCT entity_id) = 1)",
    "tried": "tried AS (SELECT raw.*, upper(trim(raw_id, ' ' || chr(9))) AS norm_id,"
    " translate(upper(trim(raw_id, ' ' || chr(9))), 'OILSB', '01158') AS fixed_id FROM raw)",
    "resolved": "resolved AS (SELECT t.sample_id, t.year, t.raw_id, t.candidate_name,"
    " CASE WHEN k.entity_id IS NOT NULL THEN t.norm_id WHEN f.entity_id IS NOT NULL THEN t.fixed_id"
    " ELSE n.entity_id END AS entity_id,"
    " CASE WHEN k.entity_id IS NOT NULL OR f.entity_id IS NOT NULL THEN 'patient_id'"
    " WHEN n.entity_id IS NOT NULL THEN 'name' END AS matched_by,"
    " CASE WHEN k.entity_id IS NULL AND f.entity_id IS NULL AND n.entity_id IS NOT NULL THEN t.candidate_name"
    " ELSE '' END AS matched_name,"
    " CASE WHEN k.entity_id IS NOT NULL THEN k.in_a WHEN f.entity_id IS NOT NULL THEN f.in_a"
    " ELSE coalesce(m.in_a, false) END AS in_a,"
    " CASE WHEN k.entity_id IS NOT NULL THEN k.in_b WHEN f.entity_id IS NOT NULL THEN f.in_b"
    " ELSE coalesce(m.in_b, false) END AS in_b,"
    " CASE WHEN k.entity_id IS NULL AND f.entity_id IS NOT NULL THEN 'normalized_from:' || t.norm_id ELSE '' END AS notes"
    " FROM tried t LEFT JOIN known k ON k.entity_id = t.norm_id"
    " LEFT JOIN known f ON f.entity_id = t.fixed_id AND t.fixed_id <> t.norm_id"
    " LEFT JOIN names n ON n.name = t.candidate_name LEFT JOIN known m ON m.entity_id = n.entity_id)",
}
RESOLVED = ("raw", "reg_a", "reg_b", "known", "names", "tried", "resolved")


def with_(*names: str) -> str:
    return "WITH " + ", ".join(CTE[n] for n in names) + " "


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_custkey").alias("entity_id"),
        F.year("o_orderdate").alias("year"),
        F.expr(f"cast({PROB} as double)").alias("prob"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity_id"),
        F.expr(f"cast({LABEL} as int)").alias("label"),
        F.expr(f"cast({SEVERITY} as int)").alias("severity"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    known = outcomes(spark, folder).where(F.col("label").isNotNull()).select("entity_id", "label", "severity")
    return samples(spark, folder).join(known, "entity_id")


def splits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.expr(split_expr("c_custkey")).alias("split")
    )


def raw_samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        F.year("o_orderdate").alias("year"),
        F.expr(RAW_ID).alias("raw_id"),
        F.expr(CANDIDATE).alias("candidate_name"),
    )


def registry_a(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.expr(CUSTOMER_KEY).alias("entity_id"))


def registry_b(spark: SparkSession, folder: str) -> DataFrame:
    key = F.expr("concat('C', lpad(cast(user_id as string), 6, '0'))").alias("entity_id")
    return table(spark, folder, "events").select(key).distinct()


def name_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.expr(name_of("c_custkey")).alias("name"), F.expr(CUSTOMER_KEY).alias("entity_id")
    )
