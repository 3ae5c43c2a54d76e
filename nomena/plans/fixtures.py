"""Linking inputs derived from the driver's tables: entities, their dated names, and mentions. SQL holds the same as CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity <= 4").select("l_partkey", "l_returnflag", F.year("l_shipdate").alias("y"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = _thin(spark, sf_dir).groupBy("l_partkey").agg(F.min("y").alias("birth_year"), F.max("y").alias("death_year"))
    d = table(spark, sf_dir, "part").join(years, F.col("p_partkey") == F.col("l_partkey"), "left")
    generation = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return d.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("source"), F.col("p_size").alias("size"), generation.alias("generation"), "birth_year", "death_year")


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _thin(spark, sf_dir).groupBy("l_partkey", "l_returnflag").agg(F.min("y").alias("start_year"), F.max("y").alias("end_year"))
    d = d.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    name = F.when(F.col("l_returnflag") == "R", F.concat_ws(" ", "p_brand", "p_type")).otherwise(F.col("p_name"))
    return d.select(F.col("p_partkey").alias("entity_id"), F.col("l_returnflag").alias("seg"), name.alias("name"), "start_year", "end_year")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx needs a total order over all mentions; it is made where rows are read in file order, here from the sort key."""
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return d.select(key.alias("sample_key"), F.col("p_name").alias("surface"), F.year("l_shipdate").alias("year"), F.col("l_partkey").alias("gold_id"), F.col("p_type").alias("type"), F.col("p_brand").alias("book"))


SQL = """thin AS (SELECT l_partkey, l_returnflag, CAST(year(l_shipdate) AS INT) AS y FROM lineitem WHERE l_quantity <= 4),
entities AS (SELECT p_partkey AS entity_id, p_name AS title, p_type AS category, p_brand AS source, p_size AS size,
  CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS INT) AS generation, birth_year, death_year
  FROM part LEFT JOIN (SELECT l_partkey, min(y) AS birth_year, max(y) AS death_year FROM thin GROUP BY 1) ON p_partkey = l_partkey),
periods AS (SELECT p_partkey AS entity_id, l_returnflag AS seg, CASE WHEN l_returnflag = 'R' THEN p_brand || ' ' || p_type ELSE p_name END AS name, start_year, end_year
  FROM (SELECT l_partkey, l_returnflag, min(y) AS start_year, max(y) AS end_year FROM thin GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey),
mentions AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sample_key, p_name AS surface, CAST(year(l_shipdate) AS INT) AS year, l_partkey AS gold_id, p_type AS type, p_brand AS book
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""
