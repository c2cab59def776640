"""Twins of known age made of the given tables: one for each supplier and place in an order, its place as the field that a model leaves out."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import posterior, surrogate
from .registry import query, r6, table

ROUNDS, RATE = 20, 0.1


def twins(spark: SparkSession, sf: str) -> DataFrame:
    """(s_suppkey, field, age_h, y, x): age from a supplier's quantities, sizes from them and discounts, forcing from prices and taxes."""
    t = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.concat(F.lit("place "), F.col("l_linenumber").cast("string")).alias("field")).agg(
        F.avg(F.col("l_quantity").cast("double")).alias("d"), (F.avg(F.col("l_extendedprice").cast("double")) / 1000).alias("n"), F.avg(F.col("l_discount").cast("double")).alias("e"), F.avg(F.col("l_tax").cast("double")).alias("f"), F.max(F.col("l_discount").cast("double")).alias("w"), (F.count("*") % 3).alias("k"),
    )
    age = F.greatest(F.lit(0.25), F.least(F.lit(72.0), F.col("d") * 1.2))
    t = t.withColumn("age_h", age).withColumn("length_km", F.sqrt("age_h") * (1 + F.col("n") / 50)).withColumn("width_km", F.col("e") * 20).withColumn("area_km2", F.when(F.col("k") > 0, F.col("length_km") * F.col("width_km") * (0.5 + F.col("f") * 5)))
    t = t.withColumn("discharge_class", F.element_at(F.array(F.lit("chronic"), F.lit("acute"), F.lit("other")), (F.col("k") + 1).cast("int"))).withColumn("current", F.col("f") * 10).withColumn("wind", F.col("n") / 4).withColumn("strain", F.col("w") / 1e5)
    return surrogate.features(t).select("s_suppkey", "field", "age_h", F.log("age_h").alias("y"), "x")


@query("u28_twin_table", """WITH t AS (SELECT l_suppkey AS s_suppkey, 'place ' || l_linenumber AS field, avg(l_quantity::DOUBLE) AS d, avg(l_extendedprice::DOUBLE) / 1000 AS n, avg(l_discount::DOUBLE) AS e, avg(l_tax::DOUBLE) AS f, max(l_discount::DOUBLE) AS w, count(*) % 3 AS k FROM lineitem GROUP BY ALL),
a AS (SELECT *, greatest(0.25::DOUBLE, least(72::DOUBLE, d * 1.2::DOUBLE)) AS age_h FROM t), s AS (SELECT *, sqrt(age_h) * (1 + n / 50) AS l, e * 20 AS b FROM a), z AS (SELECT *, CASE WHEN k > 0 THEN l * b * (0.5::DOUBLE + f * 5) END AS area FROM s)
SELECT s_suppkey, field, round(age_h, 6) AS age_h, CASE WHEN b > 0 THEN round(ln(l), 6) END AS ln_length, CASE WHEN b > 0 THEN round(ln(b), 6) END AS ln_width, CASE WHEN b > 0 THEN round(ln(l / b), 6) END AS ln_aspect,
CASE WHEN b > 0 THEN round(ln(greatest(coalesce(nullif(area, 0), l * b), 0.0001::DOUBLE)), 6) END AS ln_area, CASE WHEN b > 0 THEN (k = 0)::INTEGER END AS chronic, CASE WHEN b > 0 THEN (k = 1)::INTEGER END AS acute,
CASE WHEN b > 0 THEN round(f * 10, 6) END AS current_ms, CASE WHEN b > 0 THEN round(n / 4, 6) END AS wind_ms, CASE WHEN b > 0 THEN round(ln(greatest(w / 100000, 0.000000001::DOUBLE)), 6) END AS ln_strain FROM z""")
def u28_twins(spark: SparkSession, sf: str) -> DataFrame:
    """Nine numbers of each twin that the surrogate learns from."""
    names = ["ln_length", "ln_width", "ln_aspect", "ln_area", "chronic", "acute", "current_ms", "wind_ms", "ln_strain"]
    return twins(spark, sf).select("s_suppkey", "field", r6("age_h").alias("age_h"), *(F.col("x")[j].cast("int").alias(n) if n in ("chronic", "acute") else r6(F.col("x")[j]).alias(n) for j, n in enumerate(names)))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    t = twins(spark, sf)
    return surrogate.predict(t, surrogate.fit(t, rounds=ROUNDS, rate=RATE), field="field")


@query("l25_quantile_surrogate")
def l25_surrogate(spark: SparkSession, sf: str) -> DataFrame:
    """Each twin's age between its quantiles, from trees that never saw its field."""
    return _judged(spark, sf).select("s_suppkey", "field", r6("age_h").alias("age_h"), *(r6(F.exp(F.col("q")[i])).alias(f"q{round(100 * q)}_h") for i, q in enumerate(surrogate.QUANTILES)))


@query("u28_left_out_fields")
def u28_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage, scores and error of each field by trees that never saw it."""
    judged = _judged(spark, sf).withColumn("twin", F.concat_ws("/", F.col("s_suppkey").cast("string"), "field"))
    e = surrogate.evaluate(judged, posterior.age_grid(spark), ["twin"])
    return e.select("field", "n", *(r6(c).alias(c) for c in ("coverage", "log_score", "log2_error", "prior_log_score")))
