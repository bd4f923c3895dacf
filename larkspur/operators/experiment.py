"""A/B experiments: assignment and read-out."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.distributions import normal_p, student_p, t_test_power
from larkspur.functions.scalars import hash_order


def assign_variants(users: DataFrame, experiment: str, p: float = 0.5) -> DataFrame:
    """Adds variant: treatment for a share p of the users, by hash, so a user's variant never changes."""
    treated = hash_order(experiment, "user_id") % 10_000 < int(10_000 * p)
    return users.withColumn("variant", F.when(treated, "treatment").otherwise("control"))


def segment_population(features: DataFrame, segment: str) -> DataFrame:
    """The users of a segment with their checkout rate."""
    return features.filter(F.col("rfm_segment") == segment).select("user_id", "checkout_rate")


def variant_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, "variant").agg(F.count("*").alias("visitors"), F.sum("converted").alias("conversions"), F.avg("converted").alias("conversion_rate"))


def ab_statistics(rows: DataFrame, by: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """One row per group: both arms, lift, Welch's t and its degrees of freedom, unpooled z, and the difference's interval."""

    def arm(name: str) -> list:
        x = F.when(F.col("variant") == name, F.col("converted").cast("double"))
        return [F.count(x).alias(f"{name}_n"), F.avg(x).alias(f"{name}_rate"), F.var_samp(x).alias(f"{name}_var")]

    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    g = (rows.groupBy(*by) if by else rows).agg(*arm("control"), *arm("treatment"))
    n, m, p, q = F.col("control_n"), F.col("treatment_n"), F.col("control_rate"), F.col("treatment_rate")
    va, vb = F.col("control_var") / F.nullif(n, F.lit(0)), F.col("treatment_var") / F.nullif(m, F.lit(0))
    diff, se = q - p, F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + q * (1 - q) / F.nullif(m, F.lit(0)))
    none = F.lit(0.0)
    return g.select(
        *by, "control_n", "treatment_n", "control_rate", "treatment_rate", (diff / F.nullif(p, none)).alias("lift"),
        (diff / F.nullif(F.sqrt(va + vb), none)).alias("t_stat"), ((va + vb) * (va + vb) / F.nullif(va * va / F.nullif(n - 1, F.lit(0)) + vb * vb / F.nullif(m - 1, F.lit(0)), none)).alias("df"),
        (diff / F.nullif(se, none)).alias("z_stat"), (diff - z * se).alias("ci_lower"), (diff + z * se).alias("ci_upper"),
        (diff / F.nullif(F.sqrt((p * (1 - p) + q * (1 - q)) / 2), none)).alias("effect_size"),
    )


def ab_readout(rows: DataFrame, by: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """ab_statistics() with p values, post-hoc power (arms of the control's size) and the decision, all of them column expressions."""
    alpha = 1 - confidence
    tested = ab_statistics(rows, by, confidence).select(
        "*", student_p(F.col("t_stat"), F.col("df")).alias("t_p_value"), normal_p(F.col("z_stat")).alias("z_p_value"), t_test_power(F.col("effect_size"), F.col("control_n"), alpha).alias("power")
    )
    significant = F.coalesce(F.col("t_p_value") < alpha, F.lit(False))
    return tested.withColumn("significant", significant).withColumn("decision", F.when(F.col("significant") & (F.col("lift") > 0), "SHIP").otherwise("HOLD"))
