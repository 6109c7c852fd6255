"""Scoring of findings: five additive axes, severity bands, the harvest-now-decrypt-later flag, partition and gate.

A finding whose algorithm has no row in the dimension is unscored: its axes, total and severity are NULL, and no
operator turns that NULL into a band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import BUCKETS, SEVERITIES, algorithms, local
from ..policy import DEFAULT_BUCKET, Policy, weights

AXIS_COLUMNS = {"av": "algorithm_vulnerability", "uc": "usage_context", "ds": "data_shelf_life", "ex": "exposure", "dc": "detection_confidence"}
SAFE_STATUSES = ("QuantumSafe", "PqcFinal", "PqcDraft")


def lookup(values: dict, key: Column) -> Column:
    """The value of ``key`` in a small constant table, else NULL."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[key]


def rank(severity: Column) -> Column:
    """4 for Critical down to 0 for Safe; NULL stays NULL."""
    return lookup(dict(SEVERITIES), severity).cast("int")


def with_algorithm(findings: DataFrame, *columns: str) -> DataFrame:
    """Left join to the algorithm dimension (fixed, under 200 rows); adds ``known`` and the columns asked for."""
    dim = algorithms(findings.sparkSession).select(F.col("id").alias("algorithm_id"), F.lit(True).alias("known"), *columns)
    return findings.join(F.broadcast(dim), "algorithm_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def _bands(policy: Policy, total: Column) -> Column:
    out = F.lit("Safe")
    for name in ("low", "medium", "high", "critical"):
        out = F.when(total >= policy.bands[name], name.capitalize()).otherwise(out)
    return out


def score(findings: DataFrame, policy: Policy) -> DataFrame:
    """Adds av, uc, ds, ex, dc, total and severity. No vulnerability means no risk: then every axis is 0."""
    found = with_algorithm(findings, "quantum_status")
    cap = policy.caps
    status = F.coalesce(lookup(policy.algorithm_vulnerability, F.col("quantum_status")), F.lit(0))
    av = F.when(F.col("algorithm_id").isin(policy.disallowed), F.lit(cap["algorithm_vulnerability"])).otherwise(status) if policy.disallowed else status
    short = policy.data_shelf_life[DEFAULT_BUCKET]
    raw = {
        "av": av,
        "uc": lookup(policy.usage_context, F.col("usage_context")),
        "ds": F.coalesce(lookup(policy.data_shelf_life, F.col("shelf_life_bucket")), F.lit(short)),
        "ex": lookup(policy.exposure, F.col("exposure")),
        "dc": lookup(policy.detection_confidence, F.col("confidence")),
    }
    capped = {k: F.least(v, F.lit(cap[AXIS_COLUMNS[k]])).cast("int") for k, v in raw.items()}
    gated = {k: F.when(F.col("known"), F.when(capped["av"] == 0, F.lit(0)).otherwise(v)) for k, v in capped.items()}
    found = found.withColumns(gated)
    total = F.when(F.col("known"), F.least(F.lit(100), F.col("av") + F.col("uc") + F.col("ds") + F.col("ex") + F.col("dc")))
    return found.withColumn("total", total).withColumn("severity", F.when(F.col("total").isNotNull(), _bands(policy, F.col("total")))).drop("quantum_status", "known")


def flag_harvestable(findings: DataFrame, policy: Policy) -> DataFrame:
    """Sets hndl_critical: status and usage in the policy's lists, and data kept long enough."""
    found = with_algorithm(findings, "quantum_status")
    least = BUCKETS.index(policy.hndl_bucket)
    kept = F.coalesce(lookup({b: i for i, b in enumerate(BUCKETS)}, F.col("shelf_life_bucket")), F.lit(0))
    flag = F.col("quantum_status").isin(policy.hndl_status) & F.col("usage_context").isin(policy.hndl_context) & (kept >= least)
    return found.withColumn("hndl_critical", F.coalesce(flag, F.lit(False))).drop("quantum_status", "known")


def mark_suppressed(findings: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``suppressed``: quantum-safe inventory that the policy does not exclude. Unknown algorithms stay audible."""
    found = with_algorithm(findings, "quantum_status")
    hidden = F.col("quantum_status").isin(*SAFE_STATUSES) & ~F.col("algorithm_id").isin(policy.disallowed or [""])
    return found.withColumn("suppressed", F.coalesce(hidden, F.lit(False))).drop("quantum_status", "known")


def partition(findings: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(audible, suppressed): two filters of one marked relation."""
    marked = mark_suppressed(findings, policy)
    return marked.where("NOT suppressed").drop("suppressed"), marked.where("suppressed").drop("suppressed")


def threshold(name: str | None, policy: Policy) -> int | None:
    """Rank of a gate's threshold; ``policy`` and None ask the policy, ``none`` switches the gate off."""
    wanted = policy.fail_on if name in (None, "policy") else name
    if wanted == "none":
        return None
    ranks = {s.lower(): r for s, r in SEVERITIES}
    if wanted.lower() not in ranks:
        raise ValueError(f"unknown threshold {wanted}")
    return ranks[wanted.lower()]


def gate(scored: DataFrame, least: int | None) -> DataFrame:
    """One row: failing, unscored, and whether the gate trips. Unscored findings never trip it."""
    at = rank(F.col("severity"))
    failing = F.count_if(at >= least) if least is not None else F.lit(0).cast("long")
    return scored.agg(failing.alias("failing"), F.count_if(F.col("severity").isNull()).alias("unscored")).withColumn("tripped", F.col("failing") > 0)


def compare_policies(findings: DataFrame, *policies: Policy) -> DataFrame:
    """Each finding under each policy: the findings' columns, policy, and the scores.

    Weights come from the policies' long form, a map for each axis (a few dozen entries a policy, broadcast).
    """
    spark = findings.sparkSession
    long = weights(spark, *policies).groupBy("policy").pivot("axis", list(AXIS_COLUMNS.values())).agg(F.map_from_entries(F.collect_list(F.struct("key", "weight"))))
    long = long.withColumnsRenamed({axis: f"w_{k}" for k, axis in AXIS_COLUMNS.items()})
    rules = local(
        spark,
        [(p.name, p.caps["algorithm_vulnerability"], p.data_shelf_life[DEFAULT_BUCKET], list(p.disallowed), [p.bands[b] for b in ("critical", "high", "medium", "low")]) for p in policies],
        "policy string, full int, short int, disallowed array<string>, bands array<int>",
    )
    found = with_algorithm(findings, "quantum_status").withColumn("policy", F.explode(F.array(*[F.lit(p.name) for p in policies])))
    found = found.join(F.broadcast(long.join(rules, "policy")), "policy")
    raw = {
        "av": F.when(F.array_contains("disallowed", F.col("algorithm_id")), F.col("full")).otherwise(F.coalesce(F.col("w_av")[F.col("quantum_status")], F.lit(0))),
        "uc": F.col("w_uc")[F.col("usage_context")],
        "ds": F.coalesce(F.col("w_ds")[F.col("shelf_life_bucket")], F.col("short")),
        "ex": F.col("w_ex")[F.col("exposure")],
        "dc": F.col("w_dc")[F.col("confidence")],
    }
    found = found.withColumns({k: F.when(F.col("known"), F.when(raw["av"] == 0, F.lit(0)).otherwise(v)) for k, v in raw.items()})
    total = F.when(F.col("known"), F.least(F.lit(100), F.col("av") + F.col("uc") + F.col("ds") + F.col("ex") + F.col("dc")))
    found = found.withColumn("total", total)
    severity = F.lit("Safe")
    for i, name in reversed(list(enumerate(("Critical", "High", "Medium", "Low")))):
        severity = F.when(F.col("total") >= F.col("bands")[i], name).otherwise(severity)
    found = found.withColumn("severity", F.when(F.col("total").isNotNull(), severity))
    return found.drop("quantum_status", "known", "full", "short", "disallowed", "bands", *[f"w_{k}" for k in AXIS_COLUMNS])
