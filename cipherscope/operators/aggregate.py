"""Roll-ups of scored findings. Counts are partial before the shuffle; groups are algorithms, rules or extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import SEVERITIES, algorithms, local, notes
from ..functions.text import extension
from .risk import lookup, rank

VULNERABLE = ("BrokenByShor", "BrokenClassically")
#: Quantum statuses from worst to best.
STATUS_ORDER = ["BrokenClassically", "BrokenByShor", "WeakenedByGrover", "PqcDraft", "QuantumSafe", "PqcFinal"]


def _is(severity: str) -> Column:
    return F.coalesce(F.col("severity") == severity, F.lit(False))


def label(of_rank: Column) -> Column:
    """The severity of a rank; NULL stays NULL."""
    return lookup({r: s for s, r in SEVERITIES}, of_rank)


def distribution(scored: DataFrame) -> DataFrame:
    """One row: total, each band, unscored, hndl."""
    bands = [F.count_if(_is(s)).alias(s.lower()) for s, _ in SEVERITIES]
    return scored.agg(F.count("*").alias("total"), *bands, F.count_if(F.col("severity").isNull()).alias("unscored"), F.count_if("hndl_critical").alias("hndl"))


def by_algorithm(scored: DataFrame) -> DataFrame:
    """algorithm_id, findings, worst severity (an unscored finding is never the worst)."""
    return scored.groupBy("algorithm_id").agg(F.count("*").alias("findings"), F.max(rank(F.col("severity"))).alias("worst_rank")).withColumn("worst", label(F.col("worst_rank"))).drop("worst_rank")


def ordered(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("findings"), "algorithm_id")


def percentages(scored: DataFrame) -> DataFrame:
    """Whole percents by integer division; unscored takes what is left, vulnerable is critical and high."""
    d = distribution(scored)
    share = lambda c: F.coalesce(F.expr(f"({c}) * 100 div nullif(total, 0)"), F.lit(0)).cast("long")
    d = d.select("total", *[share(s.lower()).alias(f"pct_{s.lower()}") for s, _ in SEVERITIES], share("critical + high").alias("pct_vulnerable"))
    known = sum((F.col(f"pct_{s.lower()}") for s, _ in SEVERITIES), F.lit(0))
    return d.withColumn("pct_unscored", F.when(F.col("total") > 0, 100 - known).otherwise(0).cast("long"))


def totals(scored: DataFrame) -> DataFrame:
    """Findings, files, algorithms, broken ones and harvestable ones, with a rounded percent (halves away from zero)."""
    dim = algorithms(scored.sparkSession).select(F.col("id").alias("algorithm_id"), "quantum_status")
    broken = F.coalesce(F.col("quantum_status").isin(*VULNERABLE), F.lit(False))
    out = scored.join(F.broadcast(dim), "algorithm_id", "left").agg(
        F.count("*").alias("findings"), F.countDistinct("location").alias("files"), F.countDistinct("algorithm_id").alias("algorithms"), F.count_if(broken).alias("quantum_vulnerable"), F.count_if("hndl_critical").alias("hndl")
    )
    return out.withColumn("pct_vulnerable", F.coalesce(F.round(F.col("quantum_vulnerable") * 100.0 / F.expr("nullif(findings, 0)")), F.lit(0)).cast("long"))


def inventory(scored: DataFrame) -> DataFrame:
    """Known algorithms: name, family, status, findings, distinct files, successor."""
    dim = algorithms(scored.sparkSession).select(F.col("id").alias("algorithm_id"), "display_name", "family", "quantum_status", "replacement")
    counts = scored.groupBy("algorithm_id").agg(F.count("*").alias("findings"), F.countDistinct("location").alias("files"))
    return counts.join(F.broadcast(dim), "algorithm_id")


def status_rank(status: Column) -> Column:
    return lookup({s: i for i, s in enumerate(STATUS_ORDER)}, status)


def ordered_inventory(found: DataFrame) -> DataFrame:
    return found.orderBy(status_rank(F.col("quantum_status")), F.desc("findings"), "algorithm_id")


def families(scored: DataFrame) -> DataFrame:
    """Families of known algorithms: members, findings, worst rank and the order by worst member, then name."""
    dim = algorithms(scored.sparkSession).select(F.col("id").alias("algorithm_id"), "family", "quantum_status")
    members = scored.groupBy("algorithm_id").agg(F.count("*").alias("findings")).join(F.broadcast(dim), "algorithm_id")
    names = F.array_join(F.array_sort(F.collect_list("algorithm_id")), ",")  # at most the dimension's rows
    return members.groupBy("family").agg(F.count("*").alias("algorithms"), F.sum("findings").alias("findings"), F.min(status_rank(F.col("quantum_status"))).alias("worst_status_rank"), names.alias("members"))


def top_algorithms(scored: DataFrame, n: int) -> DataFrame:
    """The n ids with most findings, of which those in the dimension stay (so fewer than n may come back)."""
    dim = algorithms(scored.sparkSession).select(F.col("id").alias("algorithm_id"), "display_name")
    top = scored.groupBy("algorithm_id").agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), "algorithm_id").limit(n)
    return top.join(F.broadcast(dim), "algorithm_id")


def by_extension(scored: DataFrame) -> DataFrame:
    ext = extension(F.col("location"))
    return scored.groupBy(F.when(ext == "", "?").otherwise(ext).alias("ext")).agg(F.count("*").alias("findings"))


def successors(spark) -> DataFrame:
    """Each algorithm with its successor's name and standard (self join of the dimension)."""
    a = algorithms(spark)
    b = a.select(F.col("id").alias("replacement"), F.col("display_name").alias("replacement_name"), F.col("fips").alias("replacement_fips"))
    return a.select("id", "quantum_status", "replacement").join(F.broadcast(b), "replacement", "left").select("id", "quantum_status", "replacement", "replacement_name", "replacement_fips")


def dangling(spark) -> DataFrame:
    """References from the dimensions and presets to algorithms that do not exist: must be empty."""
    from ..dims import catalogue, oids
    from ..policy import PRESETS

    a = algorithms(spark)
    refs = a.where("replacement IS NOT NULL").select(F.lit("replacement").alias("kind"), F.col("id").alias("source"), F.col("replacement").alias("algorithm_id"))
    refs = refs.unionByName(oids(spark).select(F.lit("oid").alias("kind"), F.col("oid").alias("source"), "algorithm_id"))
    refs = refs.unionByName(catalogue(spark).where("algorithm_id <> 'unknown'").select(F.lit("catalogue").alias("kind"), F.col("package_pattern").alias("source"), "algorithm_id"))
    listed = [("policy", name, x) for name, (_, values) in PRESETS.items() for x in values["disallowed"]]
    refs = refs.unionByName(local(spark, listed, "kind string, source string, algorithm_id string"))
    return refs.join(a.select(F.col("id").alias("algorithm_id")), "algorithm_id", "left_anti")


#: What a status means for a finding.
MEANING = {
    "BrokenClassically": "Classically broken — practical attacks exist today, independent of any quantum threat.",
    "BrokenByShor": "Vulnerable to Shor's algorithm; a cryptographically relevant quantum computer breaks this in polynomial time.",
    "WeakenedByGrover": "Weakened under Grover's algorithm; effective security halves against quantum search. Keep using only at sufficiently large parameters.",
    "QuantumSafe": "Quantum-safe at the chosen parameters — Grover's algorithm does not reduce security below acceptable levels.",
    "PqcFinal": "NIST-final post-quantum algorithm; designed to resist both classical and quantum attacks.",
    "PqcDraft": "Draft post-quantum algorithm; expected to be standardized but the specification may still change.",
}
#: Fixed value: what is said of an algorithm that the table does not have.
UNKNOWN = "Algorithm not in the catalogue; classification unavailable. Investigate manually."


def explained(scored: DataFrame) -> DataFrame:
    """seq and ``why``: what the algorithm's status means, the table's note on it, and what replaces it; UNKNOWN for
    algorithms that the table does not have."""
    spark = scored.sparkSession
    dim = successors(spark).join(F.broadcast(notes(spark)), "id").withColumnRenamed("id", "algorithm_id")
    standard = F.when(F.col("replacement_fips").isNotNull(), F.concat(F.lit(" per "), "replacement_fips")).otherwise("")
    instead = F.when(F.col("replacement_name").isNotNull(), F.concat(F.lit("Recommended replacement: "), "replacement_name", standard, F.lit(".")))
    why = F.when(F.col("quantum_status").isNotNull(), F.concat_ws(" ", lookup(MEANING, F.col("quantum_status")), F.nullif(F.trim("notes"), F.lit("")), instead)).otherwise(UNKNOWN)
    return scored.join(F.broadcast(dim), "algorithm_id", "left").select("seq", why.alias("why"))


def rounded_percentages(scored: DataFrame) -> DataFrame:
    """Percents of all findings by band, rounded to a whole number (halves away from zero); 0 where there are none."""
    d = distribution(scored)
    share = lambda c: F.coalesce(F.round(F.expr(f"try_divide({c} * 100.0D, total)")), F.lit(0.0)).cast("long")
    return d.select("total", *[share(s.lower()).alias(f"pct_{s.lower()}") for s, _ in SEVERITIES])
