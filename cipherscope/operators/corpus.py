"""Roll-ups over a corpus of projects, recall against ground truth, floors, integrity, and known-answer comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import local


def ecosystem_rollup(projects: DataFrame) -> DataFrame:
    """projects: ecosystem, status (scanned, unscannable, error), findings, audible, suppressed, seconds."""
    return projects.groupBy("ecosystem").agg(
        F.count("*").alias("projects"),
        F.count_if(F.col("status") == "unscannable").alias("not_scanned"),
        F.count_if(F.col("findings") > 0).alias("with_findings"),
        F.count_if(F.col("status") == "error").alias("errored"),
        F.sum("findings").alias("findings"),
        F.sum("audible").alias("audible"),
        F.sum("suppressed").alias("suppressed"),
        F.sum(F.col("seconds").cast("decimal(18,2)")).cast("double").alias("seconds"),
    )


def top_projects(projects: DataFrame, n: int = 10) -> DataFrame:
    return projects.orderBy(F.desc("findings"), "project").limit(n)


def durations(projects: DataFrame, cuts: int = 200) -> DataFrame:
    """One row: median, mean, 90th percentile (interpolated, exact) and largest seconds; nulls count nowhere.

    Values are dealt into ranges between approximate quantiles, and only the ranges that hold a wanted rank are ordered,
    as distinct values with their numbers: about a share 1 / cuts of them in one task.
    """
    s = projects.select(F.col("seconds").cast("double").alias("s")).where("s IS NOT NULL")
    n = s.count()
    if not n:
        return s.agg(*[F.max("s").alias(c) for c in ("median", "mean", "p90", "longest")])
    edges = sorted(set(s.approxQuantile("s", [i / cuts for i in range(1, cuts)], 0.25 / cuts)))
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("s")))
    values = s.groupBy("s").count().withColumn("place", place)
    sizes = dict(values.groupBy("place").agg(F.sum("count")).collect())  # at most cuts rows
    before, at = {}, 0
    for p in sorted(sizes):
        before[p], at = at, at + sizes[p]
    ranks = {q: (int(q * (n - 1)), min(n - 1, int(q * (n - 1)) + 1), q * (n - 1) % 1) for q in (0.5, 0.9)}
    wanted = {max(p for p in before if before[p] <= r) for low, high, _ in ranks.values() for r in (low, high)}
    order = Window.partitionBy("place").orderBy("s")
    first = F.create_map(*[x for p in wanted for x in (F.lit(p), F.lit(before[p]))])[F.col("place")]
    ranked = values.where(F.col("place").isin(list(wanted))).withColumn("upto", first + F.sum("count").over(order))
    value = lambda r: F.min(F.when(F.col("upto") > r, F.col("s")))
    quantile = lambda q: F.round(value(ranks[q][0]) * (1 - ranks[q][2]) + value(ranks[q][1]) * ranks[q][2], 3)
    found = ranked.agg(quantile(0.5).alias("median"), quantile(0.9).alias("p90"))
    return s.agg(F.round(F.avg("s"), 3).alias("mean"), F.max("s").alias("longest")).join(F.broadcast(found)).select("median", "mean", "p90", "longest")


def shares(rollup: DataFrame) -> DataFrame:
    """One row of the headline: sums over all ecosystems, and whole percents of scanned projects with findings and of
    findings that are audible (null where there is nothing to divide by)."""
    sums = rollup.agg(*[F.sum(c).alias(c) for c in ("projects", "not_scanned", "with_findings", "findings", "audible")])
    percent = lambda a, b: F.expr(f"try_divide({a} * 100, {b})")
    scanned = "projects - not_scanned"
    return sums.select("*", F.round(percent("with_findings", f"({scanned})"), 1).alias("pct_with_findings"), F.round(percent("audible", "findings"), 1).alias("pct_audible"))


def below_floor(actual: DataFrame, floors: DataFrame) -> DataFrame:
    """Floors that are not reached. actual: scope, key, n; floors: scope, key, least. What is absent counts 0."""
    found = floors.join(actual, ["scope", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.where(F.col("n") < F.col("least")).select("scope", "key", "least", "n")


#: States of a project's checkout, worst first; the last two pass.
STATES = ["absent", "empty", "unpinnable", "scope-missing", "off-sha", "drift", "unscannable", "ok"]


def integrity(projects: DataFrame, baseline: DataFrame) -> DataFrame:
    """project and its state: ok, or what the first check that fails says.

    projects: project, cloned, unscannable (a reason or null), tracked (files under version control), pin (or null),
    pin_known, missing_scopes (declared paths that are not there), head, files, bytes; baseline: project, files, bytes. A
    project without a row of the baseline has drifted, as has one with other numbers.
    """
    b = baseline.select("project", F.col("files").alias("b_files"), F.col("bytes").alias("b_bytes"), F.lit(True).alias("recorded"))
    same = F.col("recorded").isNotNull() & (F.col("files") == F.col("b_files")) & (F.col("bytes") == F.col("b_bytes"))
    pinned = F.coalesce("pin", F.lit("")) != ""
    state = (
        F.when(~F.coalesce("cloned", F.lit(False)), "absent")
        .when(F.coalesce("unscannable", F.lit("")) != "", "unscannable")
        .when(F.coalesce("tracked", F.lit(0)) == 0, "empty")
        .when(pinned & ~F.coalesce("pin_known", F.lit(False)), "unpinnable")
        .when(F.coalesce("missing_scopes", F.lit(0)) > 0, "scope-missing")
        .when(pinned & ~F.coalesce(F.col("head") == F.col("pin"), F.lit(False)), "off-sha")
        .when(~F.coalesce(same, F.lit(False)), "drift")
        .otherwise("ok")
    )
    return projects.join(b, "project", "left").select("project", state.alias("state"))


def worst_state(found: DataFrame) -> DataFrame:
    """One row: the worst state of all projects, and how many do not pass."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    return found.agg(F.min_by("state", rank).alias("worst"), F.count_if(~F.col("state").isin("unscannable", "ok")).alias("failing"))


def hits(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Ground truth that a finding meets (semi join)."""
    return truth.join(found.select(*keys).distinct(), keys, "left_semi")


def misses(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return truth.join(found.select(*keys).distinct(), keys, "left_anti")


def recall_by(truth: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by..., expected, hit, and recall in whole per mille (0 where nothing is expected)."""
    seen = found.select(*keys).distinct().withColumn("_hit", F.lit(1))
    out = truth.join(seen, keys, "left").groupBy(*by).agg(F.count("*").alias("expected"), F.count("_hit").alias("hit"))
    return out.withColumn("recall_pm", F.expr("hit * 1000 div expected"))


def family_recall(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Each expected place with whether any family found there is among the expected ones (arrays ``families``)."""
    there = found.groupBy(*keys).agg(F.collect_set("family").alias("found_families"))
    hit = F.coalesce(F.arrays_overlap("families", "found_families"), F.lit(False))
    return truth.join(there, keys, "left").select(*keys, hit.alias("hit"))


def in_scope(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """Files at or below a scope path of their project. Scopes are exploded prefixes, so the join is by key."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    wide = files.withColumn("scope", F.explode(prefixes))
    return wide.join(scopes.select("project", "scope").distinct(), ["project", "scope"], "left_semi").drop("scope").distinct()


def _same(expected: Column, got: Column) -> Column:
    return F.lower(expected) == F.lower(F.coalesce(got, F.lit("")))


def kat_groups(answers: DataFrame) -> DataFrame:
    """Per test group: total, passed, failed (a missing candidate fails), and whether it passes. answers: tg, tc, expected, got."""
    ok = _same(F.col("expected"), F.col("got"))
    return answers.groupBy("tg").agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed")).withColumn("passes", F.col("failed") == 0)


def kat_failures(answers: DataFrame) -> DataFrame:
    return answers.where(~_same(F.col("expected"), F.col("got"))).select("tg", "tc", "field", "expected", F.coalesce("got", F.lit("")).alias("got"))


def kat_verdicts(answers: DataFrame) -> DataFrame:
    """Signature verification: booleans compared; a missing verdict is wrong. answers: tg, tc, expected, got."""
    got = F.coalesce("got", ~F.col("expected"))
    return answers.select("tg", "tc", (got == F.col("expected")).alias("ok"))


#: Algorithm, parameter set, mode that have known answers.
KAT_MODES = [
    ("ML-KEM", "ML-KEM-512", "keyGen"), ("ML-KEM", "ML-KEM-768", "encapDecap"), ("ML-KEM", "ML-KEM-1024", "keyGen"),
    ("ML-DSA", "ML-DSA-44", "keyGen"), ("ML-DSA", "ML-DSA-65", "sigGen"), ("ML-DSA", "ML-DSA-87", "sigVer"),
    ("SLH-DSA", "SLH-DSA-SHAKE-128s", "keyGen"), ("SLH-DSA", "SLH-DSA-SHAKE-128s", "sigGen"),
]


def kat_supported(answers: DataFrame) -> DataFrame:
    """Adds ``supported``: whether algorithm, parameter_set and mode (null: keyGen) have known answers."""
    dim = local(answers.sparkSession, [(*m, True) for m in KAT_MODES], "algorithm string, parameter_set string, mode string, supported boolean")
    wanted = answers.withColumn("mode", F.coalesce("mode", F.lit("keyGen")))
    return wanted.join(F.broadcast(dim), ["algorithm", "parameter_set", "mode"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def recall_by_tag(truth: DataFrame, found: DataFrame, keys: list[str], language: str, tags: str) -> DataFrame:
    """Expected and hit places a language and a tag of the array ``tags`` (a place counts once for each of its tags)."""
    seen = found.select(*keys).distinct().withColumn("_hit", F.lit(1))
    rows = truth.join(seen, keys, "left").select(F.col(language).alias("language"), F.explode(tags).alias("tag"), "_hit")
    return rows.groupBy("language", "tag").agg(F.count("*").alias("expected"), F.count("_hit").alias("hit"))


def precision(audited: DataFrame) -> DataFrame:
    """Per stratum: TP, FP and precision (verdicts DEPENDS left out), with the stratum's weight in the whole."""
    judged = audited.where(F.col("verdict").isin("TP", "FP"))
    out = judged.groupBy("stratum").agg(F.count_if(F.col("verdict") == "TP").alias("tp"), F.count("*").alias("n"))
    return out.withColumn("p", F.col("tp") / F.col("n"))


def weighted_precision(strata: DataFrame) -> DataFrame:
    """One row from stratum rows with weight w, p and n: the estimate and its standard error."""
    w, p, n = F.col("w"), F.col("p"), F.col("n")
    return strata.agg(F.sum(w * p).alias("estimate"), F.sqrt(F.sum(w * w * p * (1 - p) / n)).alias("error"))


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval."""
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half
