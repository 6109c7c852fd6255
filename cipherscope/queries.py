"""The registered queries of the cryptographic operators, each over the whole of its tables, and their SQL.

The tables hold no cryptographic text, so findings, dependencies, probes, projects and vectors are projections of them:
every row of a table becomes a row of the relation, by rules that Spark and the SQL state alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dims
from .functions.text import stable_id
from .operators import aggregate, query, risk
from .policy import Policy, preset

CONFIDENCES = ["literal_arg", "type_name", "variable", "string_table", "unknown"]
CONTEXTS = ["key_establishment_long_lived", "key_establishment_ephemeral", "data_at_rest_encryption", "signature_long_lived", "signature_ephemeral", "authentication_only", "hashing", "unknown"]
EXPOSURES = ["public_internet", "internal_service", "local_only"]
SHELF = ["ephemeral", "short", "medium", "long", "forever"]
ENDS = [".go", ".py", ".java", ".js", ".cpp", ".rs", ".cs", ".ts", ""]

NIST, CNSA = preset("nist-default"), preset("nsa-cnsa2")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(values: list[str], index) -> F.Column:
    return F.array(*map(F.lit, values))[index.cast("int")]


def algorithm_ids() -> list[str]:
    return sorted(a[0] for a in dims.algorithm_rows()) + ["unknown"]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    i, u = F.col("event_id"), F.col("user_id")
    ids = algorithm_ids()
    return e.select(
        i.alias("seq"),
        F.concat(F.lit("CRYPTO-"), (100 + i % 900).cast("string")).alias("rule_id"),
        pick(ids, i % len(ids)).alias("algorithm_id"),
        F.concat(F.lit("src/"), "event_type", F.lit("/u"), u.cast("string"), pick(ENDS, u % 9)).alias("location"),
        F.when(i % 17 != 0, (i % 1000).cast("int")).alias("line"),
        F.concat(F.lit("call "), "event_type", F.lit(" "), (i % 97).cast("string")).alias("snippet"),
        F.concat(F.lit("use of "), pick(ids, i % len(ids))).alias("message"),
        pick(CONFIDENCES, i % 5).alias("confidence"),
        pick(CONTEXTS, i % 8).alias("usage_context"),
        pick(EXPOSURES, u % 3).alias("exposure"),
        pick(SHELF, F.get_json_object("props", "$.k").cast("int") % 5).alias("shelf_life_bucket"),
    )


def scored(spark: SparkSession, sf_dir: str, policy: Policy = NIST) -> DataFrame:
    return risk.flag_harvestable(risk.score(findings(spark, sf_dir), policy), policy)


def _text(s: str | None) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(_text(x) if isinstance(x, str) or x is None else ("true" if x is True else "false" if x is False else str(x)) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


ALG = "alg AS (SELECT * FROM " + _values([(a[0], a[1], a[2], a[3], a[6], a[7], a[8], a[9]) for a in dims.algorithm_rows()], "id, display_name, family, primitive, quantum_status, replacement, fips, oid") + ")"
FINDINGS = f"""f AS (
  SELECT event_id AS seq, 'CRYPTO-' || CAST(100 + event_id % 900 AS VARCHAR) AS rule_id,
    ({_list(algorithm_ids())})[1 + event_id % {len(algorithm_ids())}] AS algorithm_id,
    'src/' || event_type || '/u' || CAST(user_id AS VARCHAR) || ({_list(ENDS)})[1 + user_id % 9] AS location,
    CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 1000 AS INTEGER) END AS line,
    'call ' || event_type || ' ' || CAST(event_id % 97 AS VARCHAR) AS snippet,
    'use of ' || ({_list(algorithm_ids())})[1 + event_id % {len(algorithm_ids())}] AS message,
    ({_list(CONFIDENCES)})[1 + event_id % 5] AS confidence, ({_list(CONTEXTS)})[1 + event_id % 8] AS usage_context,
    ({_list(EXPOSURES)})[1 + user_id % 3] AS exposure,
    ({_list(SHELF)})[1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 5] AS shelf_life_bucket
  FROM events)"""


#: What the presets say, written down once more for the SQL, so that a wrong weight on one side shows.
NIST_STATUS = "CASE alg.quantum_status WHEN 'BrokenClassically' THEN 40 WHEN 'BrokenByShor' THEN 40 WHEN 'WeakenedByGrover' THEN 15 WHEN 'PqcDraft' THEN 5 ELSE 0 END"
CNSA_BANNED = """algorithm_id IN ('aes-128-gcm', 'aes-128-cbc', 'aes-128-ecb', 'aes-192-gcm', 'aes-192-ecb', 'chacha20-poly1305', 'sha-256', 'sha3-256', 'ml-kem-512', 'ml-kem-768',
  'ml-dsa-44', 'ml-dsa-65', 'slh-dsa-unattributed', 'fn-dsa-512', 'fn-dsa-1024', 'hss', 'xmss-mt', 'x25519-mlkem768', 'secp256r1-mlkem768', 'x25519-kyber768-draft00')
  OR regexp_matches(algorithm_id, '^slh-dsa-(sha2|shake)-(128|192|256)[sf]$')"""
CNSA_STATUS = f"CASE WHEN {CNSA_BANNED} THEN 40 WHEN alg.quantum_status IN ('BrokenClassically', 'BrokenByShor', 'WeakenedByGrover', 'PqcDraft') THEN 40 ELSE 0 END"


def _scored_sql(policy: Policy, name: str = "s") -> str:
    status, shelf = (NIST_STATUS, "'medium', 'long'") if policy is NIST else (CNSA_STATUS, "'short', 'medium', 'long'")
    return f"""{name}_raw AS (
  SELECT f.*, alg.quantum_status, alg.id IS NOT NULL AS known, {status} AS r_av,
    CASE usage_context WHEN 'key_establishment_long_lived' THEN 25 WHEN 'key_establishment_ephemeral' THEN 15 WHEN 'data_at_rest_encryption' THEN 22 WHEN 'signature_long_lived' THEN 12
      WHEN 'signature_ephemeral' THEN 5 WHEN 'authentication_only' THEN 5 WHEN 'hashing' THEN 3 WHEN 'unknown' THEN 10 END AS r_uc,
    CASE shelf_life_bucket WHEN 'ephemeral' THEN 0 WHEN 'medium' THEN 10 WHEN 'long' THEN 15 ELSE 3 END AS r_ds,
    CASE exposure WHEN 'public_internet' THEN 10 WHEN 'internal_service' THEN 4 WHEN 'local_only' THEN 1 END AS r_ex,
    CASE confidence WHEN 'literal_arg' THEN 10 WHEN 'type_name' THEN 8 WHEN 'variable' THEN 5 WHEN 'string_table' THEN 2 WHEN 'unknown' THEN 3 END AS r_dc
  FROM f LEFT JOIN alg ON f.algorithm_id = alg.id
), {name}_axes AS (
  SELECT *, {', '.join(f"CASE WHEN known THEN CAST(CASE WHEN r_av = 0 THEN 0 ELSE r_{x} END AS INTEGER) END AS {x}" for x in ('av', 'uc', 'ds', 'ex', 'dc'))}
  FROM {name}_raw
), {name} AS (
  SELECT *, CASE WHEN known THEN least(100, av + uc + ds + ex + dc) END AS total,
    CASE WHEN av IS NULL THEN NULL WHEN av + uc + ds + ex + dc >= 75 THEN 'Critical' WHEN av + uc + ds + ex + dc >= 50 THEN 'High'
      WHEN av + uc + ds + ex + dc >= 25 THEN 'Medium' WHEN av + uc + ds + ex + dc >= 10 THEN 'Low' ELSE 'Safe' END AS severity,
    coalesce(quantum_status IN ('BrokenByShor', 'BrokenClassically') AND usage_context IN ('key_establishment_long_lived', 'key_establishment_ephemeral', 'data_at_rest_encryption')
      AND shelf_life_bucket IN ({shelf}), false) AS hndl_critical
  FROM {name}_axes)"""


BASE = f"WITH {ALG}, {FINDINGS}, {_scored_sql(NIST)}"
RANK = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 WHEN 'Safe' THEN 0 END"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


SCORES = ("seq", "rule_id", "algorithm_id", "total", "severity")


@register(f"{BASE} SELECT seq, rule_id, algorithm_id, total, severity, coalesce(total, 0) AS sort_total FROM s")
def risk_register(spark, sf_dir):
    found = scored(spark, sf_dir).select(*SCORES, F.coalesce("total", F.lit(0)).alias("sort_total"))
    return found.orderBy(F.desc("sort_total"), "seq")


@register(f"{BASE} SELECT seq, av, uc, ds, ex, dc, total FROM s")
def risk_axes(spark, sf_dir):
    return scored(spark, sf_dir).select("seq", "av", "uc", "ds", "ex", "dc", "total")


@register(f"WITH {ALG}, {FINDINGS}, {_scored_sql(CNSA)} SELECT seq, rule_id, algorithm_id, total, severity, hndl_critical FROM s")
def risk_cnsa(spark, sf_dir):
    return scored(spark, sf_dir, CNSA).select(*SCORES, "hndl_critical")


@register(f"{BASE} SELECT count(*) AS total, {', '.join(f'count(*) FILTER (WHERE severity = {_text(s)}) AS {s.lower()}' for s, _ in dims.SEVERITIES)}, count(*) FILTER (WHERE severity IS NULL) AS unscored, count(*) FILTER (WHERE hndl_critical) AS hndl FROM s")
def severity_distribution(spark, sf_dir):
    return aggregate.distribution(scored(spark, sf_dir))


@register(f"{BASE} SELECT seq, hndl_critical FROM s")
def hndl_flag(spark, sf_dir):
    return scored(spark, sf_dir).select("seq", "hndl_critical")


@register(f"WITH {ALG}, {FINDINGS}, {_scored_sql(NIST, 'a')}, {_scored_sql(CNSA, 'b')} SELECT 'nist-default' AS policy, seq, total, severity FROM a UNION ALL SELECT 'nsa-cnsa2', seq, total, severity FROM b")
def policy_compare(spark, sf_dir):
    return risk.compare_policies(findings(spark, sf_dir), NIST, CNSA).select("policy", "seq", "total", "severity")


def _suppressed_sql(policy: Policy) -> str:
    banned = "" if policy is NIST else f" AND NOT ({CNSA_BANNED})"
    return f"coalesce(quantum_status IN ('QuantumSafe', 'PqcFinal', 'PqcDraft'){banned}, false)"


@register(f"WITH {ALG}, {FINDINGS}, {_scored_sql(CNSA)} SELECT seq, algorithm_id, {_suppressed_sql(CNSA)} AS suppressed FROM s")
def audible_partition(spark, sf_dir):
    return risk.mark_suppressed(findings(spark, sf_dir), CNSA).select("seq", "algorithm_id", "suppressed")


@register(f"{BASE} SELECT count(*) FILTER (WHERE {RANK} >= 3) AS failing, count(*) FILTER (WHERE severity IS NULL) AS unscored, count(*) FILTER (WHERE {RANK} >= 3) > 0 AS tripped FROM s WHERE NOT {_suppressed_sql(NIST)}")
def ci_gate(spark, sf_dir):
    audible, _ = risk.partition(scored(spark, sf_dir), NIST)
    return risk.gate(audible, risk.threshold("high", NIST))


@register(f"{BASE} SELECT seq, rule_id, algorithm_id, total, severity FROM s WHERE algorithm_id = 'rsa-4096' AND hndl_critical")
def query_filter_exact(spark, sf_dir):
    return query.filter_findings(scored(spark, sf_dir), algorithm_id="rsa-4096", hndl=True).select(*SCORES)


@register(f"{BASE} SELECT seq, rule_id, algorithm_id, total, severity FROM s WHERE severity = 'High'")
def query_filter_severity(spark, sf_dir):
    return query.filter_findings(scored(spark, sf_dir), severity="high").select(*SCORES)


@register(f"{BASE} SELECT row_number() OVER (ORDER BY rule_id, seq) AS place, seq, rule_id FROM s")
def query_sort_rule(spark, sf_dir):
    # The sort is the verb; the place makes it visible to a comparison without order: ranks from per-rule counts, no single-task window.
    found = query.sort_findings(scored(spark, sf_dir), "ruleId").select("seq", "rule_id")
    counts = found.groupBy("rule_id").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("rule_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("rule_id").orderBy("seq"))
    return found.withColumn("own", own).join(before, "rule_id").select((F.col("before") + F.col("own")).alias("place"), "seq", "rule_id")


@register(f"{BASE} SELECT algorithm_id AS key, count(*) OVER (PARTITION BY algorithm_id) AS findings, seq, CAST(seq AS VARCHAR) AS id FROM s")
def query_group_algorithm(spark, sf_dir):
    return query.group_findings(scored(spark, sf_dir).withColumn("id", F.col("seq").cast("string")), "algorithmId")


@register(f"{BASE} SELECT seq, rule_id, algorithm_id, total, severity FROM s ORDER BY seq LIMIT 50 OFFSET 100")
def page_n(spark, sf_dir):
    return query.page(scored(spark, sf_dir), offset=100).select(*SCORES)


@register(f"{BASE} SELECT seq, rule_id, algorithm_id, total, severity FROM s WHERE contains(lower(rule_id), 'sha-2') OR contains(lower(algorithm_id), 'sha-2') OR contains(lower(location), 'sha-2') OR contains(lower(message), 'sha-2')")
def text_search(spark, sf_dir):
    return query.search(scored(spark, sf_dir), "SHA-2").select(*SCORES)


@register(f"{BASE} SELECT seq, severity FROM s WHERE severity IN ('Critical', 'Low') OR severity IS NULL")
def severity_toggles(spark, sf_dir):
    return query.toggled(scored(spark, sf_dir), ["Critical", "Low"], unscored=True).select("seq", "severity")


@register(f"{BASE} SELECT algorithm_id, count(*) AS findings, CASE max({RANK}) WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' WHEN 0 THEN 'Safe' END AS worst FROM s GROUP BY 1")
def summary_by_algorithm(spark, sf_dir):
    return aggregate.ordered(aggregate.by_algorithm(scored(spark, sf_dir)))


_PCT = ", ".join(f"count(*) FILTER (WHERE severity = {_text(s)}) * 100 // count(*) AS pct_{s.lower()}" for s, _ in dims.SEVERITIES)


@register(f"{BASE}, p AS (SELECT count(*) AS total, {_PCT}, count(*) FILTER (WHERE severity IN ('Critical', 'High')) * 100 // count(*) AS pct_vulnerable FROM s) SELECT *, 100 - pct_critical - pct_high - pct_medium - pct_low - pct_safe AS pct_unscored FROM p")
def html_percentages(spark, sf_dir):
    return aggregate.percentages(scored(spark, sf_dir))


@register(f"{BASE} SELECT count(*) AS findings, count(DISTINCT location) AS files, count(DISTINCT algorithm_id) AS algorithms, count(*) FILTER (WHERE quantum_status IN ('BrokenByShor', 'BrokenClassically')) AS quantum_vulnerable, count(*) FILTER (WHERE hndl_critical) AS hndl, CAST(round(count(*) FILTER (WHERE quantum_status IN ('BrokenByShor', 'BrokenClassically')) * 100.0 / count(*)) AS BIGINT) AS pct_vulnerable FROM s")
def kpi_totals(spark, sf_dir):
    return aggregate.totals(scored(spark, sf_dir))


@register(f"{BASE} SELECT s.algorithm_id, display_name, family, alg.quantum_status, replacement, count(*) AS findings, count(DISTINCT location) AS files FROM s JOIN alg ON s.algorithm_id = alg.id GROUP BY ALL")
def inventory(spark, sf_dir):
    return aggregate.ordered_inventory(aggregate.inventory(scored(spark, sf_dir)))


@register(f"{BASE}, m AS (SELECT algorithm_id, count(*) AS n FROM s GROUP BY 1) SELECT family, count(*) AS algorithms, CAST(sum(n) AS BIGINT) AS findings, min(CASE quantum_status WHEN 'BrokenClassically' THEN 0 WHEN 'BrokenByShor' THEN 1 WHEN 'WeakenedByGrover' THEN 2 WHEN 'PqcDraft' THEN 3 WHEN 'QuantumSafe' THEN 4 WHEN 'PqcFinal' THEN 5 END) AS worst_status_rank, string_agg(algorithm_id, ',' ORDER BY algorithm_id) AS members FROM m JOIN alg ON m.algorithm_id = alg.id GROUP BY 1")
def family_tree(spark, sf_dir):
    return aggregate.families(scored(spark, sf_dir))


@register(f"{BASE}, t AS (SELECT algorithm_id, count(*) AS findings FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT algorithm_id, findings, display_name FROM t JOIN alg ON t.algorithm_id = alg.id")
def top_algorithms(spark, sf_dir):
    return aggregate.top_algorithms(scored(spark, sf_dir), 10)


@register(f"{BASE} SELECT coalesce(nullif(regexp_extract(location, '\\.([^./]+)$', 1), ''), '?') AS ext, count(*) AS findings FROM s GROUP BY 1")
def ext_breakdown(spark, sf_dir):
    return aggregate.by_extension(scored(spark, sf_dir))


_BYTES = "list_transform(range(octet_length(encode(t))), lambda i: CAST('0x' || substr(hex(encode(t)), CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT))"
_FNV = f"'QPU-' || lpad(upper(to_hex(list_reduce(list_concat([2216829733::UBIGINT], {_BYTES}), lambda h, b: xor(h, b) * 435 % 4294967296))), 8, '0')"


@register(f"WITH {FINDINGS}, x AS (SELECT seq, rule_id || '|' || algorithm_id || '|' || location || '|' || coalesce(CAST(line AS VARCHAR), '') || '|' || snippet AS t FROM f) SELECT seq, {_FNV} AS id FROM x")
def stable_ids(spark, sf_dir):
    return findings(spark, sf_dir).select("seq", stable_id(*[F.col(c) for c in ("rule_id", "algorithm_id", "location", "line", "snippet")]).alias("id"))


@register(f"WITH {ALG} SELECT a.id, a.quantum_status, a.replacement, b.display_name AS replacement_name, b.fips AS replacement_fips, count(event_id) AS events FROM alg a LEFT JOIN alg b ON a.replacement = b.id LEFT JOIN events ON ({_list(algorithm_ids())})[1 + event_id % {len(algorithm_ids())}] = a.id GROUP BY ALL")
def algorithm_replacement(spark, sf_dir):
    seen = findings(spark, sf_dir).groupBy(F.col("algorithm_id").alias("id")).agg(F.count("*").alias("events"))
    return aggregate.successors(spark).join(seen, "id", "left").withColumn("events", F.coalesce("events", F.lit(0)))
