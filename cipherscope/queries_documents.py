"""Registered queries over document rows, corpora, known answers, dependencies and probes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from . import dims
from .functions.text import extension, split_groups
from .operators import aggregate, corpus, manifests, probes, query
from .plans import documents, validation
from .queries import BASE, FINDINGS, _list, _text, _values, findings, pick, read, register, scored
from .sources import files

# Written down once more for the SQL, so that a wrong constant on one side shows.
_RSA = "CASE bits WHEN 112 THEN '2048' WHEN 128 THEN '3072' WHEN 152 THEN '4096' WHEN 192 THEN '7680' WHEN 256 THEN '15360' END"
_ALG2 = "alg2 AS (SELECT * FROM " + _values([(a[0], a[4] if a[4] is not None else -1, a[5] if a[5] is not None else -1) for a in dims.algorithm_rows()], "id, bits, level") + ")"
_FUN = """CASE WHEN alg.primitive = 'signature' THEN 'sign,verify' WHEN alg.primitive = 'kem' THEN 'encapsulate,decapsulate,keygen' WHEN alg.primitive IN ('ae', 'block-cipher', 'stream-cipher', 'key-wrap') THEN 'encrypt,decrypt'
  WHEN alg.primitive = 'pke' THEN 'encrypt,decrypt,keygen' WHEN alg.primitive = 'key-agree' THEN 'keygen' WHEN alg.primitive IN ('hash', 'xof') THEN 'digest' WHEN alg.primitive = 'mac' THEN 'tag'
  WHEN alg.primitive = 'kdf' THEN 'keyderive' WHEN alg.primitive = 'drbg' THEN 'generate' END"""
_FAMILY = """CASE WHEN family IN ('FN-DSA', 'Hybrid-KEM', 'Hybrid-KEM-Draft', 'TLS', 'JWT', 'WebCrypto', 'JCA', 'Provider', 'RNG', 'Signature', 'PQC-candidate') THEN NULL
  WHEN family = 'RSA' THEN 'RSASSA-PKCS1' WHEN family IN ('X25519', 'X448', 'XDH') THEN 'ECDH' WHEN family = 'DH' THEN 'FFDH' ELSE family END"""
_REF = "'crypto/algorithm/' || alg.id || coalesce('@' || alg.oid, '')"
_LEVEL = "CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Medium' THEN 'warning' WHEN severity IN ('Low', 'Safe') THEN 'note' ELSE 'none' END"
_SECURITY = "CASE severity WHEN 'Critical' THEN '9.0' WHEN 'High' THEN '8.0' WHEN 'Medium' THEN '5.0' WHEN 'Low' THEN '3.0' WHEN 'Safe' THEN '3.0' END"


@register(
    f"""{BASE}, {_ALG2}, n AS (SELECT algorithm_id, count(*) AS occurrences FROM s GROUP BY 1)
SELECT algorithm_id, occurrences, {_REF} AS bom_ref, display_name AS name, alg.primitive, {_FAMILY} AS algorithm_family,
  CASE WHEN family = 'RSA' OR starts_with(family, 'RSASSA-') THEN CASE WHEN bits >= 0 THEN coalesce({_RSA}, CAST(bits AS VARCHAR)) END
    WHEN family = 'SHA-2' AND starts_with(alg.id, 'sha-') THEN substr(alg.id, 5) END AS parameter_set,
  CASE WHEN alg.primitive = 'combiner' THEN CASE WHEN quantum_status = 'PqcFinal' THEN 'encapsulate,decapsulate' ELSE 'other' END ELSE coalesce({_FUN}, '') END AS functions
FROM n JOIN alg ON n.algorithm_id = alg.id JOIN alg2 ON alg.id = alg2.id"""
)
def cbom_components(spark, sf_dir):
    return documents.components(findings(spark, sf_dir)).drop("classical_security_bits", "nist_quantum_security_level", "oid")


@register(f"{BASE} SELECT {_REF} AS bom_ref, seq, location, line, snippet AS additional_context FROM s JOIN alg ON s.algorithm_id = alg.id")
def cbom_occurrences(spark, sf_dir):
    return documents.occurrences(findings(spark, sf_dir))


@register(
    f"""{BASE}, {_ALG2}, n AS (SELECT DISTINCT algorithm_id FROM s), c AS (SELECT algorithm_id, {_REF} AS bom_ref, display_name, alg.primitive, {_FAMILY} AS fam, oid, bits, level,
  CASE WHEN family = 'RSA' OR starts_with(family, 'RSASSA-') THEN CASE WHEN bits >= 0 THEN coalesce({_RSA}, CAST(bits AS VARCHAR)) END WHEN family = 'SHA-2' AND starts_with(alg.id, 'sha-') THEN substr(alg.id, 5) END AS pset,
  CASE WHEN alg.primitive = 'combiner' THEN CASE WHEN quantum_status = 'PqcFinal' THEN 'encapsulate,decapsulate' ELSE 'other' END ELSE {_FUN} END AS fun
  FROM n JOIN alg ON n.algorithm_id = alg.id JOIN alg2 ON alg.id = alg2.id)
SELECT algorithm_id, '{{"type":"cryptographic-asset","bom-ref":' || to_json(bom_ref) || ',"name":' || to_json(display_name) || ',"cryptoProperties":{{"assetType":"algorithm","algorithmProperties":{{"primitive":' || to_json(primitive)
  || coalesce(',"algorithmFamily":' || to_json(fam), '') || coalesce(',"parameterSetIdentifier":' || to_json(pset), '') || coalesce(',"cryptoFunctions":["' || replace(fun, ',', '","') || '"]', '')
  || CASE WHEN bits >= 0 THEN ',"classicalSecurityLevel":' || bits ELSE '' END || CASE WHEN level >= 0 THEN ',"nistQuantumSecurityLevel":' || level ELSE '' END || '}}' || coalesce(',"oid":' || to_json(oid), '') || '}}}}' AS value FROM c"""
)
def cbom_json(spark, sf_dir):
    return documents.component_json(documents.components(findings(spark, sf_dir)))


@register(
    f"""{BASE}, r AS (SELECT rule_id, min(seq) AS first_seq FROM s GROUP BY 1)
SELECT r.rule_id, row_number() OVER (ORDER BY first_seq) - 1 AS rule_index, s.algorithm_id, coalesce(display_name, s.algorithm_id) || ' finding' AS short_description,
  message AS full_description, {_LEVEL} AS level, {_SECURITY} AS security_severity, coalesce(alg.quantum_status, '') AS quantum_status
FROM r JOIN s ON s.rule_id = r.rule_id AND s.seq = r.first_seq LEFT JOIN alg ON s.algorithm_id = alg.id"""
)
def sarif_rules(spark, sf_dir):
    return documents.sarif_rules(scored(spark, sf_dir))


@register(
    f"""{BASE}, r AS (SELECT rule_id, row_number() OVER (ORDER BY min(seq)) - 1 AS rule_index FROM s GROUP BY 1)
SELECT seq, s.rule_id, rule_index, {_LEVEL} AS level, message, location AS uri, coalesce(line, 1) AS start_line, nullif(trim(snippet), '') AS snippet,
  substr(sha256(s.rule_id || ':' || trim(snippet)), 1, 16) AS fingerprint, 'crypto/algorithm/' || s.algorithm_id || '@' || coalesce(alg.oid, s.algorithm_id) AS cbom_ref
FROM s JOIN r USING (rule_id) LEFT JOIN alg ON s.algorithm_id = alg.id"""
)
def sarif_results(spark, sf_dir):
    return documents.sarif_results(scored(spark, sf_dir))


@register(
    f"""{BASE} SELECT seq, '{{"rule_id":' || to_json(rule_id) || ',"algorithm_id":' || to_json(algorithm_id) || ',"location":' || to_json(location) || coalesce(',"line":' || line, '') || ',"message":' || to_json(message) || ',"severity":"' || coalesce(severity, 'Unscored') || '"'
  || coalesce(',"risk_score":{{"av":' || av || ',"uc":' || uc || ',"ds":' || ds || ',"ex":' || ex || ',"dc":' || dc || ',"total":' || total || '}}', '') || '}}' AS value FROM s"""
)
def finding_documents(spark, sf_dir):
    return documents.finding_json(scored(spark, sf_dir))


@register(f"""{BASE} SELECT seq, coalesce(severity, '?') || chr(9) || coalesce(CAST(total AS VARCHAR), '?') || chr(9) || rule_id || chr(9) || algorithm_id || chr(9) || location || coalesce(':' || CAST(line AS VARCHAR), '') || chr(9) || message AS value FROM s""")
def text_lines(spark, sf_dir):
    return documents.text_lines(scored(spark, sf_dir))


# Projects: a customer is a project, its region the ecosystem, its orders the findings.
_PROJECTS = """p AS (
  SELECT c_custkey AS project, r_name AS ecosystem, CASE WHEN count(o_orderkey) = 0 THEN 'unscannable' WHEN c_custkey % 23 = 0 THEN 'error' ELSE 'scanned' END AS status,
    count(o_orderkey) AS findings, count(o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS audible, count(o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS suppressed,
    round(coalesce(max(o_totalprice), 0), 2) AS seconds
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey
  GROUP BY c_custkey, r_name)"""


def projects(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    found = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    key = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(key).alias("findings"), F.count_if(key % 3 != 0).alias("audible"), F.count_if(key % 3 == 0).alias("suppressed"), F.max("o_totalprice").alias("most"))
    found = found.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["findings", "audible", "suppressed"])
    status = F.when(F.col("findings") == 0, "unscannable").when(F.col("c_custkey") % 23 == 0, "error").otherwise("scanned")
    return found.select(F.col("c_custkey").alias("project"), F.col("r_name").alias("ecosystem"), status.alias("status"), "findings", "audible", "suppressed", F.round(F.coalesce("most", F.lit(0.0)), 2).alias("seconds"))


@register(f"""WITH {_PROJECTS} SELECT ecosystem, count(*) AS projects, count(*) FILTER (WHERE status = 'unscannable') AS not_scanned, count(*) FILTER (WHERE findings > 0) AS with_findings,
  count(*) FILTER (WHERE status = 'error') AS errored, CAST(sum(findings) AS BIGINT) AS findings, CAST(sum(audible) AS BIGINT) AS audible, CAST(sum(suppressed) AS BIGINT) AS suppressed, CAST(sum(CAST(seconds AS DECIMAL(18,2))) AS DOUBLE) AS seconds FROM p GROUP BY 1""")
def ecosystem_rollup(spark, sf_dir):
    return corpus.ecosystem_rollup(projects(spark, sf_dir))


@register(f"WITH {_PROJECTS} SELECT project, ecosystem, status, findings, audible, suppressed, seconds FROM p ORDER BY findings DESC, project LIMIT 10")
def top_projects(spark, sf_dir):
    return corpus.top_projects(projects(spark, sf_dir))


@register(f"WITH {_PROJECTS} SELECT round(quantile_cont(seconds, 0.5), 3) AS median, round(avg(seconds), 3) AS mean, round(quantile_cont(seconds, 0.9), 3) AS p90, max(seconds) AS longest FROM p")
def duration_percentiles(spark, sf_dir):
    return corpus.durations(projects(spark, sf_dir))


@register(f"WITH {_PROJECTS}, a AS (SELECT ecosystem AS key, CAST(sum(findings) AS BIGINT) AS n FROM p GROUP BY 1), fl AS (SELECT r_name AS key, (SELECT count(*) FROM customer) * (r_regionkey + 1) // 2 AS least FROM region) SELECT 'ecosystem' AS scope, fl.key, least, coalesce(n, 0) AS n FROM fl LEFT JOIN a USING (key) WHERE coalesce(n, 0) < least")
def floors_missed(spark, sf_dir):
    actual = projects(spark, sf_dir).groupBy(F.lit("ecosystem").alias("scope"), F.col("ecosystem").alias("key")).agg(F.sum("findings").alias("n"))
    half = F.expr("n * (r_regionkey + 1) div 2").cast("long")
    least = read(spark, sf_dir, "region").join(read(spark, sf_dir, "customer").agg(F.count("*").alias("n"))).select(F.lit("ecosystem").alias("scope"), F.col("r_name").alias("key"), half.alias("least"))
    return corpus.below_floor(actual, least)


@register("""WITH o AS (SELECT o_custkey AS project, count(*) AS files, CAST(sum(o_orderkey) AS BIGINT) AS bytes FROM orders GROUP BY 1), p AS (SELECT c_custkey AS k, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes FROM customer LEFT JOIN o ON c_custkey = project)
SELECT k AS project, CASE WHEN k % 13 = 0 THEN 'absent' WHEN k % 17 = 0 THEN 'unscannable' WHEN files = 0 THEN 'empty' WHEN k % 7 = 0 THEN 'unpinnable' WHEN k % 11 = 0 THEN 'scope-missing'
  WHEN k % 5 = 0 THEN 'off-sha' WHEN k % 3 = 0 OR files % 4 = 0 OR bytes % 10 = 0 THEN 'drift' ELSE 'ok' END AS state FROM p""")
def integrity_state(spark, sf_dir):
    return corpus.integrity(*checkouts(spark, sf_dir))


def checkouts(spark, sf_dir):
    """Customers as projects whose orders are their files, and a baseline that lacks some and differs in others."""
    k = F.col("project")
    seen = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("files"), F.sum("o_orderkey").alias("bytes"))
    now = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project")).join(seen, "project", "left").na.fill(0, ["files", "bytes"])
    base = now.where(k % 3 != 0).select("project", (F.col("files") + F.when(F.col("files") % 4 == 0, 1).otherwise(0)).alias("files"), (F.col("bytes") - F.when(F.col("bytes") % 10 == 0, 1).otherwise(0)).alias("bytes"))
    pin = F.when(k % 2 == 0, "c0ffee").when((k % 7 == 0) | (k % 5 == 0), "c0ffee")
    now = now.select(
        "project", (k % 13 != 0).alias("cloned"), F.when(k % 17 == 0, "archived").alias("unscannable"), F.col("files").alias("tracked"), pin.alias("pin"),
        (k % 7 != 0).alias("pin_known"), (k % 11 == 0).cast("int").alias("missing_scopes"), F.when(k % 5 != 0, "c0ffee").otherwise("beef").alias("head"), "files", "bytes",
    )
    return now, base


@register("SELECT 'absent' AS worst, count(*) FILTER (WHERE c_custkey % 13 = 0 OR c_custkey % 17 <> 0 AND (o_custkey IS NULL OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR files % 4 = 0 OR bytes % 10 = 0)) AS failing FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS files, sum(o_orderkey) AS bytes FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def worst_integrity(spark, sf_dir):
    return corpus.worst_state(corpus.integrity(*checkouts(spark, sf_dir)))


@register(f"""WITH {_PROJECTS} SELECT count(*) AS projects, count(*) FILTER (WHERE status = 'unscannable') AS not_scanned, count(*) FILTER (WHERE findings > 0) AS with_findings, CAST(sum(findings) AS BIGINT) AS findings, CAST(sum(audible) AS BIGINT) AS audible,
  round(count(*) FILTER (WHERE findings > 0) * 100 / count(*) FILTER (WHERE status <> 'unscannable'), 1) AS pct_with_findings, round(sum(audible) * 100 / sum(findings), 1) AS pct_audible FROM p""")
def headline_shares(spark, sf_dir):
    return corpus.shares(corpus.ecosystem_rollup(projects(spark, sf_dir)))


# Ground truth: every third finding's place, shifted by a line for every seventh of those.
_TRUTH = "t AS (SELECT event_type AS kind, event_id, user_id, event_id % 1000 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS line FROM events WHERE event_id % 3 = 0), g AS (SELECT DISTINCT user_id, event_id % 1000 AS line FROM events)"


def truth(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    found = e.select("user_id", (i % 1000).alias("line"))
    return e.where(i % 3 == 0).select(F.col("event_type").alias("kind"), "event_id", "user_id", (i % 1000 + F.when(i % 7 == 0, 1).otherwise(0)).alias("line")), found


@register(f"WITH {_TRUTH} SELECT t.event_id, kind FROM t SEMI JOIN g ON t.user_id = g.user_id AND t.line = g.line")
def recall_semi(spark, sf_dir):
    t, g = truth(spark, sf_dir)
    return corpus.hits(t, g, ["user_id", "line"]).select("event_id", "kind")


@register(f"WITH {_TRUTH} SELECT t.event_id, kind FROM t ANTI JOIN g ON t.user_id = g.user_id AND t.line = g.line")
def recall_anti(spark, sf_dir):
    t, g = truth(spark, sf_dir)
    return corpus.misses(t, g, ["user_id", "line"]).select("event_id", "kind")


@register(f"WITH {_TRUTH} SELECT kind, count(*) AS expected, count(g.line) AS hit, count(g.line) * 1000 // count(*) AS recall_pm FROM t LEFT JOIN g ON t.user_id = g.user_id AND t.line = g.line GROUP BY 1")
def recall_by_kind(spark, sf_dir):
    t, g = truth(spark, sf_dir)
    return corpus.recall_by(t, g, ["user_id", "line"], ["kind"])


@register(f"""WITH {FINDINGS}, x AS (SELECT location, coalesce(line, -1) AS line, list(DISTINCT split_part(algorithm_id, '-', 1)) AS fam FROM f GROUP BY ALL)
SELECT f.seq, coalesce(list_has_any([split_part(algorithm_id, '-', 1), 'aes'], fam), false) AS hit FROM f LEFT JOIN x ON f.location = x.location AND coalesce(f.line, -1) + f.seq % 2 = x.line""")
def family_recall(spark, sf_dir):
    f = findings(spark, sf_dir).withColumn("place", F.coalesce("line", F.lit(-1)))
    head = F.substring_index("algorithm_id", "-", 1)
    there = f.select("location", F.col("place").alias("at"), head.alias("family"))
    want = f.select("seq", "location", (F.col("place") + F.col("seq") % 2).cast("int").alias("at"), F.array(head, F.lit("aes")).alias("families"))
    grouped = there.groupBy("location", "at").agg(F.collect_set("family").alias("found"))
    return want.join(grouped, ["location", "at"], "left").select("seq", F.coalesce(F.arrays_overlap("families", "found"), F.lit(False)).alias("hit"))


# Known answers: a line item is a test case, its return flag the group.
_KAT = "k AS (SELECT l_returnflag AS tg, l_orderkey * 10 + l_linenumber AS tc, 'ek' AS field, md5(CAST(l_partkey AS VARCHAR)) AS expected, CASE WHEN l_suppkey % 13 = 0 THEN NULL WHEN l_partkey % 50 = 1 THEN 'ff' ELSE upper(md5(CAST(l_partkey AS VARCHAR))) END AS got FROM lineitem)"


def known_answers(spark, sf_dir):
    want = F.md5(F.col("l_partkey").cast("string").cast("binary"))
    got = F.when(F.col("l_suppkey") % 13 == 0, None).when(F.col("l_partkey") % 50 == 1, "ff").otherwise(F.upper(want))
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tg"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tc"), F.lit("ek").alias("field"), want.alias("expected"), got.alias("got"))


@register(f"WITH {_KAT} SELECT tg, count(*) AS total, count(*) FILTER (WHERE lower(coalesce(got, '')) = expected) AS passed, count(*) FILTER (WHERE lower(coalesce(got, '')) <> expected) AS failed, count(*) FILTER (WHERE lower(coalesce(got, '')) <> expected) = 0 AS passes FROM k GROUP BY 1")
def kat_groups(spark, sf_dir):
    return corpus.kat_groups(known_answers(spark, sf_dir))


@register(f"WITH {_KAT} SELECT tg, tc, field, expected, coalesce(got, '') AS got FROM k WHERE lower(coalesce(got, '')) <> expected")
def kat_failures(spark, sf_dir):
    return corpus.kat_failures(known_answers(spark, sf_dir))


@register("SELECT l_returnflag AS tg, l_orderkey * 10 + l_linenumber AS tc, coalesce(CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_partkey % 2 = 0 END, NOT (l_partkey % 4 = 0)) = (l_partkey % 4 = 0) AS ok FROM lineitem")
def kat_sigver(spark, sf_dir):
    got = F.when(F.col("l_suppkey") % 13 == 0, None).otherwise(F.col("l_partkey") % 2 == 0)
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tg"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tc"), (F.col("l_partkey") % 4 == 0).alias("expected"), got.cast("boolean").alias("got"))
    return corpus.kat_verdicts(rows)


_MODES = ["ML-KEM|ML-KEM-512|keyGen", "ML-KEM|ML-KEM-768|keyGen", "ML-KEM|ML-KEM-768|encapDecap", "ML-KEM|ML-KEM-1024|", "ML-DSA|ML-DSA-44|keyGen", "ML-DSA|ML-DSA-65|sigGen", "ML-DSA|ML-DSA-65|sigVer", "ML-DSA|ML-DSA-87|sigVer", "SLH-DSA|SLH-DSA-SHAKE-128s|sigGen", "SLH-DSA|SLH-DSA-SHAKE-128s|sigVer", "FN-DSA|FN-DSA-512|keyGen"]


@register("SELECT l_orderkey * 10 + l_linenumber AS tc, ([true, false, true, true, true, true, false, true, true, false, false])[1 + l_partkey % 11] AS supported FROM lineitem")
def kat_dispatch(spark, sf_dir):
    parts = F.split(pick(_MODES, F.col("l_partkey") % 11), r"\|")
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tc"), parts[0].alias("algorithm"), parts[1].alias("parameter_set"), F.nullif(parts[2], F.lit("")).alias("mode"))
    return corpus.kat_supported(rows).select("tc", "supported")


@register(f"WITH {_TRUTH}, x AS (SELECT t.*, CASE WHEN event_id % 2 = 0 THEN ['kem', 'tls'] ELSE ['tls'] END AS tags FROM t), y AS (SELECT x.kind AS language, unnest(tags) AS tag, g.line AS hit FROM x LEFT JOIN g ON x.user_id = g.user_id AND x.line = g.line) SELECT language, tag, count(*) AS expected, count(hit) AS hit FROM y GROUP BY ALL")
def recall_by_tag(spark, sf_dir):
    t, g = truth(spark, sf_dir)
    t = t.withColumn("tags", F.when(F.col("event_id") % 2 == 0, F.array(F.lit("kem"), F.lit("tls"))).otherwise(F.array(F.lit("tls"))))
    return corpus.recall_by_tag(t, g, ["user_id", "line"], "kind", "tags")


# Requirements: a part is a line of a manifest that names a package of the catalogue.
_PACKAGES = ["cryptography", "pyjwt", "PyJWT", "pynacl", "requests", "pycrypto", "numpy"]
_SIGNS = ["==", ">=", "~=", "!=", "<"]
_LINE = f"({_list(_PACKAGES)})[1 + p_partkey % 7] || ({_list(_SIGNS)})[1 + p_size % 5] || CAST(p_size * 2 AS VARCHAR) || '.' || CAST(p_partkey % 3 AS VARCHAR) || '  # pinned'"


def requirement_lines(spark, sf_dir):
    n, k = F.col("p_size"), F.col("p_partkey")
    text = F.concat(pick(_PACKAGES, k % 7), pick(_SIGNS, n % 5), (n * 2).cast("string"), F.lit("."), (k % 3).cast("string"), F.lit("  # pinned"))
    return read(spark, sf_dir, "part").select(k.alias("part"), text.alias("content"))


@register(f"WITH r AS (SELECT p_partkey AS part, trim(regexp_replace({_LINE}, '#.*$', '')) AS t FROM part) SELECT part, trim(regexp_extract(t, '^([^=><~!]*)', 1)) AS name, trim(regexp_extract(t, '^[^=><~!]*[=><~!]+(.*)$', 1)) AS version FROM r")
def requirement_split(spark, sf_dir):
    name, version = manifests.requirement(F.col("content"))
    return requirement_lines(spark, sf_dir).select("part", name.alias("name"), version.alias("version"))


_CATALOGUE = "cat AS (SELECT * FROM " + _values([(r["ecosystem"], i, r["package_pattern"], r["algorithm_id"]) for i, r in enumerate(dims.rows("catalogue"))], "ecosystem, ord, pattern, algorithm_id") + ")"


@register(f"WITH {_CATALOGUE}, d AS (SELECT p_partkey AS part, ({_list(_PACKAGES)})[1 + p_partkey % 7] AS name FROM part), h AS (SELECT part, name, algorithm_id, row_number() OVER (PARTITION BY part ORDER BY ord) AS rn FROM d JOIN cat ON cat.ecosystem = 'Python' AND regexp_matches(name, pattern)) SELECT part, name, algorithm_id FROM h WHERE rn = 1")
def catalogue_join(spark, sf_dir):
    files = requirement_lines(spark, sf_dir).select(F.concat(F.lit("p/"), F.col("part").cast("string"), F.lit("/requirements.txt")).alias("path"), "content", "part")
    found = manifests.catalogue_matches(manifests.dependencies(files.select("path", "content")))
    return found.select(F.split("path", "/")[1].cast("long").alias("part"), "name", "algorithm_id")


@register("SELECT p_partkey AS part, 'cryptography' AS field, CAST(p_size * 2 AS VARCHAR) || '.' || CAST(p_partkey % 3 AS VARCHAR) AS version, 'ML-KEM and ML-DSA' AS unlocks FROM part WHERE p_partkey % 7 = 0 AND p_size % 5 IN (0, 1, 2) AND p_size * 2 >= 50")
def version_floor(spark, sf_dir):
    files = requirement_lines(spark, sf_dir).select(F.concat(F.lit("p/"), F.col("part").cast("string"), F.lit("/requirements.txt")).alias("path"), "content")
    found = manifests.cleared_floors(manifests.declared_versions(files))
    return found.select(F.split("path", "/")[1].cast("long").alias("part"), "field", "version", "unlocks")


_GROUPS = ["X25519", "P-256", "", "?SecP384r1MLKEM1024", "*X25519MLKEM768", "-MLKEM768", "DEFAULT"]


@register(f"WITH g AS (SELECT s_suppkey AS supplier, ({_list(_GROUPS)})[1 + s_suppkey % 7] || ':' || ({_list(_GROUPS)})[1 + s_suppkey % 5] || '/' || ({_list(_GROUPS)})[1 + s_suppkey % 3] AS t FROM supplier), x AS (SELECT supplier, unnest(regexp_split_to_array(t, '[/:]')) AS raw FROM g), y AS (SELECT supplier, regexp_replace(raw, '^[*?-]+', '') AS name FROM x) SELECT supplier, name, count(*) AS n FROM y WHERE name <> '' AND name <> 'DEFAULT' GROUP BY ALL")
def group_list_split(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat(pick(_GROUPS, k % 7), F.lit(":"), pick(_GROUPS, k % 5), F.lit("/"), pick(_GROUPS, k % 3))
    return read(spark, sf_dir, "supplier").select(k.alias("supplier"), F.explode(split_groups(text)).alias("name")).groupBy("supplier", "name").agg(F.count("*").alias("n"))


_OIDS = "o AS (SELECT * FROM " + _values([(i, r["oid"], r["algorithm_id"], r["determines"]) for i, r in enumerate(dims.rows("oids"))], "i, oid, algorithm_id, determines") + ")"


@register(f"WITH {_OIDS} SELECT l_orderkey * 10 + l_linenumber AS row_id, coalesce(o.algorithm_id, 'unknown') AS algorithm_id FROM lineitem LEFT JOIN o ON o.i = l_partkey % {len(dims.rows('oids')) + 3}")
def oid_resolve(spark, sf_dir):
    listed = [r["oid"] for r in dims.rows("oids")] + ["1.2.3", "2.5.4.3", "0.0"]
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), pick(listed, F.col("l_partkey") % len(listed)).alias("oid"))
    return rows.join(F.broadcast(dims.oids(spark)), "oid", "left").select("row_id", F.coalesce("algorithm_id", F.lit("unknown")).alias("algorithm_id"))


_G = "g AS (SELECT * FROM " + _values([(i, g[1], g[2], g[4]) for i, g in enumerate(dims.GROUPS)], "i, group_name, algorithm_id, legacy") + ")"


@register(f"""WITH {_G}, x AS (SELECT s_name || ':' || CAST(400 + s_suppkey AS VARCHAR) AS target, g.*, (s_suppkey + i) % 4 AS o FROM supplier CROSS JOIN g)
SELECT target, group_name, CASE WHEN o = 0 THEN CASE WHEN legacy THEN 'NET-100' ELSE 'NET-001' END WHEN o = 1 THEN 'NET-002' WHEN o = 2 THEN 'NET-003' ELSE 'NET-900' END AS rule_id,
  CASE WHEN o = 3 THEN '{probes.NOT_PROBED}' ELSE algorithm_id END AS algorithm_id, CASE WHEN o = 0 THEN 'key_establishment_ephemeral' ELSE 'unknown' END AS usage_context, CASE WHEN o IN (0, 2) THEN 'literal_arg' ELSE 'unknown' END AS confidence FROM x""")
def probe_outcomes(spark, sf_dir):
    k = F.col("s_suppkey")
    t = read(spark, sf_dir, "supplier").select(k, F.concat("s_name", F.lit(":"), (400 + k).cast("string")).alias("target"))
    names = F.explode(F.arrays_zip(F.array(*[F.lit(g[1]) for g in dims.GROUPS]).alias("n"), F.sequence(F.lit(0), F.lit(len(dims.GROUPS) - 1)).alias("i"))).alias("g")
    seen = t.select("target", k, names).select("target", F.col("g.n").alias("group_name"), ((k + F.col("g.i")) % 4).alias("o"))
    seen = seen.where("o < 3").select("target", "group_name", pick(["handshake", "failure", "rejected"], F.col("o")).alias("outcome"))
    return probes.findings(t.select("target"), seen).select("target", "group_name", "rule_id", "algorithm_id", "usage_context", "confidence")


@register("SELECT page_id, regexp_extract(t, '^(.*):[^:]*$', 1) AS host, CAST(nullif(regexp_extract(t, ':(\\d{1,5})$', 1), '') AS INTEGER) AS port FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || ':' || CASE WHEN starts_with(url, 'https') THEN '443' ELSE '80' END AS t FROM pages)")
def target_parse(spark, sf_dir):
    authority = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    text = F.concat(authority, F.lit(":"), F.when(F.col("url").startswith("https"), "443").otherwise("80"))
    host, port = probes.target(text)
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host"), port.alias("port"))


@register("SELECT event_id, 'scan of ' || event_type AS message FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY event_id LIMIT 20")
def warnings_topn(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = e.agg(F.min("event_type").alias("event_type"))
    return e.join(F.broadcast(kind), "event_type").orderBy("event_id").limit(20).select("event_id", F.concat(F.lit("scan of "), "event_type").alias("message"))


_NOTES = "notes AS (SELECT * FROM " + _values([(r["id"], r["notes"]) for r in dims.rows("algorithms")], "note_id, note") + ")"


@register(f"""{BASE}, {_NOTES}, b AS (SELECT id, display_name AS bn, fips AS bf FROM alg) SELECT seq, CASE WHEN alg.id IS NULL THEN 'Algorithm not in the catalogue; classification unavailable. Investigate manually.' ELSE concat_ws(' ', CASE alg.quantum_status
  WHEN 'BrokenClassically' THEN 'Classically broken — practical attacks exist today, independent of any quantum threat.'
  WHEN 'BrokenByShor' THEN 'Vulnerable to Shor''s algorithm; a cryptographically relevant quantum computer breaks this in polynomial time.'
  WHEN 'WeakenedByGrover' THEN 'Weakened under Grover''s algorithm; effective security halves against quantum search. Keep using only at sufficiently large parameters.'
  WHEN 'QuantumSafe' THEN 'Quantum-safe at the chosen parameters — Grover''s algorithm does not reduce security below acceptable levels.'
  WHEN 'PqcFinal' THEN 'NIST-final post-quantum algorithm; designed to resist both classical and quantum attacks.'
  WHEN 'PqcDraft' THEN 'Draft post-quantum algorithm; expected to be standardized but the specification may still change.' END, note, 'Recommended replacement: ' || bn || coalesce(' per ' || bf, '') || '.') END AS why
FROM s LEFT JOIN alg ON s.algorithm_id = alg.id LEFT JOIN notes ON note_id = alg.id LEFT JOIN b ON alg.replacement = b.id""")
def why_it_matters(spark, sf_dir):
    return aggregate.explained(scored(spark, sf_dir))


_BANDS = ["Critical", "High", "Medium", "Low", "Safe"]


@register(f"{BASE} SELECT count(*) AS total, {', '.join(f'CAST(round(count(*) FILTER (WHERE severity = {_text(b)}) * 100.0 / count(*)) AS BIGINT) AS pct_{b.lower()}' for b in _BANDS)} FROM s")
def rounded_percentages(spark, sf_dir):
    return aggregate.rounded_percentages(scored(spark, sf_dir))


@register(
    f"""{BASE} SELECT seq, '{{"ruleId":' || to_json(s.rule_id) || ',"ruleIndex":' || rule_index || ',"level":"' || {_LEVEL} || '","message":{{"text":' || to_json(message) || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(location)
  || ',"uriBaseId":"%SRCROOT%"}},"region":{{"startLine":' || coalesce(line, 1) || ',"snippet":{{"text":' || to_json(trim(snippet)) || '}}}}}}}}],"partialFingerprints":{{"primaryLocationLineHash":"' || substr(sha256(s.rule_id || ':' || trim(snippet)), 1, 16) || '"}}}}' AS value
FROM s JOIN (SELECT rule_id, row_number() OVER (ORDER BY min(seq)) - 1 AS rule_index FROM s GROUP BY 1) r USING (rule_id)"""
)
def sarif_json(spark, sf_dir):
    return documents.result_json(documents.sarif_results(scored(spark, sf_dir)))


@register("""SELECT event_id AS seq, '{"level":"warning","message":{"text":"cannot read ' || event_type || '"}' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"locations":[{"physicalLocation":{"artifactLocation":{"uri":"src/' || user_id || '.go","uriBaseId":"%SRCROOT%"}}}]' END || '}' AS value FROM events""")
def sarif_notifications(spark, sf_dir):
    path = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("src/"), F.col("user_id").cast("string"), F.lit(".go")))
    return documents.notification_json(read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), path.alias("path"), F.concat(F.lit("cannot read "), "event_type").alias("message")))


_COUNTS = " || ".join(f"',\"{b.lower()}\":' || count(*) FILTER (WHERE severity = '{b}')" for b in _BANDS)


@register(
    f"""{BASE}, a AS (SELECT algorithm_id, count(*) AS n, CASE max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 WHEN 'Safe' THEN 0 END) WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' WHEN 0 THEN 'Safe' ELSE 'Unscored' END AS worst FROM s GROUP BY 1)
SELECT '{{"scan_target":"src","timestamp":"2026-01-01T00:00:00Z","policy":"nist-default","totals":{{"findings":' || count(*) || {_COUNTS} || ',"unscored":' || count(*) FILTER (WHERE severity IS NULL) || ',"hndl_critical":' || count(*) FILTER (WHERE hndl_critical) || '}},"by_algorithm":['
  || (SELECT string_agg('{{"algorithm_id":"' || algorithm_id || '","count":' || n || ',"severity":"' || worst || '"}}', ',' ORDER BY n DESC, algorithm_id) FROM a) || ']}}' AS value FROM s"""
)
def summary_document(spark, sf_dir):
    found = scored(spark, sf_dir)
    return documents.summary_json(aggregate.distribution(found), aggregate.by_algorithm(found), "src", "2026-01-01T00:00:00Z", "nist-default")


@register(f"""{BASE}, {_ALG2} SELECT algorithm_id, 'level above 6' AS problem FROM s JOIN alg2 ON algorithm_id = alg2.id WHERE level + 4 > 6 GROUP BY 1
UNION ALL SELECT algorithm_id, 'no name' FROM s JOIN alg ON algorithm_id = alg.id WHERE starts_with(algorithm_id, 'rsa-') GROUP BY 1""")
def component_checks(spark, sf_dir):
    # Spoiled on purpose, so that there is something to find.
    found = documents.components(findings(spark, sf_dir))
    return documents.component_problems(found.withColumns({"nist_quantum_security_level": F.col("nist_quantum_security_level") + 4, "name": F.when(~F.col("algorithm_id").startswith("rsa-"), F.col("name"))}))


@register(f"{BASE} SELECT seq, rule_id, algorithm_id, total, severity FROM s WHERE seq > 400 ORDER BY seq LIMIT 500")
def page_by_key(spark, sf_dir):
    scan, last = query.decode_cursor(query.encode_cursor("scan:1", 400))
    assert scan == "scan:1"
    return query.page_after(scored(spark, sf_dir), last, 10_000).select("seq", "rule_id", "algorithm_id", "total", "severity")


@register(f"{BASE} SELECT algorithm_id, count(*) AS findings, count(DISTINCT location) AS files FROM s JOIN alg ON algorithm_id = alg.id WHERE contains(lower(display_name), 'ml-') OR contains(lower(algorithm_id), 'ml-') OR contains(lower(family), 'ml-') GROUP BY 1")
def inventory_search(spark, sf_dir):
    return query.search_inventory(aggregate.inventory(scored(spark, sf_dir)), "ML-").select("algorithm_id", "findings", "files")


@register(f"{BASE} SELECT seq, location, line FROM s WHERE algorithm_id = 'ml-kem-768'")
def findings_of_algorithm(spark, sf_dir):
    return query.of_algorithm(scored(spark, sf_dir), "ml-kem-768").select("seq", "location", "line")


@register("SELECT l_returnflag AS stratum, count(*) FILTER (WHERE l_partkey % 10 <> 0 AND l_suppkey % 4 <> 0) AS tp, count(*) FILTER (WHERE l_partkey % 10 <> 0) AS n, round(count(*) FILTER (WHERE l_partkey % 10 <> 0 AND l_suppkey % 4 <> 0) / count(*) FILTER (WHERE l_partkey % 10 <> 0), 9) AS p FROM lineitem GROUP BY 1")
def precision_by_stratum(spark, sf_dir):
    return corpus.precision(audited(spark, sf_dir)).withColumn("p", F.round("p", 9))


def audited(spark, sf_dir):
    verdict = F.when(F.col("l_partkey") % 10 == 0, "DEPENDS").when(F.col("l_suppkey") % 4 == 0, "FP").otherwise("TP")
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stratum"), verdict.alias("verdict"))


@register("""WITH s AS (SELECT l_returnflag, count(*) FILTER (WHERE l_partkey % 10 <> 0 AND l_suppkey % 4 <> 0) * 1.0 / count(*) FILTER (WHERE l_partkey % 10 <> 0) AS p, CAST(count(*) FILTER (WHERE l_partkey % 10 <> 0) AS DOUBLE) AS n FROM lineitem GROUP BY 1),
w AS (SELECT sum(n) AS m FROM s) SELECT round(sum(n / m * p), 9) AS estimate, round(sqrt(sum(n / m * (n / m) * p * (1 - p) / n)), 9) AS error FROM s, w""")
def weighted_precision(spark, sf_dir):
    strata = corpus.precision(audited(spark, sf_dir))
    whole = strata.agg(F.sum("n").alias("m"))
    found = corpus.weighted_precision(strata.join(F.broadcast(whole)).withColumn("w", F.col("n") / F.col("m")))
    return found.select(F.round("estimate", 9).alias("estimate"), F.round("error", 9).alias("error"))


@register("""WITH s AS (SELECT l_returnflag AS stratum, count(*) FILTER (WHERE l_partkey % 10 <> 0 AND l_suppkey % 4 <> 0) * 1.0 / count(*) FILTER (WHERE l_partkey % 10 <> 0) AS p, CAST(count(*) FILTER (WHERE l_partkey % 10 <> 0) AS DOUBLE) AS n FROM lineitem GROUP BY 1)
SELECT stratum, round((p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 9) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 9) AS high FROM s""")
def wilson_intervals(spark, sf_dir):
    low, high = corpus.wilson(F.col("p"), F.col("n"))
    return corpus.precision(audited(spark, sf_dir)).select("stratum", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@register("SELECT o_orderkey AS file, CASE WHEN o_orderkey % 4 = 0 THEN 'a/b' WHEN o_orderkey % 4 = 1 THEN 'a/bc' WHEN o_orderkey % 4 = 2 THEN 'a/b/c/d' ELSE 'x' END AS path FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 4 IN (0, 2) OR o_custkey % 2 = 1 AND o_orderkey % 4 = 3")
def files_in_scope(spark, sf_dir):
    paths = ["a/b", "a/bc", "a/b/c/d", "x"]
    seen = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("project"), pick(paths, F.col("o_orderkey") % 4).alias("path"))
    scopes = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.when(F.col("c_custkey") % 2 == 0, "a/b").otherwise("x").alias("scope"))
    return corpus.in_scope(seen, scopes).select("file", "path")


@register("SELECT rule_id, count(*) AS findings FROM (SELECT 'CRYPTO-' || CAST(100 + event_id % 900 AS VARCHAR) AS rule_id, event_id FROM events) WHERE event_id % 152 = 151 GROUP BY 1")
def dangling_rules(spark, sf_dir):
    """Rules of findings whose algorithm the table does not have."""
    known = dims.algorithms(spark).select(F.col("id").alias("algorithm_id"))
    return findings(spark, sf_dir).join(F.broadcast(known), "algorithm_id", "left_anti").groupBy("rule_id").agg(F.count("*").alias("findings"))


@register("SELECT p_partkey AS part, (['go', 'python', 'typescript', 'cpp', 'c', 'rust', 'csharp'])[1 + p_partkey % 9] AS lang FROM part WHERE p_partkey % 9 < 7")
def languages_of_files(spark, sf_dir):
    ends = ["a.go", "b.py", "c.test.tsx", "d.hxx", "e.h", "f.rs", "g.cs", "h.GO", "Makefile"]
    paths = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), extension(pick(ends, F.col("p_partkey") % 9)).alias("ext"))
    return paths.join(F.broadcast(dims.extensions(spark)), "ext").select("part", "lang")


@register("SELECT o_custkey % 5 AS project, token, label FROM orders JOIN (VALUES (0, 'python', 'Python (pypi)'), (1, 'javascript', 'Node.js (npm)'), (2, 'csharp', 'C# (.NET)'), (4, 'java', 'Java (gradle)')) AS v(i, token, label) ON o_custkey % 5 = i GROUP BY ALL")
def project_ecosystems(spark, sf_dir):
    kinds = ["/r/setup.py", "/r/a/package.json", "/r/a/App.csproj", "/r/a/b/go.mod", "/r/build.gradle"]
    project = F.col("o_custkey") % 5
    paths = read(spark, sf_dir, "orders").select(project.alias("project"), pick(kinds, project).alias("path"))
    found = None
    for i in range(5):
        own = files.ecosystems(paths.where(F.col("project") == i), "/r").select(F.lit(i).cast("long").alias("project"), "token", "label")
        found = own if found is None else found.unionByName(own)
    return found


@register("SELECT o_orderkey AS file, CASE o_orderkey % 3 WHEN 0 THEN 'src/' || o_custkey WHEN 1 THEN 'rel/x' END AS path FROM orders")
def relative_paths(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    path = F.when(k == 0, F.concat(F.lit("/work/p/src/"), F.col("o_custkey").cast("string"))).when(k == 1, "rel/x").otherwise("/etc/passwd")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), files.relative_path(path, "/work/p").alias("path"))


@register("SELECT o_orderkey AS scan, CAST(o_custkey AS BIGINT) AS line, 'rsa-' || o_custkey AS algorithm_id FROM orders UNION ALL SELECT o_orderkey, NULL, 'md5' FROM orders")
def inline_findings(spark, sf_dir):
    key = F.col("o_custkey").cast("string")
    text = F.concat(F.lit('[{"algorithm_id":"rsa-'), key, F.lit('","line":'), key, F.lit('},{"algorithm_id":"md5"}]'))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan"), text.alias("findings"))
    kept = rows.withColumn("both", F.transform(F.from_json("findings", "array<struct<algorithm_id: string, line: bigint>>"), lambda f: F.struct(F.col("scan"), f["algorithm_id"].alias("algorithm_id"), f["line"].alias("line"))))
    return files.inline_findings(kept.withColumn("json", F.to_json("both")), "json", "struct<scan: bigint, algorithm_id: string, line: bigint>")


#: The shape of a finding's document, for ``schema_problems``.
FINDING_SCHEMA = {
    "type": "object", "required": ["rule", "algorithm", "place", "message"], "additionalProperties": False,
    "properties": {
        "rule": {"type": "string", "pattern": "^CRYPTO-[0-9]{3}$"}, "algorithm": {"type": "string", "minLength": 1}, "message": {"type": "string", "minLength": 1},
        "place": {"$ref": "#/$defs/Place"}, "severity": {"enum": ["Critical", "High", "Medium", "Low", "Safe", None]}, "tags": {"type": "array", "items": {"type": "string"}},
    },
    "$defs": {"Place": {"type": "object", "required": ["path"], "properties": {"path": {"type": "string"}, "line": {"type": "integer", "minimum": 1}}}},
}
#: Documents by kind, {n} the key: all but the first two are spoiled.
_DOCUMENTS = [
    ('{"rule":"CRYPTO-00{d}","algorithm":"md5","place":{"path":"a","line":1{n}},"message":"m"}', []),
    ('{"rule":"CRYPTO-001","algorithm":"md5","place":{"path":"a"},"message":"m","severity":null,"tags":["x","{n}"]}', []),
    ('{"rule":"CRYPTO-{n}x","algorithm":"md5","place":{"path":"a","line":0},"message":"m"}', ['/rule: "CRYPTO-{n}x" does not match "^CRYPTO-[0-9]{3}$"', "/place/line: 0 is less than the minimum of 1"]),
    ('{"rule":"CRYPTO-001","algorithm":"","place":{"line":1},"extra":{n}}', [': "message" is a required property', '/algorithm: "" is shorter than 1 characters', '/place: "path" is a required property', ": Additional properties are not allowed ('extra' was unexpected)"]),
    ('{"rule":{n},"algorithm":"a","place":7,"message":"m"}', ['/rule: {n} is not of type "string"', '/place: 7 is not of type "object"']),
    ('{"rule":"CRYPTO-001","algorithm":"a","place":{"path":"a"},"message":"m","severity":"Odd{n}","tags":["a",{n}]}', ['/severity: "Odd{n}" is not one of ["Critical","High","Medium","Low","Safe",null]', '/tags/1: {n} is not of type "string"']),
    ("{n}", [': {n} is not of type "object"']),
    ('{"rule":{n}', [": not JSON"]),
]
_SAMPLES = ", ".join(f"({i}, {len(found)}, {_text(' | '.join(found[:3]))})" for i, (_, found) in enumerate(_DOCUMENTS))


@register(f"SELECT o_orderkey AS doc, n = 0 AS valid, CAST(n AS BIGINT) AS n_problems, replace(t, '{{n}}', CAST(o_orderkey AS VARCHAR)) AS samples FROM orders JOIN (VALUES {_SAMPLES}) v(i, n, t) ON o_orderkey % {len(_DOCUMENTS)} = i")
def schema_problems(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.replace(F.replace(pick([d for d, _ in _DOCUMENTS], k % len(_DOCUMENTS)), F.lit("{n}"), k.cast("string")), F.lit("{d}"), (k % 10).cast("string"))
    orders = read(spark, sf_dir, "orders").select(k.alias("doc"), text.alias("value"))
    return validation.validated(orders, FINDING_SCHEMA).drop("value")


def _shared(spark, name: str) -> str:
    """A new path in the folder that driver and executors share; on one machine a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register(f"{BASE} SELECT location, line, snippet AS context FROM s JOIN alg ON s.algorithm_id = alg.id")
def cbom_document(spark, sf_dir):
    # The document is one JSON text with an occurrence a line, so that it is also read in parts.
    path = documents.write_cbom(findings(spark, sf_dir), _shared(spark, "cbom"), "src", "2026-01-01T00:00:00Z")
    line = F.from_json(F.ltrim(F.col("value"), F.lit(",")), "location string, line int, additionalContext string")
    return spark.read.text(path).where(F.col("value").rlike('^,?[{]"location"')).select(line.alias("o")).select("o.location", "o.line", F.col("o.additionalContext").alias("context"))


@register(f"{BASE}, r AS (SELECT rule_id, row_number() OVER (ORDER BY min(seq)) - 1 AS rule_index FROM s GROUP BY 1) SELECT s.rule_id, rule_index, {_LEVEL} AS level, location AS uri, message FROM s JOIN r USING (rule_id)")
def sarif_document(spark, sf_dir):
    path = documents.write_sarif(scored(spark, sf_dir), _shared(spark, "sarif"))
    shape = "ruleId string, ruleIndex int, level string, message struct<text: string>, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>>>>"
    line = F.from_json(F.ltrim(F.col("value"), F.lit(",")), shape)
    rows = spark.read.text(path).where(F.col("value").rlike('^,?[{]"ruleId"')).select(line.alias("r"))
    return rows.select(F.col("r.ruleId").alias("rule_id"), F.col("r.ruleIndex").cast("long").alias("rule_index"), "r.level", F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"), F.col("r.message.text").alias("message"))
