"""Registered queries over call sites: extraction from pages, classification of events as call sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import classify, extract, shapes
from .queries import _FNV, _list, pick, read, register

#: A small rule pack, enough to exercise order, predicates, contexts, imports and templates.
RULE_PACK = """
[[classify]]
id = "CRYPTO-001"
algorithm_id = "rsa-1024"
message = "RSA of {bits} bits"
when = { api = "^rsa\\\\.generate$", args = { bits = { lt = 2048 } } }
[[classify]]
id = "CRYPTO-002"
algorithm_id = "rsa-2048"
message = "RSA of exactly {bits} bits"
when = { api = "^rsa\\\\.generate$", args = { bits = 2048 } }
[[classify]]
id = "CRYPTO-003"
algorithm_id = "rsa-unattributed"
message = "RSA"
when = { api = "^rsa\\\\." }
[[classify]]
id = "CRYPTO-004"
algorithm_id = "md5"
message = "digest {name}"
when = { api = "^digest$", args = { name = { regex = "(?i)^md5" } } }
[[classify]]
id = "CRYPTO-005"
algorithm_id = "sha-1"
message = "digest {name} of {bits}"
when = { api = "^digest$", args = { name = "SHA-1" }, site_context = ["Call", "StringConstant"] }
[[classify]]
id = "CRYPTO-006"
algorithm_id = "aes-256-gcm"
message = "cipher"
when = { api = "^cipher$", imports = ["crypto/aes"] }
"""
_APIS = ["rsa.generate", "rsa.sign", "digest", "cipher", "other"]
_NAMES = ["md5", "MD5-x", "SHA-1", "sha-256"]
_CONTEXTS = ["Call", "MapEntry", "StringConstant"]


@register("SELECT page_id, 'track' AS callee, CAST(x AS BIGINT) AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, 'track\\((\\d+)\\)', 1)) AS x FROM pages)")
def callsite_extract_int(spark, sf_dir):
    scripts = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<script>(.*?)</script>"), 1), "\n")
    files = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("javascript").alias("lang"), scripts.alias("content"))
    sites = extract.call_sites(files).where("callee = 'track'")
    return sites.select(F.col("path").cast("long").alias("page_id"), "callee", extract.nth_integer(F.col("args"), 0).alias("value"))


def matches(spark, sf_dir):
    i = F.col("event_id")
    bits = ((1 + i % 4) * 1024).cast("long")
    value = lambda number, text: F.struct(number.alias("i"), text.alias("s"))
    none_i, none_s = F.lit(None).cast("long"), F.lit(None).cast("string")
    args = F.map_from_arrays(F.array(F.lit("bits"), F.lit("name")), F.array(value(bits, none_s), value(none_i, pick(_NAMES, i % 4))))
    return read(spark, sf_dir, "events").select(
        i.alias("match_id"), F.lit("go").alias("lang"), pick(_APIS, i % 5).alias("api"), args.alias("args"), pick(_CONTEXTS, i % 3).alias("site_context"),
        F.when(i % 7 == 0, F.array(F.lit("crypto/aes"), F.lit("fmt"))).otherwise(F.array(F.lit("fmt"))).alias("imports"),
    )


_M = f"m AS (SELECT event_id AS match_id, ({_list(_APIS)})[1 + event_id % 5] AS api, CAST((1 + event_id % 4) * 1024 AS BIGINT) AS bits, ({_list(_NAMES)})[1 + event_id % 4] AS name, ({_list(_CONTEXTS)})[1 + event_id % 3] AS ctx, event_id % 7 = 0 AS aes FROM events)"


@register(
    f"""WITH {_M}, c AS (SELECT *, CASE WHEN api = 'rsa.generate' AND bits < 2048 THEN 1 WHEN api = 'rsa.generate' AND bits = 2048 THEN 2 WHEN starts_with(api, 'rsa.') THEN 3
  WHEN api = 'digest' AND starts_with(lower(name), 'md5') THEN 4 WHEN api = 'digest' AND name = 'SHA-1' AND ctx IN ('Call', 'StringConstant') THEN 5 WHEN api = 'cipher' AND aes THEN 6 END AS r FROM m)
SELECT match_id, 'CRYPTO-00' || CAST(r AS VARCHAR) AS rule_id, (['rsa-1024', 'rsa-2048', 'rsa-unattributed', 'md5', 'sha-1', 'aes-256-gcm'])[r] AS algorithm_id,
  CASE r WHEN 1 THEN 'RSA of ' || CAST(bits AS VARCHAR) || ' bits' WHEN 2 THEN 'RSA of exactly ' || CAST(bits AS VARCHAR) || ' bits' WHEN 3 THEN 'RSA' WHEN 4 THEN 'digest ' || name
    WHEN 5 THEN 'digest ' || name || ' of ' || CAST(bits AS VARCHAR) WHEN 6 THEN 'cipher' END AS message
FROM c WHERE r IS NOT NULL"""
)
def classify_first_match(spark, sf_dir):
    return classify.classify(matches(spark, sf_dir), classify.from_toml(spark, "go", RULE_PACK))


@register(
    f"""WITH {_M}, c AS (SELECT *, CASE WHEN api = 'rsa.generate' AND bits < 2048 THEN 1 WHEN api = 'rsa.generate' AND bits = 2048 THEN 2 WHEN starts_with(api, 'rsa.') THEN 3
  WHEN api = 'digest' AND starts_with(lower(name), 'md5') THEN 4 WHEN api = 'digest' AND name = 'SHA-1' AND ctx IN ('Call', 'StringConstant') THEN 5 WHEN api = 'cipher' AND aes THEN 6 END AS r FROM m),
x AS (SELECT 'CRYPTO-00' || CAST(r AS VARCHAR) AS rule_id, (['rsa-1024', 'rsa-2048', 'rsa-unattributed', 'md5', 'sha-1', 'aes-256-gcm'])[r] AS algorithm_id, 'src/' || match_id || '.go' AS location, match_id FROM c WHERE r IS NOT NULL),
y AS (SELECT *, rule_id || '|' || algorithm_id || '|' || location || '|7|f' AS t FROM x)
SELECT {_FNV} AS id, rule_id, algorithm_id, location, 'literal_arg' AS confidence, 'unknown' AS usage_context, 'internal_service' AS exposure, 'short' AS shelf_life_bucket FROM y"""
)
def source_findings(spark, sf_dir):
    rows = matches(spark, sf_dir)
    places = rows.select("match_id", F.concat(F.lit("src/"), F.col("match_id").cast("string"), F.lit(".go")).alias("path"), F.lit(7).alias("line"), F.lit(0).alias("offset"), F.lit("f").alias("symbol"), F.lit("f()").alias("snippet"))
    found = classify.as_findings(classify.classify(rows, classify.from_toml(spark, "go", RULE_PACK)), places)
    return found.select("id", "rule_id", "algorithm_id", "location", "confidence", "usage_context", "exposure", "shelf_life_bucket")


_CURVES = ["X25519", "CurveP256", "X25519MLKEM768"]


@register(f"SELECT s_suppkey AS supplier, 'crypto/tls.Config.CurvePreferences' AS api, unnest([({_list(_CURVES)})[1 + s_suppkey % 3], ({_list(_CURVES)})[1 + (s_suppkey + 1) % 3]]) AS value FROM supplier UNION ALL SELECT s_suppkey, 'crypto/tls.Config.MinVersion', 'VersionTLS1' || CAST(s_suppkey % 4 AS VARCHAR) FROM supplier")
def listed_settings(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat(F.lit("&tls.Config{MinVersion: tls.VersionTLS1"), (k % 4).cast("string"), F.lit(",\n CurvePreferences: []tls.CurveID{tls."), pick(_CURVES, k % 3), F.lit(", tls."), pick(_CURVES, (k + 1) % 3), F.lit("}}"))
    files = read(spark, sf_dir, "supplier").select(k.cast("string").alias("path"), F.lit("go").alias("lang"), text.alias("content"))
    return shapes.listed_settings(files).select(F.col("path").cast("long").alias("supplier"), "api", "value")


@register("""WITH m AS (SELECT CASE WHEN event_id % 5 = 4 THEN 'CRYPTO-9' || CAST(event_id % 3 AS VARCHAR) ELSE 'CRYPTO-00' || CAST(1 + event_id % 6 AS VARCHAR) END AS rule_id FROM events)
SELECT rule_id, count(*) AS findings FROM m WHERE rule_id LIKE 'CRYPTO-9_' GROUP BY 1""")
def unknown_rules(spark, sf_dir):
    i = F.col("event_id")
    named = F.when(i % 5 == 4, F.concat(F.lit("CRYPTO-9"), (i % 3).cast("string"))).otherwise(F.concat(F.lit("CRYPTO-00"), (1 + i % 6).cast("string")))
    return classify.unknown_rules(read(spark, sf_dir, "events").select(named.alias("rule_id")), classify.from_toml(spark, "go", RULE_PACK))


@register("""SELECT site, word, depth FROM (SELECT event_id AS site, user_id % 7 AS w, event_id % 4 AS depth FROM events) JOIN (VALUES (0, 'md5'), (1, 'sha1'), (2, 'sha256'), (3, 'blake2b'), (4, 'sha3_256'), (5, 'sha512'), (6, 'sha384')) v(k, word) ON w = k""")
def nested_calls(spark, sf_dir):
    """The call of a library, however deep it stands in others, behind a method of the same name that is no call."""
    i, word = F.col("event_id"), pick(["md5", "sha1", "sha256", "blake2b", "sha3_256", "sha512", "sha384"], F.col("user_id") % 7)
    depth = (i % 4).cast("int")
    text = F.concat(F.lit("def "), word, F.lit("(x):  # hashlib."), word, F.lit("(x)\n    return "), F.repeat(F.lit("wrap(1, "), depth), F.lit("hashlib."), word, F.lit("(f'{x}')"), F.repeat(F.lit(")"), depth), F.lit("\n"))
    files = read(spark, sf_dir, "events").select(i.cast("string").alias("path"), F.lit("python").alias("lang"), text.alias("content"))
    found = extract.call_sites(files).where(F.col("callee").startswith("hashlib."))
    calls = F.size(F.filter("frames", lambda f: f == "call:wrap"))
    return found.select(F.col("path").cast("long").alias("site"), F.split_part("callee", F.lit("."), F.lit(2)).alias("word"), calls.alias("depth"))
