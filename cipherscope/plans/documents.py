"""Document rows: CycloneDX components and occurrences, SARIF rules and results, and their JSON.

Documents stay relations of rows until they are written; a sink writes one file a partition, so no document of all
findings passes through one task.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import algorithms
from ..functions.text import fingerprint
from ..operators.risk import lookup

#: Families that a CycloneDX document names otherwise, and those that it has no name for.
FAMILY_NAMES = {"RSA": "RSASSA-PKCS1", "X25519": "ECDH", "X448": "ECDH", "XDH": "ECDH", "DH": "FFDH"}
UNNAMED_FAMILIES = ["FN-DSA", "Hybrid-KEM", "Hybrid-KEM-Draft", "TLS", "JWT", "WebCrypto", "JCA", "Provider", "RNG", "Signature", "PQC-candidate"]
#: Modulus of RSA by classical strength.
RSA_MODULUS = {112: "2048", 128: "3072", 152: "4096", 192: "7680", 256: "15360"}
#: What a primitive does.
FUNCTIONS = {
    "signature": "sign,verify", "kem": "encapsulate,decapsulate,keygen", "ae": "encrypt,decrypt", "pke": "encrypt,decrypt,keygen",
    "key-agree": "keygen", "hash": "digest", "mac": "tag", "kdf": "keyderive", "block-cipher": "encrypt,decrypt",
    "stream-cipher": "encrypt,decrypt", "drbg": "generate", "xof": "digest", "key-wrap": "encrypt,decrypt",
}
#: SARIF level and security severity of a band.
SARIF_LEVEL = {"Critical": "error", "High": "error", "Medium": "warning", "Low": "note", "Safe": "note"}
SARIF_SEVERITY = {"Critical": "9.0", "High": "8.0", "Medium": "5.0", "Low": "3.0", "Safe": "3.0"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def family_name(family: Column, version: str = "1.7") -> Column:
    """Only version 1.7 has the field."""
    if version != "1.7":
        return F.lit(None).cast("string")
    return F.when(~family.isin(UNNAMED_FAMILIES), F.coalesce(lookup(FAMILY_NAMES, family), family))


def parameter_set(algorithm_id: Column, family: Column, bits: Column) -> Column:
    rsa = (family == "RSA") | family.startswith("RSASSA-")
    sha = (family == "SHA-2") & algorithm_id.startswith("sha-")
    return F.when(rsa, F.coalesce(lookup(RSA_MODULUS, bits), bits.cast("string"))).when(sha, F.regexp_replace(algorithm_id, "^sha-", ""))


def functions_of(primitive: Column, status: Column) -> Column:
    """Comma-separated; empty where none is known."""
    combiner = F.when(status == "PqcFinal", "encapsulate,decapsulate").otherwise("other")
    return F.when(primitive == "combiner", combiner).otherwise(F.coalesce(lookup(FUNCTIONS, primitive), F.lit("")))


def component_ref(algorithm_id: Column, oid: Column) -> Column:
    return F.concat_ws("@", F.concat(F.lit("crypto/algorithm/"), algorithm_id), oid)


def components(findings: DataFrame, version: str = "1.7") -> DataFrame:
    """A row for each known algorithm found, with the number of its occurrences."""
    a = algorithms(findings.sparkSession)
    dim = a.select(
        F.col("id").alias("algorithm_id"),
        component_ref(F.col("id"), F.col("oid")).alias("bom_ref"),
        F.col("display_name").alias("name"),
        "primitive",
        family_name(F.col("family"), version).alias("algorithm_family"),
        parameter_set(F.col("id"), F.col("family"), F.col("classical_security_bits")).alias("parameter_set"),
        functions_of(F.col("primitive"), F.col("quantum_status")).alias("functions"),
        "classical_security_bits", "nist_quantum_security_level", "oid",
    )
    return findings.groupBy("algorithm_id").agg(F.count("*").alias("occurrences")).join(F.broadcast(dim), "algorithm_id")


def occurrences(findings: DataFrame) -> DataFrame:
    """A row for each finding of a known algorithm: bom_ref, seq, location, line, context."""
    dim = algorithms(findings.sparkSession).select(F.col("id").alias("algorithm_id"), component_ref(F.col("id"), F.col("oid")).alias("bom_ref"))
    return findings.join(F.broadcast(dim), "algorithm_id").select("bom_ref", "seq", "location", "line", F.col("snippet").alias("additional_context"))


def component_json(found: DataFrame) -> DataFrame:
    """One JSON line for each component; null fields are left out."""
    algorithm = F.struct(
        "primitive", F.col("algorithm_family").alias("algorithmFamily"), F.col("parameter_set").alias("parameterSetIdentifier"),
        F.when(F.col("functions") != "", F.split("functions", ",")).alias("cryptoFunctions"),
        F.col("classical_security_bits").alias("classicalSecurityLevel"), F.col("nist_quantum_security_level").alias("nistQuantumSecurityLevel"),
    )
    properties = F.struct(F.lit("algorithm").alias("assetType"), algorithm.alias("algorithmProperties"), "oid")
    return found.select("algorithm_id", F.to_json(F.struct(F.lit("cryptographic-asset").alias("type"), F.col("bom_ref").alias("bom-ref"), "name", properties.alias("cryptoProperties"))).alias("value"))


def sarif_rules(scored: DataFrame) -> DataFrame:
    """rule_id, rule_index (order of first appearance), and what the rule's first finding says of it."""
    dim = algorithms(scored.sparkSession).select(F.col("id").alias("algorithm_id"), "display_name", "quantum_status")
    first = scored.groupBy("rule_id").agg(F.min("seq").alias("first_seq"), F.min_by(F.struct("algorithm_id", "severity", "message"), "seq").alias("f"))
    first = first.select("rule_id", "first_seq", "f.*").join(F.broadcast(dim), "algorithm_id", "left")
    # Rules are as many as a rule pack has, so their order fits one task.
    from pyspark.sql import Window

    index = F.row_number().over(Window.orderBy("first_seq")) - 1
    return first.select(
        "rule_id", index.alias("rule_index"), "algorithm_id",
        F.concat(F.coalesce("display_name", "algorithm_id"), F.lit(" finding")).alias("short_description"),
        F.col("message").alias("full_description"),
        F.coalesce(lookup(SARIF_LEVEL, F.col("severity")), F.lit("none")).alias("level"),
        lookup(SARIF_SEVERITY, F.col("severity")).alias("security_severity"),
        F.coalesce("quantum_status", F.lit("")).alias("quantum_status"),
    )


def sarif_results(scored: DataFrame) -> DataFrame:
    """A row for each finding, joined to its rule's index."""
    dim = algorithms(scored.sparkSession).select(F.col("id").alias("algorithm_id"), "oid")
    rules = sarif_rules(scored).select("rule_id", "rule_index")
    found = scored.join(F.broadcast(dim), "algorithm_id", "left").join(rules, "rule_id")
    return found.select(
        "seq", "rule_id", "rule_index",
        F.coalesce(lookup(SARIF_LEVEL, F.col("severity")), F.lit("none")).alias("level"),
        "message", F.col("location").alias("uri"), F.coalesce("line", F.lit(1)).alias("start_line"),
        F.nullif(F.trim("snippet"), F.lit("")).alias("snippet"),
        fingerprint(F.col("rule_id"), F.col("snippet")).alias("fingerprint"),
        F.concat(F.lit("crypto/algorithm/"), "algorithm_id", F.lit("@"), F.coalesce("oid", "algorithm_id")).alias("cbom_ref"),
    )


def result_json(results: DataFrame) -> DataFrame:
    """One SARIF result a line."""
    region = F.struct(F.col("start_line").alias("startLine"), F.when(F.col("snippet").isNotNull(), F.struct(F.col("snippet").alias("text"))).alias("snippet"))
    place = F.struct(F.struct(F.struct("uri", F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    prints = F.struct(F.col("fingerprint").alias("primaryLocationLineHash"))
    row = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), prints.alias("partialFingerprints"))
    return results.select("seq", F.to_json(row).alias("value"))


def notification_json(warnings: DataFrame) -> DataFrame:
    """One SARIF tool notification a line, of warnings (seq, path, message); the place is left out where there is no path."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation")).alias("physicalLocation"))
    row = F.struct(F.lit("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.when(F.col("path").isNotNull(), F.array(place)).alias("locations"))
    return warnings.select("seq", F.to_json(row).alias("value"))


def summary_json(distribution: DataFrame, by_algorithm: DataFrame, target: str, timestamp: str, policy: str) -> DataFrame:
    """One row, the summary document: totals by band and the algorithms found, most findings first (as many as the
    algorithm table has ids)."""
    entry = F.struct("algorithm_id", F.col("findings").alias("count"), F.coalesce("worst", F.lit("Unscored")).alias("severity"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("findings")).alias("o"), F.col("algorithm_id").alias("i"), entry.alias("e"))))
    algorithms_ = by_algorithm.agg(F.transform(listed, lambda x: x["e"]).alias("by_algorithm"))
    totals = F.struct(F.col("total").alias("findings"), "critical", "high", "medium", "low", "safe", "unscored", F.col("hndl").alias("hndl_critical"))
    head = [F.lit(target).alias("scan_target"), F.lit(timestamp).alias("timestamp"), F.lit(policy).alias("policy")]
    return distribution.join(F.broadcast(algorithms_)).select(F.to_json(F.struct(*head, totals.alias("totals"), "by_algorithm")).alias("value"))


def finding_json(scored: DataFrame) -> DataFrame:
    """A finding with its score; an unscored one says so and has no score."""
    axes = F.struct("av", "uc", "ds", "ex", "dc", "total")
    row = F.struct("rule_id", "algorithm_id", "location", "line", "message", F.coalesce("severity", F.lit("Unscored")).alias("severity"), F.when(F.col("total").isNotNull(), axes).alias("risk_score"))
    return scored.select("seq", F.to_json(row).alias("value"))


def text_lines(scored: DataFrame) -> DataFrame:
    """A tab-separated line a finding, ``?`` where it is unscored."""
    shown = F.coalesce(F.col("total").cast("string"), F.lit("?"))
    where = F.concat_ws(":", "location", F.col("line").cast("string"))
    return scored.select("seq", F.concat_ws("\t", F.coalesce("severity", F.lit("?")), shown, "rule_id", "algorithm_id", where, "message").alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    """Writes the rows' ``value`` as text files, a line a row, in scan order inside each file."""
    order = "seq" if "seq" in rows.columns else rows.columns[0]
    rows.repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)


def write_document(parts: DataFrame, order: list[str], head: str, tail: str, path: str) -> str:
    """Writes one file: head, the ``value`` of all parts in order, tail, each on lines of its own. Returns its path.

    Parts are sorted by ranges and written by tasks; Spark's committer keeps one attempt of each. The parts' files are then
    streamed one after another into a file beside the target (on HDFS joined by the store itself), which takes the target's
    name at the end: a reader sees the whole document or none, and a run that is repeated begins anew. No task and no
    process holds more than a buffer of it."""
    spark = parts.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    target, work = Path(path), f"{path}.parts-{uuid.uuid4().hex}"
    store = target.getFileSystem(conf)
    parts.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(work)
    names = sorted(f.getPath().toString() for f in store.listStatus(Path(work)) if f.getPath().getName().startswith("part-") and f.getLen())
    whole = Path(f"{work}/whole")
    out = store.create(whole, True)
    try:
        out.write(bytearray(f"{head}\n".encode()))
        joined = store.getScheme() == "hdfs"
        for name in [] if joined else names:
            part = store.open(Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
        if not joined:
            out.write(bytearray(f"{tail}\n".encode()))
    finally:
        out.close()
    if joined:
        end = store.create(Path(f"{work}/end"), True)
        end.write(bytearray(f"{tail}\n".encode()))
        end.close()
        rest = spark.sparkContext._gateway.new_array(Path, len(names) + 1)
        for i, name in enumerate([*names, f"{work}/end"]):
            rest[i] = Path(name)
        store.concat(whole, rest)
    store.delete(target, False)
    if not store.rename(whole, target):
        raise OSError(f"{path}: cannot take its name")
    store.delete(Path(work), True)
    return path


def cbom_parts(findings: DataFrame, version: str = "1.7") -> DataFrame:
    """algorithm_id, seq, value: the components of one document with all their occurrences, in pieces of an occurrence each, so
    that a component that has most of the findings is in no row and in no task whole. ``seq`` is unique, as in a scan."""
    heads = component_json(components(findings, version)).select("algorithm_id", F.expr("substr(value, 1, length(value) - 1)").alias("head"))
    known = findings.join(F.broadcast(algorithms(findings.sparkSession).select(F.col("id").alias("algorithm_id"))), "algorithm_id", "left_semi")
    ends = known.groupBy("algorithm_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).join(heads, "algorithm_id")
    lowest = ends.agg(F.min("algorithm_id").alias("lowest"))
    ends = ends.join(F.broadcast(lowest))  # a row an algorithm of the table
    where = F.to_json(F.struct("location", "line", F.col("snippet").alias("additionalContext")))
    begins = F.concat(F.when(F.col("algorithm_id") == F.col("lowest"), "").otherwise(","), "head", F.lit(',"evidence":{"occurrences":[\n'))
    value = F.concat(F.when(F.col("seq") == F.col("first"), begins).otherwise(","), where, F.when(F.col("seq") == F.col("last"), "\n]}}").otherwise(""))
    return known.join(F.broadcast(ends), "algorithm_id").select("algorithm_id", "seq", value.alias("value"))


def write_cbom(findings: DataFrame, path: str, target: str, timestamp: str, version: str = "1.7") -> str:
    """One CycloneDX document: components by algorithm, occurrences in scan order."""
    meta = {"timestamp": timestamp, "component": {"type": "application", "name": target}}
    head = json.dumps({"bomFormat": "CycloneDX", "specVersion": version, "version": 1, "metadata": meta}, separators=(",", ":"))
    return write_document(cbom_parts(findings, version), ["algorithm_id", "seq"], head[:-1] + ',"components":[', "]}", path)


def write_sarif(scored: DataFrame, path: str, tool: str = "cipherscope") -> str:
    """One SARIF document: the rules found (as many as a rule pack has) in its head, results in scan order."""
    levels = F.struct(F.col("level").alias("level"))
    rule = F.struct(
        F.col("rule_id").alias("id"), F.struct(F.col("short_description").alias("text")).alias("shortDescription"), F.struct(F.col("full_description").alias("text")).alias("fullDescription"),
        levels.alias("defaultConfiguration"), F.when(F.col("security_severity").isNotNull(), F.struct(F.col("security_severity").alias("security-severity"))).alias("properties"),
    )
    rules = [r.value for r in sarif_rules(scored).orderBy("rule_index").select(F.to_json(rule).alias("value")).collect()]
    run = json.dumps({"name": tool}, separators=(",", ":"))[:-1] + ',"rules":[\n' + ",\n".join(rules) + "\n]}"
    head = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{run}}},"results":['
    results = sarif_results(scored)
    first = F.broadcast(results.agg(F.min("seq").alias("first")))
    lines = result_json(results).join(first).select("seq", F.concat(F.when(F.col("seq") == F.col("first"), "").otherwise(","), "value").alias("value"))
    return write_document(lines, ["seq"], head, "]}]}", path)


def write_by_project(rows: DataFrame, path: str) -> None:
    """Files of lines (project, seq, value) for each project, in scan order inside each file; a large project is split over
    several files by ranges of ``seq``."""
    rows.repartitionByRange("project", "seq").sortWithinPartitions("project", "seq").select("project", "value").write.mode("overwrite").partitionBy("project").text(path)


def component_problems(found: DataFrame) -> DataFrame:
    """algorithm_id and what is wrong with its component: no reference or name, an unknown primitive, a level above 6."""
    known = [*FUNCTIONS, "combiner", "other", "unknown"]
    checks = {
        "no bom-ref": ~F.coalesce("bom_ref", F.lit("")).startswith("crypto/algorithm/"),
        "no name": F.coalesce("name", F.lit("")) == "",
        "unknown primitive": F.col("primitive").isNotNull() & ~F.col("primitive").isin(known),
        "level above 6": F.coalesce("nist_quantum_security_level", F.lit(0)) > 6,
    }
    problems = F.filter(F.array(*[F.when(bad, F.lit(text)) for text, bad in checks.items()]), lambda x: x.isNotNull())
    return found.select("algorithm_id", F.explode(problems).alias("problem"))
