"""Dimension tables: small, fixed, checked on load, and safe to broadcast (under 200 rows each)."""

from __future__ import annotations

import csv
from functools import cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Severities from worst to best, with their ranks.
SEVERITIES = [("Critical", 4), ("High", 3), ("Medium", 2), ("Low", 1), ("Safe", 0)]
#: Retention buckets in order.
BUCKETS = ["ephemeral", "short", "medium", "long"]
#: TLS key-exchange groups: codepoint, name, algorithm, can be probed, legacy.
GROUPS = [
    (0x001D, "X25519", "x25519", True, False),
    (0x0017, "secp256r1", "ecdh-p256", True, False),
    (0x0018, "secp384r1", "ecdh-p384", True, False),
    (0x0019, "secp521r1", "ecdh-p521", False, False),
    (0x11EC, "X25519MLKEM768", "x25519-mlkem768", False, False),
    (0x11EB, "SecP256r1MLKEM768", "secp256r1-mlkem768", False, False),
    (0x11ED, "SecP384r1MLKEM1024", "secp384r1-mlkem1024", False, False),
    (0x0200, "MLKEM512", "ml-kem-512", False, False),
    (0x0201, "MLKEM768", "ml-kem-768", False, False),
    (0x0202, "MLKEM1024", "ml-kem-1024", False, False),
    (0x6399, "X25519Kyber768Draft00", "x25519-kyber768-draft00", False, True),
]
#: Manifest, field, least version, what it unlocks.
FLOORS = [
    ("go.mod", "go", 1, 24, "ML-KEM"),
    ("go.mod", "go", 1, 27, "ML-DSA"),
    ("pom.xml", "maven.compiler.release", 27, 0, "ML-KEM and ML-DSA"),
    ("requirements.txt", "cryptography", 50, 0, "ML-KEM and ML-DSA"),
]
#: File extensions and the language whose rules apply.
EXTENSIONS = [
    ("go", "go"), ("py", "python"), ("java", "java"), ("js", "javascript"), ("mjs", "javascript"), ("cjs", "javascript"),
    ("ts", "typescript"), ("tsx", "typescript"), ("mts", "typescript"), ("c", "c"), ("h", "c"), ("cpp", "cpp"), ("cc", "cpp"),
    ("cxx", "cpp"), ("hpp", "cpp"), ("hxx", "cpp"), ("rs", "rust"), ("cs", "csharp"),
]
#: Manifest file names and their ecosystems.
MANIFESTS = [("go.mod", "Go"), ("Cargo.toml", "Rust"), ("requirements.txt", "Python"), ("package.json", "JavaScript"), ("pom.xml", "Maven")]

ALGORITHM_SCHEMA = "id string, display_name string, family string, primitive string, classical_security_bits int, nist_quantum_security_level int, quantum_status string, replacement string, fips string, oid string"


_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def local(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    """A small table as a local relation: the plan holds its rows, no job makes them."""
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    columns = list(zip(*values)) or [()] * len(fields)
    return spark.createDataFrame(pa.table({n: pa.array(c, _TYPES[t]) for (n, t), c in zip(fields, columns)}))


@cache
def rows(name: str) -> list[dict]:
    """Rows of a packaged table; empty fields are None."""
    lines = (resources.files(__package__) / f"{name}.tsv").read_text(encoding="utf-8").splitlines()
    return [{k: v or None for k, v in r.items()} for r in csv.DictReader((x for x in lines if not x.startswith("#")), delimiter="\t", quoting=csv.QUOTE_NONE)]


@cache
def algorithm_rows() -> list[tuple]:
    out = []
    for r in rows("algorithms"):
        bits, level = (int(r[k]) if r[k] else None for k in ("classical_security_bits", "nist_quantum_security_level"))
        out.append((r["id"], r["display_name"], r["family"], r["primitive"], bits, level, r["quantum_status"], r["replacement"], r["fips"], r["oid"]))
    problems = algorithm_problems(out)
    if problems:
        raise ValueError("; ".join(problems))
    return out


def algorithm_problems(algorithms: list[tuple]) -> list[str]:
    """What is wrong with a table of algorithms: ids are unique, levels at most 6, a Shor-broken algorithm has a successor
    and level 0, a final PQC one its standard (but for hybrids), and successors exist."""
    ids, found = [a[0] for a in algorithms], []
    found += [f"{i} stands twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for i, _, family, _, _, level, status, successor, fips, _ in algorithms:
        if level is not None and level > 6:
            found.append(f"{i}: level {level}")
        if status == "BrokenByShor" and (successor is None or level not in (0, None)):
            found.append(f"{i}: broken without successor, or with a level")
        if status == "PqcFinal" and fips is None and family != "Hybrid-KEM":
            found.append(f"{i}: final without its standard")
        if successor is not None and successor not in ids:
            found.append(f"{i}: unknown successor {successor}")
    return found


def algorithms(spark: SparkSession) -> DataFrame:
    return local(spark, algorithm_rows(), ALGORITHM_SCHEMA)


def notes(spark: SparkSession) -> DataFrame:
    """id and what the table notes of an algorithm, if anything."""
    return local(spark, [(r["id"], r["notes"]) for r in rows("algorithms")], "id string, notes string")


def oids(spark: SparkSession) -> DataFrame:
    return local(spark, [(r["oid"], r["algorithm_id"], r["determines"]) for r in rows("oids")], "oid string, algorithm_id string, determines string")


def catalogue(spark: SparkSession) -> DataFrame:
    """Packages in matching order: ecosystem, ord, package_pattern, algorithm_id."""
    return local(spark, [(r["ecosystem"], i, r["package_pattern"], r["algorithm_id"]) for i, r in enumerate(rows("catalogue"))], "ecosystem string, ord int, package_pattern string, algorithm_id string")


LANGUAGES = ["go", "python", "java", "javascript", "c", "rust", "csharp"]


def callees(spark: SparkSession) -> DataFrame:
    """lang, kind (call, new, enum, subtle), callee, api; TypeScript has JavaScript's rows and C++ has C's."""
    same = {"javascript": ["javascript", "typescript"], "c": ["c", "cpp"]}
    return local(spark, [(own, r["kind"], r["callee"], r["api"]) for lang in LANGUAGES for r in rows(f"callees_{lang}") for own in same.get(lang, [lang])], "lang string, kind string, callee string, api string")


def severities(spark: SparkSession) -> DataFrame:
    return local(spark, SEVERITIES, "severity string, rank int")


def groups(spark: SparkSession) -> DataFrame:
    return local(spark, GROUPS, "codepoint int, group_name string, algorithm_id string, probeable boolean, legacy boolean")


def floors(spark: SparkSession) -> DataFrame:
    return local(spark, FLOORS, "manifest string, field string, major int, minor int, unlocks string")


def extensions(spark: SparkSession) -> DataFrame:
    return local(spark, EXTENSIONS, "ext string, lang string")


def manifests(spark: SparkSession) -> DataFrame:
    return local(spark, MANIFESTS, "file_name string, ecosystem string")
