"""X.509 certificates: a small DER reader in Arrow batches, then key and signature resolution as joins."""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import algorithms, oids

FIELDS = "path string, block int, spki_oid string, curve_oid string, modulus_bits int, sig_oid string, subject_cn string, error string"
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----(.*?)-----END \1-----", re.S)
#: Object identifiers of RSA keys, EC keys and the common name; RSA ids by exact modulus.
RSA_KEY, EC_KEY, COMMON_NAME = "1.2.840.113549.1.1.1", "1.2.840.10045.2.1", "2.5.4.3"
RSA_SIZES = {1024: "rsa-1024", 2048: "rsa-2048", 3072: "rsa-3072", 4096: "rsa-4096"}
#: Signature algorithms that are weak whatever the table says.
WEAK_SIGNATURES = ["1.2.840.113549.1.1.2", "1.2.840.113549.1.1.4", "1.2.840.113549.1.1.5", "1.2.840.10040.4.3", "1.2.840.10045.4.1"]


def tlv(data: bytes, at: int) -> tuple[int, int, int]:
    """(tag, start of value, end of value) of the element at ``at``."""
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    if at + n > len(data):
        raise ValueError("truncated")
    return tag, at, at + n


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while start < end:
        out.append(tlv(data, start))
        start = out[-1][2]
    return out


def dotted(data: bytes) -> str:
    parts, value = [], 0
    for b in data:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            parts.append(value)
            value = 0
    head = min(parts[0] // 40, 2)
    return ".".join(map(str, [head, parts[0] - 40 * head, *parts[1:]]))


def read_certificate(der: bytes) -> dict:
    _, start, end = tlv(der, 0)
    body, signature = children(der, start, end)[:2]
    fields = children(der, body[1], body[2])
    if fields[0][0] == 0xA0:  # explicit version
        fields = fields[1:]
    subject, spki = fields[4], fields[5]
    cn = None
    for _, a, b in children(der, subject[1], subject[2]):
        for _, c, d in children(der, a, b):
            name, value = children(der, c, d)[:2]
            if dotted(der[name[1] : name[2]]) == COMMON_NAME:
                cn = der[value[1] : value[2]].decode("utf-8", "replace")
    algorithm, key = children(der, spki[1], spki[2])[:2]
    ids = children(der, algorithm[1], algorithm[2])
    key_oid = dotted(der[ids[0][1] : ids[0][2]])
    curve = dotted(der[ids[1][1] : ids[1][2]]) if len(ids) > 1 and ids[1][0] == 6 else None
    bits = None
    if key_oid == RSA_KEY:
        _, a, b = tlv(der, key[1] + 1)  # behind the count of unused bits
        modulus = children(der, a, b)[0]
        bits = int.from_bytes(der[modulus[1] : modulus[2]], "big").bit_length()
    sig = children(der, signature[1], signature[2])[0]
    return {"spki_oid": key_oid, "curve_oid": curve, "modulus_bits": bits, "sig_oid": dotted(der[sig[1] : sig[2]]), "subject_cn": cn}


def decode(content: bytes) -> list[bytes]:
    """DER of every certificate of a file: PEM blocks of that tag, else the whole content. One bad block fails the file."""
    blocks = [base64.b64decode(re.sub(rb"\s", b"", m[1].encode()), validate=True) for m in ((x[1], x[2]) for x in _PEM.finditer(content.decode("latin-1"))) if m[0] == "CERTIFICATE"]
    return blocks or [content]


def fields(files: DataFrame) -> DataFrame:
    """FIELDS of files (path, content as binary); a file that cannot be read has one row with its error."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows += [{"path": path, "block": i, **read_certificate(der)} for i, der in enumerate(decode(content or b""))]
                except Exception as e:  # any malformed input is this file's warning
                    rows.append({"path": path, "error": f"CertDecodeError: {e}"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], pa.int32() if n in ("block", "modulus_bits") else pa.string()) for n in names], names)

    return files.select("path", "content").mapInArrow(run, FIELDS)


def findings(certs: DataFrame) -> DataFrame:
    """Up to three rows a certificate: CERT-001 its key, CERT-002 its signature, CERT-100 if that is weak."""
    spark = certs.sparkSession
    by_oid = oids(spark).select("oid", "algorithm_id")
    good = certs.where("error IS NULL")
    good = good.join(F.broadcast(by_oid.toDF("spki_oid", "key_id")), "spki_oid", "left").join(F.broadcast(by_oid.toDF("curve_oid", "curve_id")), "curve_oid", "left").join(F.broadcast(by_oid.toDF("sig_oid", "sig_id")), "sig_oid", "left")
    size = F.when(F.col("modulus_bits").isin(list(RSA_SIZES)), F.concat(F.lit("rsa-"), F.col("modulus_bits").cast("string")))
    rsa = F.coalesce(size, F.when(F.col("modulus_bits") < 2048, "rsa-undersized").otherwise("rsa-unattributed"))
    key = F.when(F.col("spki_oid") == RSA_KEY, rsa).when(F.col("spki_oid") == EC_KEY, F.coalesce("curve_id", "key_id", F.lit("unknown"))).otherwise(F.coalesce("key_id", F.lit("unknown")))
    dim = algorithms(spark).select(F.col("id"), "primitive", "quantum_status")
    status = F.broadcast(dim.select(F.col("id").alias("sig_id"), F.col("quantum_status").alias("sig_status")))
    kind = F.broadcast(dim.select(F.col("id").alias("key"), "primitive"))
    good = good.withColumn("key", key).join(kind, "key", "left").join(status, "sig_id", "left")
    long_key = F.when(F.col("primitive").isin("kem", "key-agree"), "key_establishment_long_lived").otherwise("signature_long_lived")
    weak = F.col("sig_oid").isin(WEAK_SIGNATURES) | F.coalesce(F.col("sig_status") == "BrokenClassically", F.lit(False))
    row = lambda rule, algorithm, usage: F.struct(F.lit(rule).alias("rule_id"), algorithm.alias("algorithm_id"), usage.alias("usage_context"))
    sig = F.coalesce("sig_id", F.lit("unknown"))
    listed = F.array(row("CERT-001", F.col("key"), long_key), row("CERT-002", sig, F.lit("signature_long_lived")), F.when(weak, row("CERT-100", sig, F.lit("signature_long_lived"))))
    return good.select("path", "block", "subject_cn", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("f")).select(
        F.col("path").alias("location"), "block", "subject_cn", "f.*", F.lit("literal_arg").alias("confidence"), F.lit("internal_service").alias("exposure"), F.lit("medium").alias("shelf_life_bucket")
    )


def warnings(certs: DataFrame) -> DataFrame:
    return certs.where("error IS NOT NULL").select(F.lit("CertDecodeError").alias("kind"), "path", F.col("error").alias("message"))
