"""Policies as data: weights in long form, so that scoring is a lookup and several policies are one query."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .dims import BUCKETS, algorithm_rows, local

AXES = ("algorithm_vulnerability", "usage_context", "data_shelf_life", "exposure", "detection_confidence")

#: Fixed values of the preset nist-default.
NIST = {
    "caps": {"algorithm_vulnerability": 40, "usage_context": 25, "data_shelf_life": 15, "exposure": 10, "detection_confidence": 10},
    "algorithm_vulnerability": {"BrokenClassically": 40, "BrokenByShor": 40, "WeakenedByGrover": 15, "QuantumSafe": 0, "PqcFinal": 0, "PqcDraft": 5},
    "usage_context": {"key_establishment_long_lived": 25, "key_establishment_ephemeral": 15, "data_at_rest_encryption": 22, "signature_long_lived": 12, "signature_ephemeral": 5, "authentication_only": 5, "hashing": 3, "unknown": 10},
    "data_shelf_life": {"ephemeral": 0, "short": 3, "medium": 10, "long": 15},
    "exposure": {"public_internet": 10, "internal_service": 4, "local_only": 1},
    "detection_confidence": {"literal_arg": 10, "type_name": 8, "variable": 5, "string_table": 2, "unknown": 3},
    "bands": {"critical": 75, "high": 50, "medium": 25, "low": 10},
    "hndl_status": ["BrokenByShor", "BrokenClassically"],
    "hndl_context": ["key_establishment_long_lived", "key_establishment_ephemeral", "data_at_rest_encryption"],
    "hndl_bucket": "medium",
    "disallowed": [],
    "fail_on": "critical",
}
#: Fixed values of the preset nsa-cnsa2 that differ from it.
CNSA = NIST | {
    "algorithm_vulnerability": NIST["algorithm_vulnerability"] | {"WeakenedByGrover": 40, "PqcDraft": 40},
    "hndl_bucket": "short",
    "fail_on": "high",
    "disallowed": [
        "aes-128-gcm", "aes-128-cbc", "aes-128-ecb", "aes-192-gcm", "aes-192-ecb", "chacha20-poly1305", "sha-256", "sha3-256",
        "ml-kem-512", "ml-kem-768", "ml-dsa-44", "ml-dsa-65",
        "slh-dsa-sha2-128s", "slh-dsa-sha2-128f", "slh-dsa-sha2-192s", "slh-dsa-sha2-192f", "slh-dsa-sha2-256s", "slh-dsa-sha2-256f",
        "slh-dsa-shake-128s", "slh-dsa-shake-128f", "slh-dsa-shake-192s", "slh-dsa-shake-192f", "slh-dsa-shake-256s", "slh-dsa-shake-256f",
        "slh-dsa-unattributed", "fn-dsa-512", "fn-dsa-1024", "hss", "xmss-mt",
        "x25519-mlkem768", "secp256r1-mlkem768", "x25519-kyber768-draft00",
    ],
}
PRESETS = {"nist-default": ("NIST IR 8547 IPD (Nov 2024)", NIST), "nsa-cnsa2": ("NSA CNSA 2.0 (National Security Systems)", CNSA)}
#: Bucket of a finding whose own is unknown.
DEFAULT_BUCKET = "short"


@dataclass(frozen=True)
class Policy:
    name: str
    caps: dict
    algorithm_vulnerability: dict
    usage_context: dict
    data_shelf_life: dict
    exposure: dict
    detection_confidence: dict
    bands: dict
    hndl_status: list
    hndl_context: list
    hndl_bucket: str
    disallowed: list
    fail_on: str = "critical"
    display_name: str = ""
    #: Algorithms broken without a quantum computer; path patterns and the bucket of what they match; the default bucket.
    broken: list = field(default_factory=list)
    shelf_life_tags: dict = field(default_factory=dict)
    shelf_life_default: str = DEFAULT_BUCKET

    def __post_init__(self):
        if problems := self.problems():
            raise ValueError(f"policy {self.name}: " + "; ".join(problems))

    def problems(self) -> list[str]:
        found = []
        if sum(self.caps.values()) != 100:
            found.append(f"weights sum to {sum(self.caps.values())}, not 100")
        bands = [self.bands[k] for k in ("critical", "high", "medium", "low")]
        if any(a <= b for a, b in zip(bands, bands[1:])):
            found.append("bands must fall")
        if missing := {a[6] for a in algorithm_rows()} - set(self.algorithm_vulnerability):
            found.append(f"no weight for {sorted(missing)}")
        if self.hndl_bucket not in BUCKETS or set(self.data_shelf_life) - set(BUCKETS):
            found.append("unknown shelf-life bucket")
        if unknown := {*self.disallowed, *self.broken} - {a[0] for a in algorithm_rows()}:
            found.append(f"unknown algorithms {sorted(unknown)}")
        if unknown := {*self.shelf_life_tags.values(), self.shelf_life_default} - set(BUCKETS):
            found.append(f"unknown shelf-life bucket {sorted(unknown)}")
        return found

    def long_rows(self) -> list[tuple]:
        return [(self.name, axis, key, min(w, self.caps[axis])) for axis in AXES for key, w in getattr(self, axis).items()]


def preset(name: str) -> Policy:
    display, values = PRESETS[name]
    return Policy(name=name, display_name=display, **values)


def from_toml(text: str) -> Policy:
    """A policy file: [meta], [risk_weights], a table for each axis, [severity_bands], [hndl_flag], [deprecation], [ci]."""
    t = tomllib.loads(text)
    hndl = t["hndl_flag"]
    return Policy(
        name=t["meta"]["name"],
        display_name=t["meta"].get("display_name", ""),
        caps=t["risk_weights"],
        bands=t["severity_bands"],
        hndl_status=hndl["require_quantum_status_in"],
        hndl_context=hndl["require_usage_context_in"],
        hndl_bucket=hndl["require_min_shelf_life_bucket"],
        disallowed=t.get("deprecation", {}).get("policy_disallowed", []),
        fail_on=t.get("ci", {}).get("fail_on", "critical"),
        broken=t.get("deprecation", {}).get("classically_broken", []),
        shelf_life_tags=t.get("shelf_life_tags", {}),
        shelf_life_default=t.get("shelf_life_default", {}).get("bucket", DEFAULT_BUCKET),
        **{axis: t[axis] for axis in AXES},
    )


def resolve(name: str | None = None, config: str | None = None) -> Policy:
    """The named policy, else the configuration's, else nist-default; a preset's name comes before a file of that name."""
    wanted = name or config or "nist-default"
    if wanted in PRESETS:
        return preset(wanted)
    return from_toml(Path(wanted).read_text(encoding="utf-8"))


def weights(spark: SparkSession, *policies: Policy) -> DataFrame:
    """policy, axis, key, weight (capped) of each policy."""
    return local(spark, [r for p in policies for r in p.long_rows()], "policy string, axis string, key string, weight int")


def listing(spark: SparkSession) -> DataFrame:
    """name, display_name, source of the presets."""
    return local(spark, [(n, d, "built-in") for n, (d, _) in PRESETS.items()], "name string, display_name string, source string")
