"""Column functions: stable ids, fingerprints, labels, list splitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The low 32 bits of the 64-bit FNV-1a offset and prime; no higher bit reaches a low one.
FNV_OFFSET, FNV_PRIME = 2216829733, 435


def fnv_low(text: Column) -> Column:
    """The low 32 bits of FNV-1a over the UTF-8 bytes, as a long; a null text has none. One Arrow pass: all texts of a batch
    a byte at a time, the longest first, so that each step is over those that still have bytes."""
    return F.arrow_udf(_fnv_low, "long")(text)


def _fnv_low(texts: pa.Array) -> pa.Array:
    data = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
    lens = np.diff(offsets)
    order = np.argsort(-lens, kind="stable")
    starts, left = offsets[:-1][order], np.searchsorted(-lens[order], -np.arange(1, (int(lens.max()) if len(lens) else 0) + 1), side="right")
    h = np.full(len(order), FNV_OFFSET, np.uint64)
    for i, n in enumerate(left.tolist()):  # the first n texts have a byte i
        h[:n] = (h[:n] ^ raw[starts[:n] + i]) * np.uint64(FNV_PRIME) & np.uint64(0xFFFFFFFF)
    out = np.empty(len(order), np.int64)
    out[order] = h.astype(np.int64)
    return pa.array(out, mask=texts.is_null().to_numpy(zero_copy_only=False))


def stable_id(*parts: Column) -> Column:
    """``QPU-`` and eight hexadecimal digits over the parts joined by ``|``; null parts count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("QPU-"), F.lpad(F.hex(fnv_low(joined)), 8, "0"))


def fingerprint(rule: Column, snippet: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256 over ``rule:trimmed snippet``."""
    return F.substring(F.sha2(F.concat(rule, F.lit(":"), F.trim(F.coalesce(snippet, F.lit("")))), 256), 1, 16)


def first_line(text: Column) -> Column:
    return F.rtrim(F.substring_index(text, "\n", 1))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, else an empty string."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def split_groups(text: Column) -> Column:
    """Names of a TLS group list: split at ``/`` and ``:``, leading marks dropped, empty ones and DEFAULT left out."""
    names = F.transform(F.split(text, "[/:]"), lambda x: F.regexp_replace(x, r"^[*?\-]+", ""))
    return F.filter(names, lambda x: (x != "") & (x != "DEFAULT"))


def fill_template(message: Column, args: Column) -> Column:
    """Replaces ``{name}`` by the argument of that name (map<string, string>)."""
    return F.aggregate(F.map_entries(args), message, lambda m, e: F.replace(m, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
