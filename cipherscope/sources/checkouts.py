"""Checkouts of version-controlled projects as rows: tracked files from git's index, refs, whether a commit is there, and a
count of files and bytes below declared paths. Git itself is not run; its files are read by tasks."""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import in_scope
from .files import _open, walk

INDEX = "project string, file string, size long, mode int, sha string"
HEADS = "project string, cloned boolean, head string, pin_known boolean, tracked long, missing_scopes long"


def index_entries(data: bytes) -> list[tuple[str, int, int, str]]:
    """(path, size, mode, object) of the entries of a binary index, versions 2 to 4."""
    if data[:4] != b"DIRC":
        raise ValueError("not an index")
    version, count = struct.unpack(">II", data[4:12])
    out, at, name = [], 12, b""
    for _ in range(count):
        mode, size, flags = struct.unpack(">I", data[at + 24 : at + 28])[0], struct.unpack(">I", data[at + 36 : at + 40])[0], struct.unpack(">H", data[at + 60 : at + 62])[0]
        sha, begin = data[at + 40 : at + 60].hex(), at + (64 if flags & 0x4000 and version > 2 else 62)
        if version == 4:  # how much of the name before is dropped, then the rest
            drop, shift = data[begin] & 0x7F, begin
            while data[shift] & 0x80:
                shift += 1
                drop = (drop + 1 << 7) | data[shift] & 0x7F
            end = data.index(b"\0", shift + 1)
            name = name[: len(name) - drop] + data[shift + 1 : end]
            at = end + 1
        else:
            end = data.index(b"\0", begin)
            name, at = data[begin:end], at + (end - at + 8) // 8 * 8
        out.append((name.decode("utf-8", "replace"), size, mode, sha))
    return out


class Repository:
    """What a task reads of one checkout."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.store, self.place = _open(self.root)

    def read(self, name: str) -> bytes | None:
        from pyarrow import fs

        place = f"{self.place}/{name}"
        if self.store.get_file_info(place).type != fs.FileType.File:
            return None
        with self.store.open_input_stream(place) as f:
            return f.read()

    def exists(self, name: str) -> bool:
        from pyarrow import fs

        return self.store.get_file_info(f"{self.place}/{name}").type != fs.FileType.NotFound

    def resolve(self, ref: str) -> str | None:
        """The commit of a ref: loose, packed, or through another ref."""
        for _ in range(5):
            text = self.read(f".git/{ref}")
            if text is None:
                packed = (self.read(".git/packed-refs") or b"").decode("utf-8", "replace")
                found = re.search(rf"(?m)^([0-9a-f]{{40,64}}) {re.escape(ref)}$", packed)
                return found[1] if found else None
            text = text.decode("utf-8", "replace").strip()
            if not text.startswith("ref:"):
                return text or None
            ref = text[4:].strip()
        return None

    def has_object(self, sha: str) -> bool:
        """Whether an object of that full name is there, loose or in a pack's index."""
        from pyarrow import fs

        if not re.fullmatch(r"[0-9a-f]{40}", sha):
            return False
        if self.exists(f".git/objects/{sha[:2]}/{sha[2:]}"):
            return True
        wanted = bytes.fromhex(sha)
        for pack in self.store.get_file_info(fs.FileSelector(f"{self.place}/.git/objects/pack", allow_not_found=True)):
            if pack.base_name.endswith(".idx"):
                with self.store.open_input_file(pack.path) as f:
                    head = f.read_at(1032, 0)
                    if head[:8] != b"\xfftOc\0\0\0\x02":
                        continue
                    first = struct.unpack(">I", head[4 + 4 * wanted[0] : 8 + 4 * wanted[0]])[0] if wanted[0] else 0
                    last = struct.unpack(">I", head[8 + 4 * wanted[0] : 12 + 4 * wanted[0]])[0]
                    names = f.read_at(20 * (last - first), 1032 + 20 * first)  # those that share the first byte
                    if any(names[i : i + 20] == wanted for i in range(0, len(names), 20)):
                        return True
        return False


def tracked_files(projects: DataFrame) -> DataFrame:
    """INDEX of checkouts (project, root); a checkout without an index has no rows."""

    def run(batches):
        for batch in batches:
            for project, root in zip(batch.column("project").to_pylist(), batch.column("root").to_pylist()):
                data = Repository(root).read(".git/index")
                rows = index_entries(data) if data else []
                yield pa.RecordBatch.from_arrays([pa.array([project] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string())))], ["project", "file", "size", "mode", "sha"])

    return projects.select("project", "root").mapInArrow(run, INDEX)


def heads(projects: DataFrame) -> DataFrame:
    """HEADS of checkouts (project, root, pin, scan_paths): what a look into each says."""

    def run(batches):
        for batch in batches:
            rows = []
            for project, root, pin, paths in zip(*(batch.column(c).to_pylist() for c in ("project", "root", "pin", "scan_paths"))):
                r = Repository(root)
                cloned = r.exists(".git")
                index = r.read(".git/index") if cloned else None
                rows.append((project, cloned, r.resolve("HEAD") if cloned else None, bool(cloned and pin and r.has_object(pin)), len(index_entries(index)) if index else 0, sum(not r.exists(p.strip("/") or ".") for p in paths or []) if cloned else 0))
            types = (pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["project", "cloned", "head", "pin_known", "tracked", "missing_scopes"])

    return projects.select("project", "root", "pin", "scan_paths").mapInArrow(run, HEADS)


def census(projects: DataFrame, clones: str) -> DataFrame:
    """project, files, bytes: regular files on disk below the declared paths of each checkout (project, root, scan_paths; roots
    below ``clones``), git's own folder left out. A file below two of a project's paths counts once."""
    spark = projects.sparkSession
    listed = walk(spark, clones, hidden=True, more=[".git"])
    roots = projects.select("project", F.regexp_replace("root", "/+$", "").alias("root"))
    # Projects by the folders around a file: a join by key, no matching of all projects with all files.
    parts = F.split("path", "/")
    around = listed.select("path", "length", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("depth")).withColumn("root", F.array_join(F.slice(F.split("path", "/"), 1, F.col("depth")), "/"))
    files = around.join(roots, "root").select("project", F.expr("substr(path, length(root) + 2)").alias("path"), F.col("length").alias("bytes"))
    paths = projects.select("project", F.explode("scan_paths").alias("scope")).withColumn("scope", F.regexp_replace("scope", "^(\\./)+|/+$", ""))
    whole = paths.where("scope IN ('', '.')").select("project").distinct()
    kept = in_scope(files, paths.where("scope NOT IN ('', '.')")).select("project", "path", "bytes").unionByName(files.join(whole, "project", "left_semi"))
    counts = kept.dropDuplicates(["project", "path"]).groupBy("project").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return projects.select("project").join(counts, "project", "left").na.fill(0, ["files", "bytes"])


def inspected(projects: DataFrame, clones: str) -> DataFrame:
    """What ``corpus.integrity`` asks of each project (project, root, pin, scan_paths, unscannable)."""
    return projects.select("project", "pin", "unscannable").join(heads(projects), "project").join(census(projects, clones), "project")
