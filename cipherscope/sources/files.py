"""File sources: source trees, manifests and certificates as rows, with what was left out as warnings."""

from __future__ import annotations

import os
import re
import tempfile
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import MANIFESTS, extensions, local
from ..functions.text import extension

#: Largest file that is read.
MOST_BYTES = 16 * 1024 * 1024


#: Bytes of a large file that one task searches.
RANGE_BYTES = 64 * 1024 * 1024


def _open(path: str):
    """(file system, path within it); a plain path is local."""
    from pyarrow import fs

    kind, _, rest = path.partition(":") if re.match(r"[a-z][a-z0-9+.-]*:", path) else ("file", "", path)
    if kind == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{kind}:{quote(rest)}")


def _class(line: str, at: int) -> tuple[str, int]:
    """A bracket expression of an ignore line as a regular expression, and where it ends; a lone bracket stands for itself."""
    end = line.find("]", at + 2 if line[at + 1 : at + 2] not in "!^" else at + 3)
    if end < 0:
        return r"\[", at + 1
    body, negated = line[at + 1 : end], line[at + 1] in "!^"
    return f"(?!/)[{'^' if negated else ''}{re.sub(r'([\\\[\]^&~|])', r'\\\1', body[negated:])}]", end + 1


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """(regular expression on a path relative to the ignore file, a folder's with a slash behind it; negated) of a line of an
    ignore file."""
    line = re.sub(r"(?<!\\)[ \t\r\n]+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folder, anchored = line.endswith("/"), "/" in line.rstrip("/")
    line, out, at = line.strip("/"), "", 0
    while at < len(line):
        if line.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif line.startswith("**", at):
            out, at = out + ".*", at + 2
        elif line[at] in "*?":
            out, at = out + ("[^/]*" if line[at] == "*" else "[^/]"), at + 1
        elif line[at] == "[":
            part, at = _class(line, at)
            out += part
        else:
            at += line[at] == "\\" and at + 1 < len(line)
            out, at = out + re.escape(line[at]), at + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), negated


def ignored_by(rules: list[tuple[re.Pattern, bool]], relative: str) -> bool | None:
    """What the last line that matches says; None if none does."""
    found = None
    for pattern, negated in rules:
        if pattern.search(relative):
            found = not negated
    return found


@lru_cache(4096)
def compiled(text: str) -> tuple:
    return tuple((re.compile(f[0]), f[1]) for f in map(ignore_pattern, text.split("\n")) if f)


#: A file or folder; of a folder also the ignore files that hold below it, from the outermost on.
ENTRY = "path string, length long, folder boolean, ignores array<struct<base: string, text: string>>"


def _children(hidden: bool, ignoring: bool, root: str, more: str):
    """A task's function: the entries of each folder that no ignore file around them leaves out."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path, ignores in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = _open(path)
                entries = store.get_file_info(fs.FileSelector(place))
                names, links = {e.base_name: e for e in entries}, isinstance(store, fs.LocalFileSystem)
                base = path.rstrip("/")
                if ignoring and ".gitignore" in names and names[".gitignore"].is_file:
                    with store.open_input_stream(names[".gitignore"].path) as f:
                        ignores = [*ignores, {"base": base, "text": f.read().decode("utf-8", "replace")}]
                rows = []
                for name, e in sorted(names.items()):
                    own, kind = f"{base}/{name}", e.type == fs.FileType.Directory
                    if name.startswith(".") and not hidden or links and os.path.islink(e.path):
                        continue
                    slash = "/" if kind else ""
                    if more and ignored_by(compiled(more), own[len(root) + 1 :] + slash):
                        continue
                    said = None
                    for i in ignores:
                        said = x if (x := ignored_by(compiled(i["text"]), own[len(i["base"]) + 1 :] + slash)) is not None else said
                    if not said:
                        rows.append((own, None if kind else e.size, kind, ignores if kind else []))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("base", pa.string()), ("text", pa.string())]))))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "length", "folder", "ignores"])

    return run


def walk(spark: SparkSession, *roots: str, hidden: bool = False, ignoring: bool = False, more: list[str] | None = None) -> DataFrame:
    """path, length of every file below the roots (or the root itself, if it is a file), names that begin with ``_``
    included, which Spark's own listing passes over; those that begin with a dot if ``hidden``; symbolic links are
    not followed.

    Folders of a level are rows, listed by tasks and written before the next level, so a folder that is left out is never
    entered and no listing passes through the driver. Ignore files hold for their folders, the nearest last; ``more`` holds
    lines for the roots. The store must be one that ``pyarrow.fs`` opens (local or shared path, HDFS, S3, GCS)."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    found = []
    for root in roots:
        root = root.rstrip("/")
        store, place = _open(root)
        info = store.get_file_info(place)
        if info.is_file:
            found.append(spark.range(1).select(F.lit(root).alias("path"), F.lit(info.size).cast("long").alias("length")))
            continue
        level, folders = local(spark, [(root,)], "path string").withColumn("ignores", F.array().cast("array<struct<base: string, text: string>>")), 1
        while folders:
            slices = min(folders, 4 * spark.sparkContext.defaultParallelism)
            entries = level.repartition(slices).mapInArrow(_children(hidden, ignoring, root, "\n".join(more or [])), ENTRY).checkpoint()
            found.append(entries.where("NOT folder").select("path", "length"))
            level = entries.where("folder").select("path", "ignores")
            folders = level.count()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def with_content(files: DataFrame) -> DataFrame:
    """Adds ``content`` to files (path, length, ...), read by tasks; a file that went since is a null."""
    names = ["path", *(c for c in files.columns if c != "path")]
    files = files.select(names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one file's bytes at a time
                store, place = _open(batch.column(0)[i].as_py())
                try:
                    with store.open_input_stream(place) as f:
                        data = f.read()
                except FileNotFoundError:
                    data = None
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([data], pa.binary())], [*names, "content"])

    return files.mapInArrow(run, f"{kinds}, content binary")


_BEGIN, _END = b"-----BEGIN CERTIFICATE-----", b"-----END CERTIFICATE-----"


def pem_blocks(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, offset, content of each PEM certificate of large files (path, length). Ranges of a file are rows that tasks search
    on their own; a block belongs to the range it begins in, and is read on to its end wherever that is."""
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))

    def run(batches):
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = _open(path)
                with store.open_input_file(place) as f:
                    data, at = f.read_at(min(range_bytes + len(_BEGIN) - 1, length - start), start), 0
                    while 0 <= (at := data.find(_BEGIN, at)) < range_bytes:
                        stop = data.find(_END, at)
                        while stop < 0 and start + len(data) < length:
                            seen = max(at, len(data) - len(_END))
                            data += f.read_at(min(1 << 16, length - start - len(data)), start + len(data))
                            stop = data.find(_END, seen)
                        if stop < 0:
                            break
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start + at]), pa.array([data[at : stop + len(_END)] + b"\n"], pa.binary())], ["path", "offset", "content"])
                        at = stop

    return ranges.repartition(F.col("path"), F.col("start")).mapInArrow(run, "path string, offset long, content binary")


def source_files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """path, lang, content (text) of files in a known language up to MOST_BYTES. Ignore files below the root hold for their
    folders; ``ignore`` holds further lines for the root. Hidden files and folders are left out."""
    files = walk(spark, root, ignoring=True, more=ignore).where(F.col("length") <= MOST_BYTES)
    known = files.withColumn("ext", extension(F.col("path"))).join(F.broadcast(extensions(spark)), "ext").select("path", "length", "lang")
    return with_content(known).where("content IS NOT NULL").select("path", "lang", F.decode("content", "UTF-8").alias("content"))


def oversized(spark: SparkSession, root: str) -> DataFrame:
    """Warnings for files that are too large to read."""
    files = walk(spark, root, ignoring=True).where(F.col("length") > MOST_BYTES)
    return files.select(F.lit("UnreadableFile").alias("kind"), "path", F.concat(F.lit("larger than "), F.lit(MOST_BYTES), F.lit(" bytes")).alias("message"))


def manifest_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content (text) of dependency manifests by exact file name."""
    name = F.element_at(F.split("path", "/"), -1)
    files = walk(spark, root, ignoring=True).where(name.isin([n for n, _ in MANIFESTS]))
    return with_content(files).select("path", F.decode("content", "UTF-8").alias("content"))


def certificate_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of every file, whatever its name: whole up to MOST_BYTES, of larger files a row for each PEM certificate."""
    files = walk(spark, root, hidden=True)
    small = with_content(files.where(F.col("length") <= MOST_BYTES)).select("path", "content")
    return small.unionByName(pem_blocks(files.where(F.col("length") > MOST_BYTES)).select("path", "content"))


def inline_findings(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A row for each finding of a JSON array column."""
    return rows.select(F.explode(F.from_json(column, f"array<{schema}>")).alias("f")).select("f.*")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Known-answer test cases of vector files: algorithm, mode, parameterSet, tg, tc, and each case's fields as a map."""
    schema = "algorithm string, mode string, parameterSet string, testGroups array<struct<tgId: int, parameterSet: string, tests: array<map<string, string>>>>"
    groups = spark.read.schema(schema).json(path, multiLine=True).select("algorithm", "mode", F.explode("testGroups").alias("g"))
    cases = groups.select("algorithm", "mode", "g.parameterSet", F.col("g.tgId").alias("tg"), F.explode("g.tests").alias("fields"))
    return cases.withColumn("tc", F.try_element_at("fields", F.lit("tcId")).cast("int"))


#: File name (or its end, after a star), label and token of an ecosystem, in order.
ECOSYSTEMS = [
    ("requirements.txt", "Python (pypi)", "python"), ("setup.py", "Python (pypi)", "python"), ("pyproject.toml", "Python (pypi)", "python"),
    ("package.json", "Node.js (npm)", "javascript"), ("pom.xml", "Java (maven)", "java"), ("build.gradle", "Java (gradle)", "java"),
    ("Cargo.toml", "Rust (crates.io)", "rust"), ("go.mod", "Go (modules)", "go"), ("*.csproj", "C# (.NET)", "csharp"),
]


def ecosystems(paths: DataFrame, root: str) -> DataFrame:
    """token and label of the ecosystems whose manifests stand in the root or one folder below it; of several manifests of
    a token the first in order gives the label."""
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").removeprefix("file://")) + "/?", "")
    name, found = F.element_at(F.split("path", "/"), -1), F.lit(None).cast("struct<ord:int,token:string,label:string>")
    for i, (file, label, token) in reversed(list(enumerate(ECOSYSTEMS))):
        fits = name.endswith(file[1:]) if file.startswith("*") else name == file
        found = F.when(fits, F.struct(F.lit(i).alias("ord"), F.lit(token).alias("token"), F.lit(label).alias("label"))).otherwise(found)
    near = paths.where(F.size(F.split(relative, "/")) <= 2).select(found.alias("e")).where("e IS NOT NULL")
    return near.groupBy("e.token").agg(F.min_by("e.label", "e.ord").alias("label"))


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; null if it is absolute and lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).when(~path.startswith("/"), path)


def project_manifests(spark: SparkSession, root: str) -> DataFrame:
    """A row a project file (TOML): canonical_id, name, ecosystem, commit_sha, scan_paths, exclude_paths, unscannable."""
    names = ["canonical_id", "name", "ecosystem", "commit_sha", "scan_paths", "exclude_paths", "unscannable"]
    types = [pa.list_(pa.string()) if n.endswith("_paths") else pa.string() for n in names]

    def read(batches):
        import tomllib

        for batch in batches:
            rows = [tomllib.loads(c.decode()) for c in batch.column(0).to_pylist()]
            rows = [r.get("project", r) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names)

    files = with_content(walk(spark, root).where(F.col("path").endswith(".toml")))
    return files.select("content").mapInArrow(read, "canonical_id string, name string, ecosystem string, commit_sha string, scan_paths array<string>, exclude_paths array<string>, unscannable string")
