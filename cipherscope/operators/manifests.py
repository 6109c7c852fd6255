"""Dependencies and version floors from manifests.

Line formats are parsed by Spark: a file becomes lines, the section a line stands in is carried forward by a window over
the file. Python reads only pom.xml, whose nesting SQL cannot follow. Rows: path, ecosystem, name, version, line, snippet.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dims import floors, rows

DEPS = "path string, ecosystem string, name string, version string, line int, snippet string"
#: Section headers of Cargo.toml that hold dependencies.
CARGO_SECTIONS = ["[dependencies]", "[dev-dependencies]", "[build-dependencies]"]
POM_FIELDS = ("groupId", "artifactId", "version")


def strip(text):
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text (without a carriage return) of files (path, content)."""
    text = F.posexplode(F.split("content", "\n")).alias("pos", "text")
    return files.select("path", text).select("path", (F.col("pos") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def _carried(rows: DataFrame, name: str, value) -> DataFrame:
    """``value`` where it is not null, else that of the nearest line before."""
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(order))


def go_mod(files: DataFrame) -> DataFrame:
    rows = lines(files).withColumn("t", strip(F.regexp_replace("text", "//.*$", "")))
    opens, closes = F.col("t").rlike(r"^require\s*\($"), F.col("t") == ")"
    rows = _carried(rows, "inside", F.when(opens, True).when(closes, False))
    entry = F.when(F.coalesce("inside", F.lit(False)) & ~opens, F.col("t")).when(F.col("t").rlike(r"^require\s+[^(]"), F.regexp_replace("t", r"^require\s+", ""))
    parts = F.split(entry, r"\s+")
    return rows.where(F.size(parts) >= 2).select("path", F.lit("Go").alias("ecosystem"), parts[0].alias("name"), parts[1].alias("version"), "line", strip(F.col("text")).alias("snippet"))


def cargo_toml(files: DataFrame) -> DataFrame:
    rows = lines(files).withColumn("t", strip(F.col("text")))
    rows = _carried(rows, "section", F.when(F.col("t").startswith("["), F.col("t")))
    name = F.trim(F.trim(F.regexp_extract("t", r"^([^=]+)=", 1)), F.lit('"'))
    plain, inline = F.regexp_extract("t", r'^[^=]+=\s*"([^"]*)"', 1), F.regexp_extract("t", r'version\s*=\s*"([^"]*)"', 1)
    entry = F.col("section").isin(CARGO_SECTIONS) & F.col("t").contains("=") & ~F.col("t").startswith("#") & ~F.col("t").startswith("[")
    return rows.where(entry).select("path", F.lit("Rust").alias("ecosystem"), name.alias("name"), F.when(plain != "", plain).otherwise(inline).alias("version"), "line", F.col("t").alias("snippet"))


def requirement(text):
    """(name, version) of a requirement: split at the first of = > < ~ !; the operator is dropped."""
    clean = strip(F.regexp_replace(text, "#.*$", ""))
    return strip(F.regexp_extract(clean, r"^([^=><~!]*)", 1)), strip(F.regexp_extract(clean, r"^[^=><~!]*[=><~!]+(.*)$", 1))


def requirements_txt(files: DataFrame) -> DataFrame:
    rows = lines(files).withColumn("t", strip(F.col("text")))
    rows = rows.where((F.col("t") != "") & ~F.col("t").startswith("#") & ~F.col("t").startswith("-"))
    name, version = requirement(F.col("t"))
    return rows.select("path", F.lit("Python").alias("ecosystem"), name.alias("name"), version.alias("version"), "line", F.col("t").alias("snippet")).where("name <> ''")


def package_json(files: DataFrame) -> DataFrame:
    """Both dependency maps; the line is the first that holds the quoted name, else 1. Malformed files: ``package_warnings``."""
    parsed = files.withColumn("j", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>"))
    both = F.concat(*[F.coalesce(F.map_entries(F.col(f"j.{k}")), F.array().cast("array<struct<key:string,value:string>>")) for k in ("dependencies", "devDependencies")])
    rows = parsed.select("path", "content", F.explode(both).alias("e"))
    at = F.expr("instr(content, concat('\"', e.key, '\"'))")
    line = F.when(at > 0, F.size(F.split(F.expr("left(content, instr(content, concat('\"', e.key, '\"')))"), "\n"))).otherwise(1)
    snippet = F.concat(F.lit('"'), F.col("e.key"), F.lit('": "'), F.col("e.value"), F.lit('"'))
    return rows.select("path", F.lit("JavaScript").alias("ecosystem"), F.col("e.key").alias("name"), F.col("e.value").alias("version"), line.alias("line"), snippet.alias("snippet"))


def package_warnings(files: DataFrame) -> DataFrame:
    bad = F.from_json("content", "dependencies map<string,string>, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNotNull()
    return files.where(bad).select(F.lit("DepManifestError").alias("kind"), "path", F.lit("not valid JSON").alias("message"))


def pom_dependencies(content: str) -> list[tuple]:
    """(name, version, line) of a pom's dependencies. Text goes to the open dependency by tag name alone, so ids of a
    nested exclusion replace those of the dependency around it."""
    out, fields, line_of = [], None, {}
    for i, text in enumerate(content.split("\n"), 1):
        if "<dependency>" in text:
            line_of[len(line_of)] = i
    try:
        for event, node in ET.iterparse(io.BytesIO(content.encode()), ("start", "end")):
            tag = node.tag.rpartition("}")[2]
            if tag == "dependency" and event == "start":
                fields = {}
            elif tag == "dependency" and fields is not None:
                if fields.get("groupId") and fields.get("artifactId"):
                    out.append((f"{fields['groupId']}:{fields['artifactId']}", fields.get("version", ""), line_of.get(len(out), 1)))
                fields = None
            elif event == "end" and fields is not None and tag in POM_FIELDS:
                fields[tag] = (node.text or "").strip()
    except ET.ParseError:
        pass
    return out


def pom_xml(files: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [(p, "Maven", n, v, i, n) for p, c in zip(*(x.to_pylist() for x in batch.columns)) for n, v, i in pom_dependencies(c or "")]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 4 else pa.string()) for k, c in enumerate(cols)], ["path", "ecosystem", "name", "version", "line", "snippet"])

    return files.select("path", "content").mapInArrow(run, DEPS)


PARSERS = {"go.mod": go_mod, "Cargo.toml": cargo_toml, "requirements.txt": requirements_txt, "package.json": package_json, "pom.xml": pom_xml}


def dependencies(files: DataFrame) -> DataFrame:
    """All dependencies of files (path, content), by file name."""
    name = F.element_at(F.split("path", "/"), -1)
    out = None
    for kind, parse in PARSERS.items():
        found = parse(files.where(name == kind))
        out = found if out is None else out.unionByName(found)
    return out


def catalogue_matches(deps: DataFrame) -> DataFrame:
    """Dependencies that the catalogue names, with the algorithm of the first pattern that matches.

    The catalogue is fixed and small: a chain of conditions with literal patterns, each compiled once, and no join.
    """
    hit = F
    for r in rows("catalogue"):
        hit = hit.when((F.col("ecosystem") == r["ecosystem"]) & F.col("name").rlike(r["package_pattern"]), r["algorithm_id"])
    return deps.withColumn("algorithm_id", hit).where("algorithm_id IS NOT NULL")


def version_pair(text):
    """struct(major, minor) of a version's start; null where it has none. Structs compare like pairs."""
    major, minor = F.regexp_extract(text, r"^\s*[vV]?(\d+)", 1), F.regexp_extract(text, r"^\s*[vV]?\d+\.(\d+)", 1)
    return F.when(major != "", F.struct(F.expr("1") * F.try_to_number(major, F.lit("999999")).cast("int"), F.coalesce(F.try_to_number(F.nullif(minor, F.lit("")), F.lit("999999")).cast("int"), F.lit(0))))


def cleared_floors(declared: DataFrame) -> DataFrame:
    """A row for each floor that a declared version reaches. declared: path, manifest, field, version."""
    dim = floors(declared.sparkSession)
    both = declared.join(F.broadcast(dim), ["manifest", "field"])
    return both.where(version_pair(F.col("version")) >= F.struct("major", "minor")).select("path", "manifest", "field", "version", "unlocks")


def declared_versions(files: DataFrame) -> DataFrame:
    """path, manifest, field, version of the fields that floors watch."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = lines(files.withColumn("manifest", name).select("path", "content"))
    rows = rows.withColumn("manifest", F.element_at(F.split("path", "/"), -1)).withColumn("t", strip(F.col("text")))
    go = F.regexp_extract("t", r"^go\s+(\S+)$", 1)
    java = F.regexp_extract("t", r"<maven\.compiler\.release>\s*([^<]+?)\s*<", 1)
    pin = F.regexp_extract("t", r"^cryptography\s*(?:>=|==|~=)\s*([0-9][^,;#\s]*)", 1)
    picked = F.when(F.col("manifest") == "go.mod", F.struct(F.lit("go").alias("field"), go.alias("version")))
    picked = picked.when(F.col("manifest") == "pom.xml", F.struct(F.lit("maven.compiler.release").alias("field"), java.alias("version")))
    picked = picked.when(F.col("manifest") == "requirements.txt", F.struct(F.lit("cryptography").alias("field"), pin.alias("version")))
    return rows.withColumn("d", picked).where("d.version <> ''").select("path", "manifest", "d.field", "d.version")
