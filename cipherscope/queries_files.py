"""Registered queries over files and streams: rows of a table are laid out as files in the shared folder, then found there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dims
from .operators import classify, extract, risk
from .policy import listing, resolve
from .queries import ALG, BASE, CNSA, FINDINGS, NIST, SQL, _scored_sql, findings, pick, read, register, scored
from .queries_documents import _shared
from .queries_extract import over
from .queries_source import RULE_PACK, matches
from .sources import files
from .streaming import scans


def laid_out(rows: DataFrame, root: str) -> str:
    """Writes a file a row (path below root, content); a task that runs again writes the same files. Returns the root."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = files._open(f"{root}/{path}")
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as f:
                    f.write(content.encode())
            yield batch.select(["path"])

    rows = rows.select("path", "content").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    rows.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
    return root


#: Paths by key, {n} the key: of packages, generated code, ignored and hidden files, deep folders.
_PATHS = ["src/_gen/__init__{n}.py", "src/pkg/main{n}.go", "src/out/m{n}.py", "src/t{n}.gen.ts", ".hid/h{n}.py", "src/deep/a/_b/c/k{n}.rs"]
_IGNORE = "# generated\n\\#odd.py\nout/\n*.gen.[tj]s\n"
_TREE = f"SELECT s_suppkey AS k, replace((['{"', '".join(_PATHS)}'])[1 + s_suppkey % 6], '{{n}}', CAST(s_suppkey AS VARCHAR)) AS path, s_suppkey % 6 AS kind, 'x = ' || s_suppkey AS text FROM supplier"


def tree(spark, sf_dir) -> str:
    """A checkout with a file a supplier, an ignore file, and for one of a hundred suppliers a file over the size cap."""
    k = F.col("s_suppkey")
    key = k.cast("string")
    suppliers = read(spark, sf_dir, "supplier")
    one = suppliers.select(F.replace(pick(_PATHS, k % 6), F.lit("{n}"), key).alias("path"), F.concat(F.lit("x = "), key).alias("content"))
    large = suppliers.where(k % 100 == 7).select(F.concat(F.lit("src/pkg/large"), key, F.lit(".js")).alias("path"), F.repeat(F.lit("//\n"), files.MOST_BYTES // 3 + 1).alias("content"))
    ignore = dims.local(spark, [("src/.gitignore", _IGNORE)], "path string, content string")
    return laid_out(one.unionByName(large).unionByName(ignore), _shared(spark, "tree"))


@register(f"SELECT path, CASE kind WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'rust' END AS lang, text AS content FROM ({_TREE}) WHERE kind IN (0, 1, 5)")
def listed_sources(spark, sf_dir):
    root = tree(spark, sf_dir)
    return files.source_files(spark, root).select(files.relative_path(F.col("path"), root).alias("path"), "lang", "content")


@register(f"SELECT 'UnreadableFile' AS kind, 'src/pkg/large' || s_suppkey || '.js' AS path, 'larger than {16 << 20} bytes' AS message FROM supplier WHERE s_suppkey % 100 = 7")
def listed_oversized(spark, sf_dir):
    root = tree(spark, sf_dir)
    return files.oversized(spark, root).withColumn("path", files.relative_path(F.col("path"), root))


@register(f"SELECT path, strlen(text) AS bytes FROM ({_TREE}) UNION ALL SELECT 'src/.gitignore', {len(_IGNORE)}")
def listed_for_certificates(spark, sf_dir):
    """Every file, hidden and ignored ones too; the large ones, which hold no certificate, give none."""
    root = tree(spark, sf_dir)
    return files.certificate_files(spark, root).select(files.relative_path(F.col("path"), root).alias("path"), F.length("content").cast("long").alias("bytes"))


@register("SELECT 'p' || (s_suppkey // 4) || '/' || (['go.mod', 'Cargo.toml', 'requirements.txt'])[1 + s_suppkey % 4] AS path, 'of ' || s_suppkey AS content FROM supplier WHERE s_suppkey % 4 < 3")
def listed_manifests(spark, sf_dir):
    k = F.col("s_suppkey")
    path = F.concat(F.lit("p"), F.floor(k / 4).cast("string"), F.lit("/"), pick(["go.mod", "Cargo.toml", "requirements.txt", "requirements.txt.bak"], k % 4))
    root = laid_out(read(spark, sf_dir, "supplier").select(path.alias("path"), F.concat(F.lit("of "), k.cast("string")).alias("content")), _shared(spark, "manifests"))
    return files.manifest_files(spark, root).withColumn("path", files.relative_path(F.col("path"), root))


@register("SELECT 'p' || s_suppkey AS canonical_id, CASE WHEN s_suppkey % 2 = 0 THEN 'go' END AS ecosystem, CASE WHEN s_suppkey % 3 = 0 THEN 'src/' || s_suppkey || ',lib' END AS scan_paths FROM supplier")
def project_files(spark, sf_dir):
    k = F.col("s_suppkey")
    key = k.cast("string")
    text = F.concat(
        F.when(k % 5 == 0, "[project]\n").otherwise("# a project\n"), F.lit('canonical_id = "p'), key, F.lit('"\n'), F.when(k % 2 == 0, "ecosystem = 'go'\n").otherwise(""),
        F.when(k % 3 == 0, F.concat(F.lit('scan_paths = [\n  "src/'), key, F.lit('", # first\n  "lib",\n]\n'))).otherwise(""),
    )
    root = laid_out(read(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), (k % 3).cast("string"), F.lit("/_p"), key, F.lit(".toml")).alias("path"), text.alias("content")), _shared(spark, "projects"))
    return files.project_manifests(spark, root).select("canonical_id", "ecosystem", F.array_join("scan_paths", ",").alias("scan_paths"))


@register("SELECT 'ML-DSA' AS algorithm, (['ML-DSA-44', 'ML-DSA-65', 'ML-DSA-87'])[1 + s_suppkey % 3] AS parameters, CAST(t AS INTEGER) AS tc, CASE WHEN t = 1 THEN 'M' || s_suppkey END AS message FROM supplier, (VALUES (1), (2)) v(t)")
def vector_cases(spark, sf_dir):
    k = F.col("s_suppkey")
    key = k.cast("string")
    text = F.concat(
        F.lit('{"algorithm": "ML-DSA",\n "mode": "sigVer", "testGroups": [{"tgId": 1, "parameterSet": "'), pick(["ML-DSA-44", "ML-DSA-65", "ML-DSA-87"], k % 3),
        F.lit('",\n "tests": [{"tcId": 1, "message": "M'), key, F.lit('"},\n {"tcId": 2, "testPassed": true}]}]}'),
    )
    root = laid_out(read(spark, sf_dir, "supplier").select(F.concat(F.lit("v"), key, F.lit(".json")).alias("path"), text.alias("content")), _shared(spark, "vectors"))
    return files.vectors(spark, root).select("algorithm", F.col("parameterSet").alias("parameters"), "tc", F.try_element_at("fields", F.lit("message")).alias("message"))


@register(SQL["classify_first_match"])
def classify_from_folder(spark, sf_dir):
    packs = [("go.toml", RULE_PACK), ("javascript.toml", RULE_PACK.replace("CRYPTO-", "OTHER-")), ("notes.txt", "no pack")]
    root = laid_out(dims.local(spark, packs, "path string, content string"), _shared(spark, "packs"))
    return classify.classify(matches(spark, sf_dir), classify.from_folder(spark, root))


@register(f"{BASE} SELECT seq, total, severity, hndl_critical FROM s")
def stored_scans(spark, sf_dir):
    """Findings that arrive in several files, a file a batch, are scored and stored, each once."""
    rows, came, out = findings(spark, sf_dir), _shared(spark, "arriving"), _shared(spark, "scans")
    rows.repartition(3, "seq").write.parquet(came)
    stream = scans.arriving(spark, came, ", ".join(map(" ".join, rows.dtypes)), files_a_batch=1)
    scans.store(stream, NIST, out, _shared(spark, "progress")).awaitTermination()
    return scans.stored(spark, out).select("seq", "total", "severity", "hndl_critical")


@register(f"{BASE} SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS since, severity, count(*) AS findings FROM s JOIN events ON seq = event_id GROUP BY ALL")
def findings_by_window(spark, sf_dir):
    times = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    found = scans.windowed(scored(spark, sf_dir).select("seq", "severity").join(times, "seq"))
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("since"), "severity", "findings")


@register(f"WITH {ALG}, {FINDINGS}, {_scored_sql(NIST, 'a')}, {_scored_sql(CNSA, 'b')}, t AS (SELECT 'nist-default' AS policy, * FROM a UNION ALL SELECT 'nsa-cnsa2', * FROM b) SELECT policy, 'built-in' AS source, severity, count(*) AS findings FROM t GROUP BY ALL")
def policy_listing(spark, sf_dir):
    """Severities under each policy of the listing, the first chosen by default, others as a configuration names them."""
    rows, found = findings(spark, sf_dir), None
    for policy in (resolve(), resolve(None, "nsa-cnsa2")):
        own = risk.score(rows, policy).select(F.lit(policy.name).alias("policy"), "severity")
        found = own if found is None else found.unionByName(own)
    counts = found.groupBy("policy", "severity").agg(F.count("*").alias("findings"))
    return listing(spark).select(F.col("name").alias("policy"), "source").join(counts, "policy")


RUST_MEMBERS = [
    ("fn f() { ring::digest::digest(&digest::SHA256, b\"{n}\"); }", [("ring::digest::digest", "SHA256", 1)]),
    ("let s = Crypto::new(CipherSuite::P256_{n}(x), 1);\nlog(\"Crypto::new(A::B)\");", [("Crypto::new", "P256_{n}", 1)]),
    ("suite(Vec::<u8>::with(1));\nsuite(a.b.Kyber{n})", [("suite", "with", 1), ("suite", "Kyber{n}", 2)]),
    ("suite({n});\n// suite(A::B)\nsuite(\"A::B\")", []),
]


@over("orders", "o_orderkey", "rust", RUST_MEMBERS)
def rust_members(files_):
    member = extract.nth_member(F.col("args"), 0)
    return extract.call_sites(files_).where(F.col("callee").isin("ring::digest::digest", "Crypto::new", "suite")).select("path", F.col("callee").alias("api"), member.alias("value"), "line").where("value <> ''")
