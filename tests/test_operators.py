import json

import pytest
from pyspark.sql import functions as F

from cipherscope import dims, policy
from cipherscope.functions.text import stable_id
from cipherscope.operators import certs, classify, corpus, extract, manifests, probes, query, risk, shapes
from cipherscope.plans import documents
from cipherscope.sources import files
from cipherscope.streaming import scans

FINDING = "seq long, rule_id string, algorithm_id string, location string, line int, snippet string, message string, confidence string, usage_context string, exposure string, shelf_life_bucket string"


def finding(seq, algorithm, confidence="literal_arg", usage="unknown", exposure="internal_service", shelf="short"):
    return (seq, "CRYPTO-100", algorithm, "src/a.go", 3, "x()", "m", confidence, usage, exposure, shelf)


GOLDEN = [  # algorithm, confidence, usage, exposure, shelf, nist total and band, cnsa total and band
    ("rsa-2048", "literal_arg", "unknown", "internal_service", "short", 67, "High", 67, "High"),
    ("sha-224", "literal_arg", "unknown", "internal_service", "short", 42, "Medium", 67, "High"),
    ("fn-dsa-512", "literal_arg", "unknown", "internal_service", "short", 32, "Medium", 67, "High"),
    ("ml-kem-1024", "literal_arg", "unknown", "internal_service", "short", 0, "Safe", 0, "Safe"),
    ("rsa-2048", "type_name", "unknown", "internal_service", "short", 65, "High", 65, "High"),
    ("x25519", "literal_arg", "key_establishment_long_lived", "internal_service", "medium", 89, "Critical", 89, "Critical"),
    ("x25519", "literal_arg", "key_establishment_ephemeral", "public_internet", "short", 78, "Critical", 78, "Critical"),
    ("rsa-2048", "literal_arg", "signature_long_lived", "internal_service", "medium", 76, "Critical", 76, "Critical"),
    ("rsa-2048", "unknown", "unknown", "public_internet", "short", 66, "High", 66, "High"),
    ("no-such-id", "unknown", "unknown", "public_internet", "short", None, None, None, None),
]


def test_golden_scores(spark):
    known = {a[0]: a[6] for a in dims.algorithm_rows()}
    assert known["sha-224"] in ("WeakenedByGrover", "BrokenClassically")
    rows = [finding(i, g[0], *g[1:5]) for i, g in enumerate(GOLDEN) if g[0] != "sha-224" or known["sha-224"] == "WeakenedByGrover"]
    frame = spark.createDataFrame(rows, FINDING)
    for name, at in (("nist-default", 5), ("nsa-cnsa2", 7)):
        got = {r.seq: (r.total, r.severity) for r in risk.score(frame, policy.preset(name)).collect()}
        for i in got:
            assert got[i] == (GOLDEN[i][at], GOLDEN[i][at + 1]), GOLDEN[i]


def test_policy_comparison_equals_single_scores(spark):
    rows = [finding(i, g[0], *g[1:5]) for i, g in enumerate(GOLDEN)]
    frame = spark.createDataFrame(rows, FINDING)
    both = {(r.policy, r.seq): (r.total, r.severity) for r in risk.compare_policies(frame, policy.preset("nist-default"), policy.preset("nsa-cnsa2")).collect()}
    for name in policy.PRESETS:
        for r in risk.score(frame, policy.preset(name)).collect():
            assert both[name, r.seq] == (r.total, r.severity)


def test_policy_checks():
    with pytest.raises(ValueError, match="sum"):
        policy.Policy(name="x", **(policy.NIST | {"caps": policy.NIST["caps"] | {"exposure": 11}}))
    with pytest.raises(ValueError, match="fall"):
        policy.Policy(name="x", **(policy.NIST | {"bands": policy.NIST["bands"] | {"low": 99}}))
    with pytest.raises(ValueError):
        risk.threshold("sometimes", policy.preset("nist-default"))
    assert risk.threshold("none", policy.preset("nist-default")) is None
    assert risk.threshold(None, policy.preset("nsa-cnsa2")) == 3
    assert dims.algorithm_problems(dims.algorithm_rows()[:1] * 2)


def test_stable_id(spark):
    row = spark.range(1).select(stable_id(*map(F.lit, ("CRYPTO-340", "rsa-2048", "src/keys.rs", 84, "rsa.GenerateKey"))).alias("id")).first()
    assert row.id == "QPU-86331E73"


def test_queries_and_cursor(spark):
    frame = spark.createDataFrame([finding(i, a) for i, a in enumerate(("rsa-2048", "no-such-id", "ml-kem-768"))], FINDING)
    scored = risk.flag_harvestable(risk.score(frame, policy.preset("nist-default")), policy.preset("nist-default"))
    assert [r.seq for r in query.filter_findings(scored, severity="nonsense").collect()] == [2]
    assert [r.seq for r in query.sort_findings(scored, "algorithmId").collect()] == [2, 1, 0]
    assert query.page(scored, 10).count() == 0
    assert [r.seq for r in query.page_after(scored, 0, 1).collect()] == [1]
    assert query.decode_cursor(query.encode_cursor("scan:1", 50)) == ("scan:1", 50)
    with pytest.raises(ValueError):
        query.decode_cursor("nothing")


def test_documents(spark):
    frame = spark.createDataFrame([finding(0, "rsa-2048"), finding(1, "no-such-id")], FINDING)
    scored = risk.score(frame, policy.preset("nist-default"))
    component = json.loads(documents.component_json(documents.components(frame)).first().value)
    assert component["bom-ref"] == "crypto/algorithm/rsa-2048@1.2.840.113549.1.1.1"
    assert component["cryptoProperties"]["algorithmProperties"]["parameterSetIdentifier"] == "2048"
    lines = {r.seq: json.loads(r.value) for r in documents.finding_json(scored).collect()}
    assert lines[1]["severity"] == "Unscored" and "risk_score" not in lines[1]
    result = json.loads(documents.result_json(documents.sarif_results(scored)).where("seq = 1").first().value)
    assert result["level"] == "none" and result["ruleIndex"] == 0


def deps(spark, name, content):
    frame = spark.createDataFrame([(f"p/{name}", content)], "path string, content string")
    return [(r.name, r.version, r.line) for r in manifests.dependencies(frame).orderBy("line", "name").collect()]


def test_manifests(spark):
    go = "module m\n\ngo 1.24\nrequire golang.org/x/crypto v0.1.0\nrequire (\n\tgithub.com/pkg/sftp v1.2.3 // indirect\n)\n"
    assert deps(spark, "go.mod", go) == [("golang.org/x/crypto", "v0.1.0", 4), ("github.com/pkg/sftp", "v1.2.3", 6)]
    cargo = '[package]\nname = "x"\n[dependencies]\nring = "0.17"\nrustls = { version = "0.23", features = [] }\nlocal = { path = "../l" }\n[target.x.dependencies]\npem = "1"\n'
    assert deps(spark, "Cargo.toml", cargo) == [("ring", "0.17", 4), ("rustls", "0.23", 5), ("local", "", 6)]
    assert deps(spark, "requirements.txt", "# c\n-r other\ncryptography>=50.1 # pin\n\npynacl\n") == [("cryptography", "50.1", 3), ("pynacl", "", 5)]
    package = '{\n "dependencies": {"node-forge": "^1"},\n "devDependencies": {"tweetnacl": "2"}\n}'
    assert deps(spark, "package.json", package) == [("node-forge", "^1", 2), ("tweetnacl", "2", 3)]
    assert deps(spark, "package.json", "{not json") == []
    pom = "<project><dependencies>\n<dependency>\n<groupId>g</groupId><artifactId>a</artifactId><version>1</version>\n<exclusions><exclusion><groupId>x</groupId><artifactId>y</artifactId></exclusion></exclusions></dependency></dependencies></project>"
    assert deps(spark, "pom.xml", pom) == [("x:y", "1", 2)]


def test_floors_and_catalogue(spark):
    frame = spark.createDataFrame([("a/go.mod", "go 1.25\n"), ("b/go.mod", "go 1.9\n"), ("c/requirements.txt", "cryptography==50.0\ncryptography<99\n"), ("d/pom.xml", "<maven.compiler.release>27</maven.compiler.release>")], "path string, content string")
    got = {(r.path, r.unlocks) for r in manifests.cleared_floors(manifests.declared_versions(frame)).collect()}
    assert got == {("a/go.mod", "ML-KEM"), ("c/requirements.txt", "ML-KEM and ML-DSA"), ("d/pom.xml", "ML-KEM and ML-DSA")}
    names = spark.createDataFrame([("Python", "PyJwt"), ("Python", "cryptography[ssh]"), ("Rust", "ring"), ("Go", "ring")], "ecosystem string, name string")
    assert {r.name for r in manifests.catalogue_matches(names).collect()} == {"PyJwt", "ring"}


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def oid(text):
    first, second, *rest = map(int, text.split("."))
    out = bytes([40 * first + second])
    for n in rest:
        chunk = [n & 0x7F]
        while n := n >> 7:
            chunk.append(n & 0x7F | 0x80)
        out += bytes(reversed(chunk))
    return der(6, out)


def certificate(bits, signature="1.2.840.113549.1.1.5"):
    algorithm = der(0x30, oid(signature), der(5))
    name = der(0x30, der(0x31, der(0x30, oid("2.5.4.3"), der(12, b"example"))))
    modulus = (1 << (bits - 1) | 1).to_bytes(bits // 8, "big")
    key = der(0x30, der(0x30, oid("1.2.840.113549.1.1.1"), der(5)), der(3, b"\0", der(0x30, der(2, b"\0" + modulus), der(2, b"\1\0\1"))))
    dates = der(0x30, der(23, b"240101000000Z"), der(23, b"340101000000Z"))
    body = der(0x30, der(0xA0, der(2, b"\2")), der(2, b"\1"), algorithm, name, dates, name, key)
    return der(0x30, body, algorithm, der(3, b"\0" + b"s" * 8))


def test_certificates(spark):
    import base64

    pem = b"-----BEGIN CERTIFICATE-----\n" + base64.encodebytes(certificate(1536, "1.2.840.113549.1.1.11")) + b"-----END CERTIFICATE-----\n"
    rows = [("a.der", certificate(2048)), ("b.pem", pem), ("c.txt", b"nothing"), ("d", None)]
    got = certs.fields(spark.createDataFrame(rows, "path string, content binary")).cache()
    fields = {r.path: r for r in got.collect()}
    assert fields["a.der"].modulus_bits == 2048 and fields["a.der"].subject_cn == "example"
    found = {(r.location, r.rule_id): r.algorithm_id for r in certs.findings(got).collect()}
    assert found["a.der", "CERT-001"] == "rsa-2048" and found["b.pem", "CERT-001"] == "rsa-undersized"
    assert ("a.der", "CERT-100") in found and ("b.pem", "CERT-100") not in found
    assert {r.path for r in certs.warnings(got).collect()} == {"c.txt", "d"}


def test_call_sites(spark):
    go = 'x := rsa.GenerateKey(rand.Reader, 2048) // rsa.GenerateKey(nil, 1)\ns := "md5.New()"\nassertEquals(md5.New(), f("a,b", g(1)))\n'
    py = "# rsa.generate(1)\nkey = rsa.generate_private_key(public_exponent=65537, key_size=2048)\nhashlib.new('md5', data)\n"
    rows = [("a.go", "go", go), ("b.py", "python", py), ("c.py", "python", None)]
    sites = extract.call_sites(spark.createDataFrame(rows, "path string, lang string, content string")).cache()
    calls = [(r.path, r.callee, r.line) for r in sites.collect()]
    assert calls == [("a.go", "rsa.GenerateKey", 1), ("a.go", "assertEquals", 3), ("a.go", "md5.New", 3), ("a.go", "f", 3), ("a.go", "g", 3), ("b.py", "rsa.generate_private_key", 2), ("b.py", "hashlib.new", 3)]
    args = F.col("args")
    got = {(r.callee, r.line): r for r in sites.select("callee", "line", extract.nth_integer(args, 1).alias("n"), extract.nth_string(args, 0).alias("s"), extract.keyword(args, "key_size")["i"].alias("k"), extract.site_context(F.col("frames"), F.col("lang")).alias("c")).collect()}
    assert got["rsa.GenerateKey", 1].n == 2048 and got["f", 3].s == "a,b"
    assert got["rsa.generate_private_key", 2].k == 2048 and got["hashlib.new", 3].s == "md5"
    assert got["md5.New", 3].c == "Call" and got["hashlib.new", 3].c == "Default"


def test_first_rule_wins(spark):
    rules = classify.from_toml(spark, "go", '[[classify]]\nid="A"\nalgorithm_id="rsa-2048"\nmessage="{n}"\nwhen={api="^r$",args={n={ge=2048}}}\n[[classify]]\nid="B"\nalgorithm_id="md5"\nwhen={api="."}\n')
    rows = [(1, "go", "r", {"n": (4096, None)}, "Call", []), (2, "go", "r", {"n": (None, "4096")}, "Call", []), (3, "rust", "r", {}, "Call", [])]
    frame = spark.createDataFrame(rows, "match_id long, lang string, api string, args map<string,struct<i:bigint,s:string>>, site_context string, imports array<string>")
    assert {(r.match_id, r.rule_id, r.message) for r in classify.classify(frame, rules).collect()} == {(1, "A", "4096"), (2, "B", "")}
    with pytest.raises(ValueError):
        classify.predicate("n", {"above": 1})


def test_sources(spark, tmp_path):
    for name, text in {"src/a.go": "package a", "src/b.txt": "x", "build/c.py": "pass", ".hidden/d.py": "pass", "keep/e.py": "1", "go.mod": "go 1.24"}.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    root = str(tmp_path / "tree")
    got = {r.path.split("/tree/")[1]: r.lang for r in files.source_files(spark, root, ["build/", "# c", "*.py", "!keep/*.py"]).collect()}
    assert got == {"src/a.go": "go", "keep/e.py": "python"}
    # Ignore files are found, and hold below their own folder; the nearest one's last line decides.
    (tmp_path / "tree/.gitignore").write_text("*.go\nbuild/\n")
    (tmp_path / "tree/src/.gitignore").write_text("!a.go\n")
    (tmp_path / "tree/keep/.gitignore").write_text("/e.py\n")
    assert {r.path.split("/tree/")[1] for r in files.source_files(spark, root).collect()} == {"src/a.go"}
    assert files.oversized(spark, root).count() == 0
    assert files.manifest_files(spark, root).count() == 1


def test_rules_from_a_folder(spark, tmp_path):
    rule = '[[classify]]\nid = "CRYPTO-1"\nwhen.api = "^hashlib\\\\.md5$"\nalgorithm_id = "{}"\nmessage = "m"\n'
    (tmp_path / "python.toml").write_text(rule.format("md5"))
    (tmp_path / "cpp.toml").write_text(rule.format("sha-1"))
    assert {(r.lang, r.algorithm_id) for r in classify.from_folder(spark, str(tmp_path)).collect()} == {("python", "md5"), ("c", "sha-1"), ("cpp", "sha-1")}
    with pytest.raises(ValueError, match="unknown algorithm"):
        classify.from_toml(spark, "go", rule.format("md55"))


def test_surface_has_every_api_once(spark):
    apis = [r.api for r in extract.surface(spark).collect()]
    assert apis == sorted(set(apis)) and {"go.alg-switch.none", "crypto/rsa.GenerateKey", "openmls.Ciphersuite"} <= set(apis)


def test_policy_names_known_algorithms_and_buckets():
    with pytest.raises(ValueError, match="unknown algorithms"):
        policy.Policy(name="x", broken=["md55"], **policy.NIST)
    with pytest.raises(ValueError, match="bucket"):
        policy.Policy(name="x", shelf_life_tags={"*.pem": "forever"}, **policy.NIST)


def test_stream_stores_each_batch_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.createDataFrame([finding(i, "rsa-2048") for i in range(5)], FINDING)
    frame.write.parquet(source)
    p = policy.preset("nist-default")
    for _ in range(2):
        scans.store(scans.arriving(spark, source, FINDING), p, out, str(tmp_path / "state")).awaitTermination()
    assert scans.stored(spark, out).count() == 5
    assert {r.severity for r in scans.stored(spark, out, "scan-0").collect()} == {"High"}


def test_probes_and_targets(spark):
    t = spark.createDataFrame([("h:443",)], "target string")
    seen = spark.createDataFrame([("h:443", "X25519", "handshake"), ("h:443", "X25519Kyber768Draft00", "handshake")], "target string, group_name string, outcome string")
    rules = {r.group_name: r.rule_id for r in probes.findings(t, seen).collect()}
    assert rules["X25519"] == "NET-001" and rules["X25519Kyber768Draft00"] == "NET-100" and rules["secp521r1"] == "NET-900"
    host, port = probes.target(F.col("x"))
    frame = spark.createDataFrame([("a:b:70000",), ("::1:22",), ("none",)], "x string")
    assert [tuple(r) for r in frame.select(host, port).collect()] == [("a:b", None), ("::1", 22), ("", None)]


def test_scope_and_precision(spark):
    f = spark.createDataFrame([("p", "a/b/c.go"), ("p", "ab/x.go")], "project string, path string")
    s = spark.createDataFrame([("p", "a"), ("p", "a/b")], "project string, scope string")
    assert [r.path for r in corpus.in_scope(f, s).collect()] == ["a/b/c.go"]
    audit = spark.createDataFrame([("s", "TP")] * 9 + [("s", "FP"), ("s", "DEPENDS")], "stratum string, verdict string")
    assert corpus.precision(audit).first().p == 0.9


def test_imports_and_settings(spark):
    py = "from hashlib import md5 as m, sha1\nm(b'')\n"
    js = "import { createHash as h } from 'node:crypto'\nconst { randomBytes, createHmac: mac } = require('crypto')\nh('md5'); mac('x')\n"
    c = 'SSL_CTX_set1_groups_list(ctx, "*X25519:?P-256/DEFAULT:");'
    java = 'System.setProperty("jdk.tls.namedGroups", "x25519, secp256r1,");'
    rows = [("a.py", "python", py), ("b.js", "javascript", js), ("c.cpp", "cpp", c), ("d.java", "java", java)]
    files_ = spark.createDataFrame(rows, "path string, lang string, content string")
    found = {(r.path, r.callee) for r in extract.resolved(extract.call_sites(files_), files_).collect()}
    assert {("a.py", "hashlib.md5"), ("b.js", "crypto.createHash"), ("b.js", "crypto.createHmac")} <= found
    listed = {(r.path, r.value) for r in shapes.listed_settings(files_).collect()}
    assert listed == {("c.cpp", "X25519"), ("c.cpp", "P-256"), ("d.java", "x25519"), ("d.java", "secp256r1")}


def test_projects_and_paths(spark, tmp_path):
    (tmp_path / "p.toml").write_text('canonical_id = "x/y"\nname = "y"\necosystem = "pypi"\nscan_paths = ["src"]\n')
    row = files.project_manifests(spark, str(tmp_path)).first()
    assert row.canonical_id == "x/y" and row.scan_paths == ["src"] and row.unscannable is None
    paths = spark.createDataFrame([("/r/go.mod",), ("/r/a/Cargo.toml",), ("/r/a/b/pom.xml",)], "path string")
    assert {(r.token, r.label) for r in files.ecosystems(paths, "/r").collect()} == {("go", "Go (modules)"), ("rust", "Rust (crates.io)")}
    got = [r[0] for r in spark.createDataFrame([("/r/a/b",), ("c/d",), ("/x/y",)], "p string").select(files.relative_path(F.col("p"), "/r")).collect()]
    assert got == ["a/b", "c/d", None]


def test_component_problems(spark):
    frame = spark.createDataFrame([finding(0, "rsa-2048")], FINDING)
    found = documents.components(frame)
    assert documents.component_problems(found).count() == 0
    assert documents.component_problems(found.withColumn("name", F.lit(""))).first().problem == "no name"


def test_captures(spark):
    text = 'f("md5", 2048, tls.X, g.h(1), mode)\nk({name: "AES-GCM", hash: {name: "SHA-256"}})\nJWSAlgorithm.RS256; x.JWSAlgorithm.ES256\nq := oqs.Signature{}\n'
    files_ = spark.createDataFrame([("a.go", "go", text)], "path string, lang string, content string")
    sites = extract.call_sites(files_).withColumn("api", F.col("callee"))
    table = spark.createDataFrame([("go", "f", 0, "string", "name"), ("go", "f", 1, "integer", "bits"), ("go", "f", 2, "member", "curve"), ("go", "f", 4, "string", "absent")], "lang string, api string, slot int, extractor string, name string")
    got = {r.api: r.captured for r in extract.captures(sites, table).collect()}
    assert {k: (v.i, v.s) for k, v in got["f"].items()} == {"name": (None, "md5"), "bits": (2048, None), "curve": (None, "X")}
    assert got["k"] == {}
    args = F.col("args")
    f = sites.where("callee = 'f'").select(extract.nth_attribute(args, 2, F.array(F.lit("tls"))).alias("a"), extract.literal_or_symbol(args, 4)["symbol"].alias("s"), extract.passes(args, "tls.X").alias("p"), extract.nth_member(args, 3).alias("m")).first()
    assert tuple(f) == ("X", "mode", True, "h")
    k = sites.where("callee = 'k'").select(extract.property_of(args, 0, "name").alias("n"), extract.property_of(args, 0, "hash").alias("h")).first()
    assert tuple(k) == ("AES-GCM", "SHA-256")
    assert [(r.owner, r.member) for r in shapes.constants(files_, ["JWSAlgorithm"]).collect()] == [("JWSAlgorithm", "RS256")]
    assert [r.type for r in shapes.composites(files_, ["oqs.Signature"]).collect()] == ["oqs.Signature"]
    own = spark.createDataFrame([("a.go", "go", 'import "crypto/mldsa"\nfunc f(k *mldsa.PrivateKey) {}'), ("b.go", "go", 'import "crypto/mldsa"\nvar k = mldsa.GenerateKey()'), ("c.go", "go", '// import "crypto/mldsa"')], "path string, lang string, content string")
    assert {tuple(r) for r in shapes.foreign_keys(own, "crypto/mldsa", ["mldsa.GenerateKey"]).collect()} == {("a.go", True), ("b.go", False)}
