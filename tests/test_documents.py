"""Schema validation, documents written in parts, checkouts."""

import json

import pytest

from cipherscope.plans import validation

SCHEMA = {
    "type": "object",
    "required": ["id", "rule", "place"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 2, "maxLength": 5},
        "rule": {"type": "string", "pattern": "^R-[0-9]{3}$"},
        "place": {"$ref": "#/$defs/Place"},
        "level": {"enum": ["high", "low", None, 3]},
        "score": {"type": "number", "minimum": 0, "maximum": 1.5},
        "count": {"type": "integer", "exclusiveMinimum": 0},
        "tags": {"type": "array", "items": {"type": "string"}, "minItems": 1, "uniqueItems": True},
        "more": {"type": "object", "additionalProperties": {"type": ["integer", "null"]}, "propertyNames": {"pattern": "^[a-z]+$"}},
        "kind": {"const": "x"},
        "either": {"oneOf": [{"type": "string"}, {"type": "object", "required": ["a"]}]},
        "tree": {"$ref": "#/$defs/Tree"},
        "it's": {"type": "boolean"},
    },
    "$defs": {"Place": {"type": "object", "required": ["path"], "properties": {"path": {"type": "string"}, "line": {"type": "integer", "minimum": 1}}}, "Tree": {"type": "object", "properties": {"n": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/Tree"}}}}},
}
GOOD = {"id": "ab", "rule": "R-123", "place": {"path": "a"}}
CASES = [
    (GOOD, []),
    (GOOD | {"level": None, "score": 1, "count": 3.0, "tags": ["a", "b"], "more": {"a": 1, "b": None}, "kind": "x", "either": {"a": 1}, "it's": True}, []),
    ({**GOOD, "id": "a"}, [("/id", '"a" is shorter than 2 characters')]),
    ({**GOOD, "id": 7}, [("/id", '7 is not of type "string"')]),
    ({**GOOD, "rule": "R-12"}, [("/rule", '"R-12" does not match "^R-[0-9]{3}$"')]),
    ({"id": "ab", "rule": "R-123"}, [("", '"place" is a required property')]),
    ({**GOOD, "place": {"path": "a", "line": 0}}, [("/place/line", "0 is less than the minimum of 1")]),
    ({**GOOD, "place": {}}, [("/place", '"path" is a required property')]),
    ({**GOOD, "zz": 1, "aa": 2}, [("", "Additional properties are not allowed ('aa', 'zz' were unexpected)")]),
    ({**GOOD, "level": "medium"}, [("/level", '"medium" is not one of ["high","low",null,3]')]),
    ({**GOOD, "score": 2}, [("/score", "2 is greater than the maximum of 1.5")]),
    ({**GOOD, "count": 1.5}, [("/count", '1.5 is not of type "integer"')]),
    ({**GOOD, "count": 0}, [("/count", "0 is less than or equal to the minimum of 0")]),
    ({**GOOD, "tags": []}, [("/tags", "[] has less than 1 items")]),
    ({**GOOD, "tags": ["a", 1, "a"]}, [("/tags/1", '1 is not of type "string"'), ("/tags", '["a",1,"a"] has non-unique elements')]),
    ({**GOOD, "more": {"a": "x"}}, [("/more/a", '"x" is not of types "integer", "null"')]),
    ({**GOOD, "more": {"A": 1}}, [("/more", '"A" does not match "^[a-z]+$"')]),
    ({**GOOD, "kind": "y"}, [("/kind", '"x" was expected')]),
    ({**GOOD, "either": 1}, [("/either", "1 is not valid under any of the schemas listed in 'oneOf'")]),
    ({**GOOD, "it's": 1}, [("/it's", '1 is not of type "boolean"')]),
    ({**GOOD, "tree": {"kids": [{"n": 1}, {"kids": [{"n": "x"}]}]}}, [("/tree/kids/1/kids/0/n", '"x" is not of type "integer"')]),
    ([], [("", '[] is not of type "object"')]),
]


def test_schema(spark):
    rows = [(i, json.dumps(d)) for i, (d, _) in enumerate(CASES)] + [(90, None), (91, "{"), (92, "")]
    found = {r.id: r for r in validation.validated(spark.createDataFrame(rows, "id int, value string"), SCHEMA).collect()}
    for i, (_, want) in enumerate(CASES):
        assert (found[i].valid, found[i].n_problems) == (not want, len(want)), (i, found[i])
        assert found[i].samples == " | ".join(f"{p}: {m}" for p, m in want)
    assert found[90].valid is None and found[91].samples == ": not JSON" and not found[92].valid
    deep = {"kids": []}
    for _ in range(9):
        deep = {"kids": [deep]}
    row = validation.validated(spark.createDataFrame([(json.dumps({**GOOD, "tree": deep}),)], "value string"), SCHEMA).first()
    assert not row.valid and "nested deeper than 4 times" in row.samples
    with pytest.raises(ValueError):
        validation.validated(spark.createDataFrame([("1",)], "value string"), {"contains": {}})
    assert len(validation.checked_patterns(SCHEMA)) == 2


FINDING = "seq long, rule_id string, algorithm_id string, location string, line int, snippet string, message string, confidence string, usage_context string, exposure string, shelf_life_bucket string"


def finding(seq, algorithm, line=3):
    return (seq, f"R-{seq % 3}", algorithm, f"src/é{seq}.go", line, f' x("{seq}")\n', "m", "literal_arg", "hashing", "public_internet", "long")


def test_one_cyclonedx_document(spark, tmp_path):
    from cipherscope.plans import documents

    rows = [finding(n, ["md5", "rsa-2048", "md5", "unknown"][n % 4], None if n % 5 == 0 else n) for n in range(400)]
    path = f"file://{tmp_path}/bom.json"
    for _ in range(2):  # a second run replaces the first
        documents.write_cbom(spark.createDataFrame(rows, FINDING).repartition(7), path, "src", "2026-01-01T00:00:00Z")
    bom = json.loads((tmp_path / "bom.json").read_text())
    assert [c["name"] for c in bom["components"]] and bom["specVersion"] == "1.7"
    for c, name in zip(bom["components"], ["md5", "rsa-2048"]):
        assert c["bom-ref"].startswith(f"crypto/algorithm/{name}")
        want = [(r[3], r[4], r[5]) for r in rows if r[2] == name]
        assert [(o["location"], o.get("line"), o["additionalContext"]) for o in c["evidence"]["occurrences"]] == want
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["bom.json"]
    documents.write_cbom(spark.createDataFrame([], FINDING), f"file://{tmp_path}/none.json", "src", "t")
    assert json.loads((tmp_path / "none.json").read_text())["components"] == []


def test_one_sarif_document(spark, tmp_path):
    from cipherscope.operators import risk
    from cipherscope.plans import documents
    from cipherscope.policy import preset

    scored = risk.score(spark.createDataFrame([finding(n, ["md5", "rsa-2048", "unknown"][n % 3]) for n in range(100)], FINDING).repartition(5), preset("nist-default"))
    documents.write_sarif(scored, f"file://{tmp_path}/a.sarif")
    run = json.loads((tmp_path / "a.sarif").read_text())["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["R-0", "R-1", "R-2"]
    assert [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in run["results"]] == [f"src/é{n}.go" for n in range(100)]
    assert all(run["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for r in run["results"])


def test_lines_by_project(spark, tmp_path):
    from cipherscope.plans import documents

    rows = [(["a/b", "c"][n % 2], n, f"line {n}") for n in range(20)]
    documents.write_by_project(spark.createDataFrame(rows, "project string, seq long, value string"), f"{tmp_path}/out")
    got = [line for f in sorted((tmp_path / "out/project=c").glob("*.txt")) for line in f.read_text().splitlines()]
    assert got == [f"line {n}" for n in range(1, 20, 2)]


# Checkouts


def git(folder, *args):
    import subprocess

    who = ["-c", "user.name=t", "-c", "user.email=t@example.org", "-c", "init.defaultBranch=main", "-c", "commit.gpgsign=false"]
    return subprocess.run(["git", "-C", str(folder), *who, *args], check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture
def clones(tmp_path):
    root, pins = tmp_path / "clones", {}
    for name in ("ok", "drift", "off", "unpinnable", "scope", "bad", "packed", "v4"):
        (root / name / "src/deep").mkdir(parents=True)
        (root / name / "src/a.go").write_text("package a\n")
        (root / name / "src/deep/_b.py").write_text("é")
        (root / name / "README").write_text("read")
        git(root / name, "init", "-q")
        if name == "v4":
            git(root / name, "config", "index.version", "4")
        git(root / name, "add", ".")
        git(root / name, "commit", "-qm", "one")
        pins[name] = git(root / name, "rev-parse", "HEAD")
    git(root / "off", "commit", "-qm", "two", "--allow-empty")
    git(root / "packed", "commit", "-qm", "two", "--allow-empty")
    git(root / "packed", "gc", "-q")
    git(root / "packed", "pack-refs", "--all")
    git(root / "packed", "checkout", "-q", pins["packed"])
    git(root / "v4", "update-index", "--index-version", "4")
    (root / "empty").mkdir()
    git(root / "empty", "init", "-q")
    (root / "gone").mkdir()
    pins["unpinnable"] = "0" * 40
    import os

    os.symlink(root, root / "ok/src/loop")
    return root, pins


def test_census_of_checkouts(spark, clones):
    from cipherscope.operators import corpus
    from cipherscope.sources import checkouts

    root, pins = clones
    names = ["ok", "drift", "off", "unpinnable", "scope", "bad", "packed", "v4", "empty", "gone"]
    rows = [(n, f"{root}/{n}/", pins.get(n), {"scope": ["src", "lib"], "v4": ["."], "packed": ["src/", "src/deep"]}.get(n, ["src"]), "too large" if n == "bad" else None) for n in names]
    projects = spark.createDataFrame(rows, "project string, root string, pin string, scan_paths array<string>, unscannable string")
    found = checkouts.inspected(projects, str(root))
    counts = {r.project: (r.files, r.bytes) for r in found.collect()}
    assert counts["ok"] == counts["packed"] == (2, 12) and counts["v4"] == (3, 16) and counts["gone"] == (0, 0)
    baseline = spark.createDataFrame([(n, *counts[n]) for n in names if n != "drift"] + [("drift", 2, 13)], "project string, files long, bytes long")
    states = {r.project: r.state for r in corpus.integrity(found, baseline).collect()}
    assert states == {"ok": "ok", "drift": "drift", "off": "off-sha", "unpinnable": "unpinnable", "scope": "scope-missing", "bad": "unscannable", "packed": "ok", "v4": "ok", "empty": "empty", "gone": "absent"}
    tracked = {(r.project, r.file, r.size) for r in checkouts.tracked_files(projects).where("project IN ('v4', 'ok', 'empty')").collect()}
    assert tracked == {(n, f, s) for n in ("v4", "ok") for f, s in (("README", 4), ("src/a.go", 10), ("src/deep/_b.py", 2))}
    assert all(r.sha == git(root / "ok", "rev-parse", f"HEAD:{r.file}") for r in checkouts.tracked_files(projects).where("project = 'ok'").collect())
