"""The distributed listing, ignore files and large files."""

import re

import pytest

from cipherscope.sources import files


def tree(root, names, text="x"):
    for name in names:
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def below(frame, root):
    return {r.path[len(root) + 1 :] for r in frame.collect()}


def test_names_that_spark_hides_are_listed(spark, tmp_path):
    root = tree(tmp_path / "t", ["__init__.py", "_ssl.py", "a.py", "_build/c.py", ".hidden/d.py", ".e.py", "x/y/z/_w/v.go", "empty.py", "a b/ü.py"])
    (tmp_path / "t/empty.py").write_text("")
    (tmp_path / "t/none").mkdir()
    assert below(files.source_files(spark, root), root) == {"__init__.py", "_ssl.py", "a.py", "_build/c.py", "x/y/z/_w/v.go", "empty.py", "a b/ü.py"}
    assert below(files.walk(spark, root, hidden=True), root) >= {".hidden/d.py", ".e.py"}
    assert below(files.walk(spark, f"{root}/a.py"), root) == {"a.py"}
    assert files.walk(spark, f"{root}/none").count() == 0


def test_ignore_files(spark, tmp_path):
    root = tree(tmp_path / "t", ["a.py", "a.pyc", "a.pyo", "a.pyd", "#b.py", "!c.py", "out/d.py", "out/keep/e.py", "lib/f.py", "lib/g.py", "lib/sub/f.py", "deep/x/y/log.py", "sp ace.py", "w[1].py", "q1.py", "q9.py", "qa.py"])
    (tmp_path / "t/.gitignore").write_text("*.py[co]\n\\#b.py\n\\!c.py\nout/\n!out/keep/e.py\n/lib/f.py\ndeep/**/log.py\nsp\\ ace.py\t \nq[!1-8].py\n# a comment\n")
    (tmp_path / "t/lib/.gitignore").write_text("*.py\n!g.py\n")
    (tmp_path / "t/lib/sub/.gitignore").write_text("!f.py\n")
    assert below(files.walk(spark, root, ignoring=True), root) == {"a.py", "a.pyd", "lib/g.py", "lib/sub/f.py", "w[1].py", "q1.py"}
    assert "out/keep/e.py" not in below(files.walk(spark, root, ignoring=True), root)  # its folder is never entered
    assert below(files.walk(spark, root, more=["*.py", "!q?.py"]), root) == {"a.pyc", "a.pyo", "a.pyd", "q1.py", "q9.py", "qa.py"}


@pytest.mark.parametrize(
    ("line", "hits", "misses"),
    [
        ("*.py[co]", ["a.pyc", "x/b.pyo"], ["a.py", "a.pyd"]),
        ("[a-c]x", ["ax", "d/bx/"], ["dx", "x"]),
        ("[!a]x", ["bx"], ["ax", "/x"]),
        ("a[", ["a["], ["a"]),
        ("\\#x", ["#x"], ["x"]),
        ("doc/*.txt", ["doc/a.txt"], ["doc/b/a.txt", "x/doc/a.txt"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["a/xb"]),
        ("build/", ["build/", "x/build/"], ["build"]),
        ("a.b", ["a.b"], ["axb"]),
        ("x[]y]z", ["x]z", "xyz"], ["xz"]),
    ],
)
def test_ignore_lines(line, hits, misses):
    pattern, negated = files.ignore_pattern(line)
    assert not negated and all(re.search(pattern, h) for h in hits) and not any(re.search(pattern, m) for m in misses)
    assert files.ignore_pattern("!" + line) == (pattern, True)


def test_sizes(spark, tmp_path, monkeypatch):
    root = tree(tmp_path / "t", ["a.py", "_b.py"])
    with open(f"{root}/_big.py", "wb") as f:
        f.truncate(files.MOST_BYTES + 1)
    assert below(files.source_files(spark, root), root) == {"a.py", "_b.py"}
    assert [r.path[len(root) + 1 :] for r in files.oversized(spark, root).collect()] == ["_big.py"]


def pem(n):
    return b"-----BEGIN CERTIFICATE-----\n" + (b"%03d" % n) * 40 + b"\n-----END CERTIFICATE-----\n"


def test_blocks_over_the_borders_of_ranges(spark, tmp_path):
    path = tmp_path / "many.pem"
    path.write_bytes(b"".join(b" " * (7 * n % 31) + pem(n) for n in range(60)) + b"-----BEGIN CERTIFICATE-----\nnever closed")
    listed = files.walk(spark, str(path))
    for size in (40, 173, 1 << 20):
        found = sorted((r.offset, bytes(r.content)) for r in files.pem_blocks(listed, range_bytes=size).collect())
        assert [c for _, c in found] == [pem(n) for n in range(60)]


def test_a_file_of_three_gib(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    with open(folder / "_huge.bin", "wb") as f:
        f.truncate(3 << 30)
        for at, n in ((files.RANGE_BYTES - 20, 1), ((3 << 30) - 500, 2)):
            f.seek(at)
            f.write(pem(n))
    (folder / ".small.der").write_bytes(b"\x30\x00")
    got = sorted(bytes(r.content) for r in files.certificate_files(spark, str(folder)).collect())
    assert got == sorted([pem(1), pem(2), b"\x30\x00"])
