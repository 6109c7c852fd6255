"""The lexer's modes, the node table, and what is read off it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherscope.functions.lexing import COMMENT, STRING, literals
from cipherscope.functions.nodes import Source
from cipherscope.operators import extract, shapes

FILES = "path string, lang string, content string"


def calls(text, lang):
    source = Source([text.encode()], lang)
    return [source.callee[i].decode() for i in np.flatnonzero(source.called)]


def frames(text, lang, callee):
    source = Source([text.encode()], lang)
    _, columns = extract.sites_of(source)
    return columns["frames"][columns["callee"].to_pylist().index(callee)].as_py()


@pytest.mark.parametrize(
    ("lang", "text", "found"),
    [
        ("rust", "let k: Key<'a> = Rsa::generate(2048); let y: &'a str = z();", ["Rsa::generate", "z"]),
        ("rust", 'f(r#"g("x")"#, \'"\', b\'\\\'\'); /* a /* h() */ i() */ j::<Vec<u8>>(1)', ["f", "j"]),
        ("rust", "fn f(x: u8) { match x { Some(v) => g(v), Foo::Bar(1) => h() } } struct T(u8); enum E { A(u8), B(f64) } if let Ok(q) = w() {}", ["g", "h", "w"]),
        ("javascript", "/'/; crypto.createHash('md5'); 'a'", ["crypto.createHash"]),
        ("javascript", "`${crypto.createHash('md5')}` + `a${ {b: `${f(`)`)}`} }c(` + g()", ["crypto.createHash", "f", "g"]),
        ("javascript", "x = a / f(1) / g; return /[/'\"]/.test(h(2)) // i()", ["f", "test", "h"]),
        ("javascript", "class A { m(x) { return f(x) } async n() {} get o() { } } function p(a) {} const q = { r(s) { t() } }", ["f", "t"]),
        ("typescript", "class A { m(x: B): C { return f<D>(x) } abstract n(): void; }", ["f"]),
        ("python", 'f"{hashlib.md5(b\'a\')}" + f"{{no()}} {x:{w(1)}}" + rb"\\"q()" + \'\'\'r()\'\'\' # s()', ["hashlib.md5", "w"]),
        ("python", "def md5(x):\n    return sha1(x)\nclass A(b(1)):\n    pass\nasync def f(): await g()\n", ["sha1", "b", "g"]),
        ("cpp", "1'000; RSA_generate_key_ex(a); 2'000; c = '\"'; R\"x(f()\")x\"; g(u8\"\\\"h()\")", ["RSA_generate_key_ex", "g"]),
        ("c", "int MD5_Init(MD5_CTX *c);\nextern const EVP_MD *EVP_md5(void);\n#define RUN(x) \\\n  go(x)\nint main(void) { return MD5_Init(&c) ? f() : -1; }", ["go", "MD5_Init", "f"]),
        ("c", "// a \\\n f()\ng();\nif (x) h(1); else i(2); p = (T) j(3); k(4) ; l = sizeof(int) * m(5);", ["g", "h", "i", "j", "k", "m"]),
        ("csharp", '@"C:\\"; RSA.Create(2048); "x"; $"a{f("b")}c" + $@"x""{g()}" + """h() "q" """', ["RSA.Create", "f", "g"]),
        ("csharp", "class A { public A(int x) : base(x) {} int F<T>(T x) => g(x); [Foo] void H() { I<J>(K); } }", ["g", "I"]),
        ("java", 'class A { byte[] digest(byte[] x) throws E { return new X<String>(1).d(2); } @Foo("a") public A(int x) { super(x); } Map<String, List<B>> m(int a); }', ["new X", "d", "super"]),
        ("java", '"""f() "g()" """ + h()', ["h"]),
        ("go", "func NewCipher(k []byte) {}\nfunc (r *T) Sum(x int) int { return md5.Sum(x) }\ntype I interface { Close(x int) error; Size() int }\nvar _ = `f()` + g[int]('\"')", ["md5.Sum", "g"]),
    ],
)
def test_calls_are_found_and_declarations_are_not(lang, text, found):
    assert calls(text, lang) == found


def test_no_place_is_too_far_away():
    far = " " * 5000 + "/* " + "x" * 5000 + " */"
    source = Source([f"new X(1){far}.d(2)".encode()], "java")
    _, columns = extract.sites_of(source)
    assert columns["root"].to_pylist() == ["new X", "new X"]
    assert frames(f"const x = {far} f(1)", "javascript", "f") == ["declaration"]
    assert frames(f"m := map[string]int{{ \"k\" : {far} f(1)}}", "go", "f")[0] == "pair"
    assert frames(f"if f(1) {far} == {far} y {{}}", "go", "f")[0] == "compare"
    assert frames(f"a({far} b(c))", "go", "b") == ["call:a"]


def test_arguments_of_every_kind():
    source = Source([b'f("a,b", -12, k=g(1, 2), x.y, [1, 2], /* c */ z, "p" + "q", lambda: 3,)'], "javascript")
    _, columns = extract.sites_of(source)
    got = [(a["kind"], a["kw"], a["text"]) for a in columns["args"][0].as_py()]
    assert got == [("str", None, '"a,b"'), ("int", None, "-12"), ("call", "k", "g(1, 2)"), ("name", None, "x.y"), ("other", None, "[1, 2]"), ("name", None, "z"), ("other", None, '"p" + "q"'), ("int", "lambda", "3")]
    assert columns["args"][0].as_py()[0]["s"] == "a,b" and columns["args"][0].as_py()[1]["i"] == -12


def test_files_do_not_reach_into_each_other():
    """Open brackets and literals end with their file; places are counted in characters of their own file."""
    texts = ["f(g(", "é = h('ü', 1)\n  k()", '"open', ")) l()", "", "x = `a${ m("]
    together = Source([t.encode() for t in texts], "javascript")
    file, columns = extract.sites_of(together)
    alone = []
    for n, t in enumerate(texts):
        _, own = extract.sites_of(Source([t.encode()], "javascript"))
        alone += [(n, *(own[c][i].as_py() for c in own)) for i in range(len(own["callee"]))]
    assert [(n, *(columns[c][i].as_py() for c in columns)) for i, n in enumerate(file.tolist())] == alone
    assert [(r[1], r[3], r[4]) for r in alone] == [("f", 1, 0), ("g", 1, 2), ("h", 1, 4), ("k", 2, 16), ("l", 1, 3), ("m", 1, 9)]


@pytest.mark.parametrize("lang", ["c", "cpp", "csharp", "go", "java", "javascript", "python", "rust", "typescript", "", "cobol"])
def test_any_text_is_scanned(lang):
    rng = random.Random(lang)
    parts = ["(", ")", "{", "}", "[", "]", ",", ";", '"', "'", "`", "${", "/*", "*/", "//", "#", "\n", " ", "f", "new X", ".", "::", "=", "==", ":", "1'0", "r#", '"""', "@\"", '$"', "f'", "é", "\\", "\x00", "<", ">", "=>", "func ", "enum E "]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))).encode()
        spans = literals(text, lang)
        assert all(a < b for a, b, *_ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and (not spans or spans[-1][1] <= len(text))
        source = Source([text.replace(b"\0", b" "), b"ok(1)"], lang)
        file, columns = extract.sites_of(source)
        assert columns["callee"][len(columns["callee"]) - 1].as_py() == "ok" and file[-1] == 1
        assert (source.close >= source.open).all()


def test_node_intervals(spark):
    text = "class A { int f(int x) { g(h(1), new B[] {2}); } }"
    got = shapes.nodes(spark.createDataFrame([("a", "java", text), ("b", "java", None)], FILES)).collect()
    assert {r.path for r in got} == {"a"}
    by = {r.callee or r.kind: r for r in got}
    assert by["f"].declares and not by["g"].declares
    inside = lambda x, y: by[y].pre < by[x].pre and by[x].post <= by[y].post
    assert inside("h", "g") and inside("list", "g") and not inside("g", "f") and by["h"].parent == by["g"].pre


def test_settings_of_the_named_apis_only(spark):
    rows = [
        ("a.go", "go", '// MinVersion: tls.VersionTLS10\ns := "MinVersion: tls.VersionTLS11"\nc := tls.Config{MinVersion: /* x */ tls.VersionTLS12, CurvePreferences: []tls.CurveID{ // P256\n tls.X25519, other}}'),
        ("b.java", "java", "x.addIfSupported(v, c, new int[]{NamedGroup.a}); TlsUtils.addIfSupported(v, new int[]{NamedGroup.b}); TlsUtils.addIfSupported(v, c, new int[]{ NamedGroup.d, /* NamedGroup.e */ f });\nkem.newEncapsulator(k); this.kem.newDecapsulator(p); // k.newEncapsulator(x)"),
        ("c.c", "c", 'SSL_CONF_cmd(ctx, "groups", "?A:-B"); SSL_CONF_cmd(ctx, "Curves", v); /* SSL_set1_groups_list(s, "C") */'),
        ("d.rs", "rust", "P { kx_groups: vec![a::X, Y], z: 1 } // SignatureScheme::ML_DSA_44"),
    ]
    got = {(r.path, r.api, r.value, r.line) for r in shapes.listed_settings(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {
        ("a.go", "crypto/tls.Config.MinVersion", "VersionTLS12", 3), ("a.go", "crypto/tls.Config.CurvePreferences", "X25519", 4),
        ("b.java", "org.bouncycastle.tls.NamedGroup", "d", 1), ("b.java", "org.bouncycastle.tls.NamedGroup", "f", 1),
        ("b.java", "javax.crypto.KEM.newEncapsulator", "", 2), ("b.java", "javax.crypto.KEM.newDecapsulator", "", 2),
        ("c.c", "openssl.SSL_CTX_set1_groups_list", "A", 1), ("c.c", "openssl.SSL_CTX_set1_groups_list", "B", 1),
        ("d.rs", "rustls.CryptoProvider.kx_groups", "X", 1), ("d.rs", "rustls.CryptoProvider.kx_groups", "Y", 1),
    }
    known = {r.api for r in extract.surface(spark).collect()}
    assert {api for _, api, _, _ in got} <= known


def test_imports_in_brackets(spark):
    text = "from hashlib import (md5,  # old\n    sha1 as s,\n)\nfrom a.b import c\nmd5(x); s(y); c(z)\n"
    files = spark.createDataFrame([("a.py", "python", text)], FILES)
    assert [r.callee for r in extract.resolved(extract.call_sites(files), files).orderBy("offset").collect()] == ["hashlib.md5", "hashlib.sha1", "a.b.c"]


def test_members_outside_comments_and_literals(spark):
    text = 'a = SignatureAlgorithm.RS256; // SignatureAlgorithm.NO\nString s = "SignatureAlgorithm.NO"; b = SignatureAlgorithm\n  .HS512;'
    assert [(r.member, r.line) for r in shapes.constants(spark.createDataFrame([("a", "java", text)], FILES), ["SignatureAlgorithm"]).collect()] == [("RS256", 1), ("HS512", 2)]


def test_calls_that_must_fail(spark):
    py = "with pytest.raises(\n        ValueError):\n    jwt.encode(\n        a,\n        b)\nwith pytest.raises(X): one()\nwith pytest.raises(X):\n    two()\n    three()\nwith open(f):\n    four()\n"
    js = "expect(() => { jwt.sign(a) })\n  .to.throw(E); expect(() => ok(1)).toThrow(); expect(fine()).toBe(1); expect(() => { a(); b() }).toThrow()"
    files = spark.createDataFrame([("a.py", "python", py), ("b.js", "javascript", js)], FILES)
    found = extract.with_context(extract.call_sites(files), files).where("context = 'TestAssertion'")
    got = {(r.path, r.callee) for r in found.where(~F.col("callee").isin("expect")).collect()}
    assert {("a.py", "jwt.encode"), ("a.py", "one"), ("b.js", "jwt.sign"), ("b.js", "ok")} <= got
    assert not {("a.py", "two"), ("a.py", "three"), ("a.py", "four")} & got
    assert len(shapes.asserted_to_fail(files).where("path = 'b.js'").collect()) == 2


def test_rust_member_argument(spark):
    files = spark.createDataFrame([("a.rs", "rust", "f(&ring::ALG::P256, g::<u8>(1), Type::NEW)")], FILES)
    args = F.col("args")
    got = extract.call_sites(files).where("callee = 'f'").select(*[extract.nth_member(args, i) for i in range(3)]).first()
    assert tuple(got) == ("P256", "g", "NEW")


def test_kinds_of_literals():
    kinds = lambda text, lang: [(k, text.encode()[c:d].decode()) for _, _, k, c, d in literals(text.encode(), lang)]
    assert kinds("'\\'' # 'x'", "python") == [(STRING, "\\'"), (COMMENT, "# 'x'")]
    assert kinds('LR"d(a)"b)d" /* "c" */', "cpp") == [(STRING, 'a)"b'), (COMMENT, '/* "c" */')]
    assert kinds('br##"a"#b"## "c\nd"', "rust") == [(STRING, 'a"#b'), (STRING, "c\nd")]
    assert kinds('"not closed\n"x"', "java") == [(STRING, "x")]
