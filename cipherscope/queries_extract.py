"""Registered queries over source texts: each row of a table fills a template of its language, and the SQL states, template
by template, the rows that must be found (written down by hand, not derived from the operators)."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dims
from .operators import certs, extract, manifests, shapes
from .queries import _text, pick, read, register

COLUMNS = ("key", "api", "value", "line")


#: What may stand before a template without adding a row: comments, literals and declarations full of calls, by language.
NOISE = {
    "go": ["", "// md5.New() rsa.GenerateKey(rand.Reader, 1)\n/* &tls.Config{MinVersion: tls.VersionTLS10} */\n", "var _ = `md5.New()\necdh.P256()`\n", "func GenerateKey(r io.Reader, n int) error { return nil }\ntype sum interface {\n\tNew(x int) error\n}\n"],
    "python": ["", "# hashlib.md5(b'x') '\n", "x0 = '''hashlib.sha1(b)\nec.generate_private_key(c)'''\n", "def md5(x, y=(1, 2)):\n    return x\nclass sha1(Base):\n    pass\n"],
    "java": ["", "/* MessageDigest.getInstance(\"MD5\")\n * new AESEngine() ' */\n", "String q0 = \"new AESEngine(); Cipher.getInstance(\\\"\"; char c0 = '\"';\n", "interface I0 {\n  byte[] getInstance(String s) throws E;\n}\n"],
    "javascript": ["", "// crypto.createHash('md5') `\n", "const s0 = '//', r0 = /createHash\\('md5'\\)[/']/, t0 = `crypto.createHash('x')`;\n", "function createHash(a) {}\nclass K0 {\n  sign(x) {}\n}\n"],
    "csharp": ["", "// RSA.Create(1) \"\n", "var s0 = @\"C:\\\"; var t0 = \"RSA.Create(1)\";\n", "interface I0 { RSA Create(int n); }\n"],
    "c": ["", "/* MD5_Init(&c); ' */\n", "const char *s0 = \"MD5_Init(&c)\"; char q0 = '\"';\n", "int MD5_Init(MD5_CTX *c);\nextern int RSA_generate_key_ex(RSA *rsa, int bits);\n"],
    "rust": ["", "// Rsa::generate(1) \"\n/* /* Rsa::generate(2) */ */\n", "const S0: &'static str = r#\"Rsa::generate(\"1\")\"#;\n", "fn generate<'a>(x: &'a str) -> u8 { 0 }\nenum E0 { digest(u8) }\n"],
}
NOISE |= {"typescript": NOISE["javascript"], "cpp": NOISE["c"]}


def sources(spark, sf_dir, table: str, key: str, lang: str, texts: list[str], name: str = "", noisy: bool = True) -> DataFrame:
    """path, lang, content: a file a row, from the templates in turn, each behind one of its language's NOISE in turn; {n} is
    the row's key."""
    k, noise = F.col(key), NOISE.get(lang, [""]) if noisy else [""]
    before = pick(noise, F.floor(k / len(texts)) % len(noise))
    text = F.replace(F.concat(before, pick(texts, k % len(texts))), F.lit("{n}"), k.cast("string"))
    rows = read(spark, sf_dir, table).select(key).repartition(spark.sparkContext.defaultParallelism)  # short keys become long texts
    return rows.select(F.concat(F.lit("src/"), k.cast("string"), F.lit(name)).alias("path"), F.lit(lang).alias("lang"), text.alias("content"))


def keyed(found: DataFrame) -> DataFrame:
    return found.select(F.split("path", "/")[1].cast("long").alias("key"), *COLUMNS[1:])


def expected(table: str, key: str, cases: list, lang: str, noisy: bool = True) -> str:
    rows = [(i, *row) for i, (_, found) in enumerate(cases) for row in found]
    body = ", ".join(f"({i}, {_text(api)}, {_text(value)}, {line})" for i, api, value, line in rows)
    n, noise = f"'{{n}}', CAST({key} AS VARCHAR)", [x.count("\n") for x in (NOISE.get(lang, [""]) if noisy else [""])]
    lines = f"CASE WHEN line = 0 THEN 0 ELSE line + ({noise})[1 + CAST({key} // {len(cases)} AS BIGINT) % {len(noise)}] END"
    return f"SELECT {key} AS key, replace(api, {n}) AS api, replace(value, {n}) AS value, CAST({lines} AS INTEGER) AS line FROM {table} JOIN (VALUES {body}) AS v(i, api, value, line) ON {key} % {len(cases)} = i"


def over(table: str, key: str, lang: str, cases: list, name: str = "", noisy: bool = True):
    """Registers a query: ``f(files)`` gives path, api, value, line of the files that the cases' templates fill."""

    def add(f):
        def query(spark, sf_dir):
            return keyed(f(sources(spark, sf_dir, table, key, lang, [text for text, _ in cases], name, noisy)))

        query.__name__ = f.__name__
        return register(expected(table, key, cases, lang, noisy))(query)

    return add


def shown(args) -> F.Column:
    """Arguments as text: strings and integers by their values, others as they stand."""
    return F.array_join(F.transform(args, lambda a: F.concat(F.when(a["kw"].isNotNull(), F.concat(a["kw"], F.lit("="))).otherwise(""), F.coalesce(a["s"], a["i"].cast("string"), a["text"]))), ",")


def named_sites(files: DataFrame) -> DataFrame:
    sites = extract.with_api(extract.call_sites(files, imports=True))
    return sites.select("path", "api", shown(F.col("args")).alias("value"), "line")


GO = [
    ("package p\n// rsa.GenerateKey(rand.Reader, 1)\nfunc f() {\n\tk, _ := rsa.GenerateKey(rand.Reader, {n})\n}\n", [("crypto/rsa.GenerateKey", "rand.Reader,{n}|||", 4)]),
    ("func f() {\n\th := md5.New()\n\tc := ecdh.P256()\n\tecdh.Other()\n}\n", [("crypto/md5_sha1.New", "|md5||", 2), ("crypto/ecdh.Curve", "|||P256", 3)]),
    ("func f() {\n\tecdsa.SignASN1(rand.Reader, key{n}, digest)\n\tsha256.Sum256([]byte(\"rsa.GenerateKey(\"))\n}\n", [("crypto/ecdsa.Op", "rand.Reader,key{n},digest||SignASN1|", 2), ("crypto/sha256.Sum256", "[]byte(\"rsa.GenerateKey(\")|||", 3)]),
    ("x509.CreateCertificate(rand.Reader, t, p,\n  &k.Public{n}, k)\nmldsa.MLDSA65()", [("crypto/x509.CertOp", "rand.Reader,t,p,&k.Public{n},k||CreateCertificate|", 1), ("crypto/mldsa.ParamSet", "||MLDSA65|", 3)]),
]


@over("orders", "o_orderkey", "go", GO)
def extract_go(files):
    sites = extract.go_apis(extract.call_sites(files))
    said = F.concat_ws("|", shown(F.col("args")), *[F.coalesce(c, F.lit("")) for c in ("pkg", "fn", "curve_fn")])
    return sites.select("path", "api", said.alias("value"), "line")


PYTHON = [
    ("import hashlib\nhashlib.md5(b'{n}')  # hashlib.sha1(x)\n", [("hashlib.md5", "{n}", 2)]),
    ("from hashlib import sha256 as h, sha1\nh(data)\nsha1(\n  'a', usedforsecurity=False)\n", [("hashlib.sha256", "data", 2), ("hashlib.sha1", "a,usedforsecurity=False", 3)]),
    ("key = rsa.generate_private_key(public_exponent=65537, key_size={n})\n", [("cryptography.hazmat.rsa.generate_private_key", "public_exponent=65537,key_size={n}", 1)]),
    ('"""hashlib.md5(x)"""\nec.generate_private_key(ec.SECP256R1())\n', [("cryptography.hazmat.ec.generate_private_key", "ec.SECP256R1()", 2)]),
]


@over("orders", "o_orderkey", "python", PYTHON)
def extract_python(files):
    return named_sites(files)


JAVA = [
    ("class A { void f() {\n  Cipher c = Cipher.getInstance(\"AES/GCM/{n}\");\n} }", [("javax.crypto.Cipher.getInstance", "AES/GCM/{n}", 2)]),
    ("BlockCipher e = new AESEngine();\n// new AESEngine()\nnew GCMBlockCipher(new AESEngine(), {n});", [("org.bouncycastle.AESEngine", "", 1), ("org.bouncycastle.GCMBlockCipher", "new AESEngine(),{n}", 3), ("org.bouncycastle.AESEngine", "", 3)]),
    ("MessageDigest.getInstance(\"SHA-1\").update(x{n});", [("java.security.MessageDigest.getInstance", "SHA-1", 1)]),
]


@over("orders", "o_orderkey", "java", JAVA)
def extract_java(files):
    return named_sites(files)


JAVASCRIPT = [
    ("const { createHash: h } = require('crypto');\nh('md5');\ncrypto.createHash(`sha{n}`);", [("node:crypto.createHash", "md5", 2), ("node:crypto.createHash", "sha{n}", 3)]),
    ("import { createHash } from 'node:crypto';\ncreateHash('sha1').update('crypto.createHash(')", [("node:crypto.createHash", "sha1", 2)]),
    ("await window.crypto.subtle.encapsulateKey({name: 'ML-KEM-{n}'}, k);\nother.sign(x);\nsubtle.sign(a, b)", [("webcrypto.subtle.kemOperation", "{name: 'ML-KEM-{n}'},k", 1), ("webcrypto.subtle.sign", "a,b", 3)]),
]


@over("orders", "o_orderkey", "javascript", JAVASCRIPT)
def extract_javascript(files):
    return named_sites(files)


C = [
    ("#include <openssl/rsa.h>\nint f() { RSA_generate_key_ex(r, {n}, e, NULL); }\n", [("openssl.RSA_generate_key_ex", "r,{n},e,NULL", 2), ("include", "openssl/rsa.h", 0)]),
    ("/* MD5_Init(&c); */\n#if X\n  #include \"md5.h\"\n#endif\nMD5_Init(&c{n});", [("openssl.MD5_Init", "&c{n}", 5), ("include", "md5.h", 0)]),
]


@over("orders", "o_orderkey", "c", C)
def extract_c(files):
    included = files.select("path", F.lit("include").alias("api"), F.explode(extract.includes(F.col("content"))).alias("value"), F.lit(0).alias("line"))
    return named_sites(files).unionByName(included)


RUST = [
    ("let h = sha2::Sha256::digest(b\"{n}\");\nlet k = Rsa::generate({n})?;", [("rustcrypto.Sha256.digest", "{n}", 1), ("openssl.Rsa.generate", "{n}", 2)]),
    ("ring::signature::EcdsaKeyPair::generate_pkcs8(&ALG{n}, &rng);\nVec::<Sha256::new>::push(x)", [("ring.EcdsaKeyPair.generate_pkcs8", "&ALG{n},&rng", 1)]),
]


@over("orders", "o_orderkey", "rust", RUST)
def extract_rust(files):
    return named_sites(files)


@over("orders", "o_orderkey", "rust", [("pbkdf2::<Hmac<Sha256>>(p, s, {n}, &mut k);", [("pbkdf2", "Hmac<Sha256>", 1)]), ("pbkdf2(p, s, {n});", [("pbkdf2", "", 1)])])
def rust_type_arguments(files):
    return extract.call_sites(files).select("path", F.col("callee").alias("api"), F.coalesce("generic", F.lit("")).alias("value"), "line")


CSHARP = [
    ("var r = RSA.Create({n});\n// RijndaelManaged(k)\nvar a = new RijndaelManaged(key);", [("System.Security.Cryptography.RSA.Create", "{n}", 1), ("System.Security.Cryptography.RijndaelManaged.new", "key", 3)]),
    ("using (var m = MD5.Create()) { m.ComputeHash(b{n}); }", [("System.Security.Cryptography.MD5.Create", "", 1)]),
]


@over("orders", "o_orderkey", "csharp", CSHARP)
def extract_csharp(files):
    return named_sites(files)


JOSE = [
    ("package j\nfunc f(a string) {\n\tswitch a {\n\tcase \"RS256\", \"RS384\":\n\t\tuse(\"ES256\")\n\tcase \"none\":\n\tcase \"x{n}\":\n\t}\n}\n", [("go.alg-switch.RS256", "RS256", 4), ("go.alg-switch.none", "none", 6)]),
    ("package j\nconst (\n\tA = \"HS512\"\n\tB = \"none\"\n)\nconst C = \"none\"\nvar m = map[string]int{\"PS256\": {n}}\n", [("go.alg-register.HS512", "HS512", 3), ("go.alg-register.none", "none", 4), ("go.alg-register.PS256", "PS256", 7)]),
    ("package j\nfunc f() {\n\tif a == \"ES384\" { g(\"none\") }\n\tx := NewSignatureAlgorithm(\"EdDSA\")\n\tprint(\"log ES512 {n}\")\n}\nfunc g() { h(\"none\") }\n", [("go.alg-register.EdDSA", "EdDSA", 4)]),
    ("var s = &SigningMethodRSA{\"RS512\", crypto.SHA512}\nvar t = T{Name: \"A256GCM\", n: {n}}\n", [("go.alg-register.RS512", "RS512", 1), ("go.alg-register.A256GCM", "A256GCM", 2)]),
]


@over("orders", "o_orderkey", "go", JOSE)
def jose_names(files):
    return shapes.jose_names(files).select("path", "api", "value", "line")


PQ = [
    (
        "package h\nimport (\n\t\"crypto/ed25519\"\n\td \"github.com/cloudflare/circl/sign/dilithium/mode{n}\"\n)\nfunc sign() {\n\ted25519.Sign(k, m)\n\td.SignTo(k2, m, s)\n}\nfunc other() {\n\ted25519.Verify(k, m, s)\n}\n",
        [("crypto/ed25519.Op", " This function also calls ML-DSA (circl dilithium) at line 8 — the classical component alone is insufficient to forge a signature accepted by this code.", 7), ("crypto/ed25519.Op", "", 11)],
    ),
    ("package h\nfunc sign() {\n\tecdsa.Sign(rand.Reader, k, m{n})\n\tmldsa65.Sign(k2, m)\n}\n", [("crypto/ecdsa.Op", "", 3)]),
]


@over("orders", "o_orderkey", "go", PQ, noisy=False)
def signature_notes(files):
    found = extract.pq_notes(extract.call_sites(files), files)
    return found.select("path", "api", F.col("pq_note").alias("value"), "line")


KEMS = [
    ("from hpke import KEM as K{n}, KDF\nSuite(K{n}.DHKEM_P256, 1)\n", [("Suite", "DHKEM_P256", 2)]),
    ("import hpke\nSuite(hpke.KEM.MLKEM768)\nSuite(KEM.X25519)\nSuite(Other.KEM{n})\n", [("Suite", "MLKEM768", 2), ("Suite", "X25519", 3)]),
]


@over("orders", "o_orderkey", "python", KEMS)
def kem_members(files):
    aliases = files.select("path", extract.kem_aliases(F.col("content")).alias("aliases"))
    sites = extract.call_sites(files).join(aliases, "path")
    found = sites.select("path", F.col("callee").alias("api"), extract.nth_attribute(F.col("args"), 0, F.col("aliases"), "KEM").alias("value"), "line")
    return found.where("value IS NOT NULL")


JARS = [
    ("new JarSigner.Builder(entry)\n  .digestAlgorithm(\"SHA-256\")\n  .signatureAlgorithm(\"ML-DSA-{n}\").build();", [("JarSigner", "ML-DSA-{n}", 3)]),
    ("void f() {\n  JarSigner.Builder b = new JarSigner.Builder(e);\n  b.signatureAlgorithm(\"RSA{n}\");\n  decoder.signatureAlgorithm(\"ES256\");\n}", [("JarSigner", "RSA{n}", 3)]),
    ("NimbusJwtDecoder.withPublicKey(k).signatureAlgorithm(\"RS256\").build({n});", []),
]


@over("orders", "o_orderkey", "java", JARS)
def jar_signatures(files):
    return extract.jar_signer_algorithms(files).select("path", F.lit("JarSigner").alias("api"), "value", "line")


FAILING = [
    ("def test_x():\n    with pytest.raises(ValueError):\n        hashlib.new('x{n}')\n    hashlib.new('y')\n", [("hashlib.new", "TestAssertion", 3), ("hashlib.new", "Default", 4)]),
    ("with self.assertRaises(E):\n    k = hashlib.md5()\n    hashlib.sha1(k{n})\n", [("hashlib.md5", "Default", 2), ("hashlib.sha1", "Default", 3)]),
]


@over("orders", "o_orderkey", "python", FAILING)
def failing_calls(files):
    sites = extract.with_context(extract.call_sites(files), files)
    return sites.where(F.col("callee").startswith("hashlib.")).select("path", F.col("callee").alias("api"), F.col("context").alias("value"), "line")


FAILING_JS = [
    ("expect(() => crypto.createHash('x{n}')).to.throw(E);\nexpect(crypto.createHash('y')).toBe(1);", [("crypto.createHash", "TestAssertion", 1), ("crypto.createHash", "TestAssertion", 2)]),
    ("it('a', () => {\n  expect(() => { const k = crypto.createSign('a'); crypto.createHash(k); }).toThrow();\n  run(crypto.createHash({n}));\n});", [("crypto.createSign", "TestAssertion", 2), ("crypto.createHash", "TestAssertion", 2), ("crypto.createHash", "Call", 3)]),
]


@over("orders", "o_orderkey", "javascript", FAILING_JS)
def asserted_calls(files):
    sites = extract.with_context(extract.call_sites(files), files)
    return sites.where(F.col("callee").startswith("crypto.")).select("path", F.col("callee").alias("api"), F.col("context").alias("value"), "line")


CONTEXTS = [
    ("var m = map[string]hash.Hash{\"a\": md5.New()}", [("md5.New", "MapEntry", 1)]),
    ("require.Equal(t, want{n}, md5.New())", [("md5.New", "TestAssertion", 1)]),
    ("x = registry.LookupHash(md5.New())\ny = f(registry.Lookup(md5.New()))", [("md5.New", "RegistryLookup", 1), ("md5.New", "Call", 2)]),
    ("if h{n} == md5.New() { }\n", [("md5.New", "Comparison", 1)]),
    ("v := T{{n}, md5.New()}", [("md5.New", "StructLiteral", 1)]),
    ("use(md5.New())\nvar d = md5.New()\nmd5.New()\nlist.add(md5.New())", [("md5.New", "Call", 1), ("md5.New", "StringConstant", 2), ("md5.New", "Default", 3), ("md5.New", "CollectionElement", 4)]),
]


@over("orders", "o_orderkey", "go", CONTEXTS)
def site_contexts(files):
    sites = extract.call_sites(files).where("callee = 'md5.New'")
    return sites.select("path", F.col("callee").alias("api"), extract.site_context(F.col("frames"), F.col("lang")).alias("value"), "line")


def settings(files: DataFrame) -> DataFrame:
    return shapes.listed_settings(files).select("path", "api", "value", F.lit(0).alias("line"))


@over("supplier", "s_suppkey", "go", [
    ("c.KeyExchanges = x\ncfg := ssh.Config{KeyExchanges: []string{ssh.KeyExchangeMLKEM768X25519, \"kex-{n}\", ssh.KeyExchangeUnknown, ssh.KeyExchangeECDHP256}}", [("golang.org/x/crypto/ssh.Config.KeyExchanges", "mlkem768x25519-sha256", 0), ("golang.org/x/crypto/ssh.Config.KeyExchanges", "kex-{n}", 0), ("golang.org/x/crypto/ssh.Config.KeyExchanges", "ecdh-sha2-nistp256", 0)]),
    ("tls.Certificate{SupportedSignatureAlgorithms: []tls.SignatureScheme{tls.Ed25519,\n tls.PSSWithSHA{n}}}", [("crypto/tls.Certificate.SupportedSignatureAlgorithms", "Ed25519", 0), ("crypto/tls.Certificate.SupportedSignatureAlgorithms", "PSSWithSHA{n}", 0)]),
])
def settings_go(files):
    return settings(files)


@over("supplier", "s_suppkey", "java", [
    ("p.setNamedGroups(new String[] {\"X25519\", \"secp{n}r1\"});", [("javax.net.ssl.SSLParameters.setNamedGroups", "X25519", 0), ("javax.net.ssl.SSLParameters.setNamedGroups", "secp{n}r1", 0)]),
    ("System.setProperty(\"jdk.tls.namedGroups\", \"x25519, ,g{n}\");\nSystem.setProperty(\"other\", \"a\");", [("javax.net.ssl.SSLParameters.setNamedGroups", "x25519", 0), ("javax.net.ssl.SSLParameters.setNamedGroups", "g{n}", 0)]),
    ("TlsUtils.addIfSupported(v, crypto, new int[]{ NamedGroup.x25519, NamedGroup.g{n} });", [("org.bouncycastle.tls.NamedGroup", "x25519", 0), ("org.bouncycastle.tls.NamedGroup", "g{n}", 0)]),
])
def settings_java(files):
    return settings(files)


@over("supplier", "s_suppkey", "cpp", [
    ("SSL_CTX_set1_groups_list(ctx, \"*P-521:?X{n}/DEFAULT\");", [("openssl.SSL_CTX_set1_groups_list", "P-521", 0), ("openssl.SSL_CTX_set1_groups_list", "X{n}", 0)]),
    ("SSL_CONF_cmd(c, \"Curves\", \"-A{n}:B\"); SSL_CONF_cmd(c, \"Other\", \"C\");", [("openssl.SSL_CTX_set1_groups_list", "A{n}", 0), ("openssl.SSL_CTX_set1_groups_list", "B", 0)]),
])
def settings_c(files):
    return settings(files)


@over("supplier", "s_suppkey", "rust", [
    ("CryptoProvider { kx_groups: vec![X25519, kx_group::G{n}], ..d }", [("rustls.CryptoProvider.kx_groups", "X25519", 0), ("rustls.CryptoProvider.kx_groups", "G{n}", 0)]),
    ("pub static ALL_KX_GROUPS: &[&dyn SupportedKxGroup] = &[A{n}, x::B];\nuse(rustls_post_quantum::DEFAULT_PROVIDER)", [("rustls.CryptoProvider.kx_groups", "A{n}", 0), ("rustls.CryptoProvider.kx_groups", "B", 0), ("rustls.CryptoProvider.kx_groups", "X25519MLKEM768", 0)]),
    ("let s = SignatureScheme::ML_DSA_65; let o = SignatureScheme::RSA_{n};\nCiphersuite::MLS_128_XWING_{n}", [("rustls.SignatureScheme", "ML_DSA_65", 0), ("openmls.Ciphersuite", "MLS_128_XWING_{n}", 0)]),
])
def settings_rust(files):
    return settings(files)


@over("supplier", "s_suppkey", "java", [
    ("Jwts.builder().signWith(k, SignatureAlgorithm.HS{n});\ncom.x.SignatureAlgorithm.NO", [("SignatureAlgorithm", "HS{n}", 0)]),
    ("JWEAlgorithm.RSA_OAEP_{n}; Other.HS256; xJWEAlgorithm.A", [("JWEAlgorithm", "RSA_OAEP_{n}", 0)]),
])
def enum_members(files):
    return shapes.constants(files, ["SignatureAlgorithm", "JWEAlgorithm"]).select("path", F.col("owner").alias("api"), F.col("member").alias("value"), F.lit(0).alias("line"))


@over("supplier", "s_suppkey", "go", [
    ("kem := oqs.KeyEncapsulation{}\nsig := oqs.Signature{}\n// {n}\nxoqs.Signature{}", [("composite", "oqs.KeyEncapsulation", 0), ("composite", "oqs.Signature", 0)]),
    ("import (\n\t\"crypto/mldsa\"\n)\nfunc f() { verify(k{n}, crypto.MLDSAMu) }", [("foreign key", "crypto/mldsa", 0), ("mu", "verify", 4)]),
    ("import \"crypto/mldsa\"\nvar k{n} = mldsa.GenerateKey(p)", []),
])
def go_shapes(files):
    made = shapes.composites(files, ["oqs.KeyEncapsulation", "oqs.Signature"]).select("path", F.lit("composite").alias("api"), F.col("type").alias("value"), F.lit(0).alias("line"))
    foreign = shapes.foreign_keys(files, "crypto/mldsa", ["mldsa.GenerateKey"]).where("foreign").select("path", F.lit("foreign key").alias("api"), F.lit("crypto/mldsa").alias("value"), F.lit(0).alias("line"))
    mu = extract.call_sites(files).where(extract.passes(F.col("args"), "crypto.MLDSAMu")).select("path", F.lit("mu").alias("api"), F.col("callee").alias("value"), "line")
    return made.unionByName(foreign).unionByName(mu)


ARGUMENTS = [
    ("f('s{n}', 2_048, -1{n}, a.b.C, g(1).h(2), key={n})", [("string", "s{n}", 1), ("integer 1", "", 1), ("integer 2", "-1{n}", 1), ("member", "C", 1), ("keyword", "{n}", 1), ("symbol", "", 1)]),
    ("f(NAME_{n}, 7, 0x800, x, m.D())", [("string", "", 1), ("integer 1", "7", 1), ("integer 2", "", 1), ("member", "x", 1), ("keyword", "", 1), ("symbol", "NAME_{n}", 1)]),
]


@over("orders", "o_orderkey", "python", ARGUMENTS)
def call_arguments(files):
    args = F.col("args")
    values = {
        "string": extract.nth_string(args, 0), "integer 1": extract.nth_integer(args, 1), "integer 2": extract.nth_integer(args, 2), "member": extract.nth_member(args, 3),
        "keyword": extract.keyword(args, "key")["i"], "symbol": extract.literal_or_symbol(args, 0)["symbol"],
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("api"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for k, v in values.items()])).alias("v")
    return extract.call_sites(files).where("callee = 'f'").select("path", "line", each).select("path", "v.api", "v.value", "line")


@over("orders", "o_orderkey", "javascript", [
    ("subtle.sign({name: 'ECDSA', hash: {name: 'SHA-{n}'}}, k)", [("name", "ECDSA", 1), ("hash", "SHA-{n}", 1)]),
    ("subtle.sign({ hash: \"SHA-1\", 'name': 'X{n}' })", [("name", "X{n}", 1), ("hash", "SHA-1", 1)]),
])
def object_properties(files):
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("api"), extract.property_of(F.col("args"), 0, k).alias("value")) for k in ("name", "hash")])).alias("v")
    return extract.call_sites(files).where("callee = 'subtle.sign'").select("path", "line", each).select("path", "v.api", "v.value", "line")


def dependencies(files: DataFrame) -> DataFrame:
    return manifests.dependencies(files).select("path", F.col("name").alias("api"), F.col("version").alias("value"), "line")


@over("part", "p_partkey", "", [
    ("module m\n\ngo 1.24\nrequire example.com/a v1.{n}.0\nrequire (\n\texample.com/b v2.0.0 // indirect\n\t// c v1\n)\n", [("example.com/a", "v1.{n}.0", 4), ("example.com/b", "v2.0.0", 6)]),
    ("require (\n)\nreplace x => y v{n}\n", []),
], "/go.mod")
def manifest_go(files):
    return dependencies(files)


@over("part", "p_partkey", "", [
    ("[package]\nname = \"x\"\n[dependencies]\nring = \"0.{n}\"\nrsa = { version = \"0.9\", features = [] }\nlocal = { path = \"../l\" }\n[features]\nz = \"1\"\n", [("ring", "0.{n}", 4), ("rsa", "0.9", 5), ("local", "", 6)]),
    ("[dev-dependencies]\n# c = \"1\"\nsha2 = \"{n}\"\n[build-dependencies]\ncc = \"1\"", [("sha2", "{n}", 3), ("cc", "1", 5)]),
], "/Cargo.toml")
def manifest_cargo(files):
    return dependencies(files)


@over("part", "p_partkey", "", [
    ("{\n \"dependencies\": {\n  \"jose\": \"^{n}.0\"\n },\n \"devDependencies\": {\"tap\": \"1\"}\n}", [("jose", "^{n}.0", 3), ("tap", "1", 5)]),
    ("{ not json {n}", []),
], "/package.json")
def manifest_npm(files):
    return dependencies(files)


@over("part", "p_partkey", "", [
    ("<project>\n<dependencies>\n<dependency>\n<groupId>g</groupId><artifactId>a</artifactId><version>{n}</version>\n</dependency></dependencies>\n</project>", [("g:a", "{n}", 3)]),
    ("<project><dependency><groupId>g</groupId><artifactId>a</artifactId><version>{n}</version>\n<exclusions><exclusion><groupId>x</groupId><artifactId>y</artifactId></exclusion></exclusions></dependency></project>", [("x:y", "{n}", 1)]),
], "/pom.xml")
def manifest_maven(files):
    return dependencies(files)


def _der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")) + body


def _oid(text: str) -> bytes:
    first, second, *rest = map(int, text.split("."))
    out = bytes([40 * first + second])
    for n in rest:
        digits = [n & 127]
        while n := n >> 7:
            digits.insert(0, n & 127 | 128)
        out += bytes(digits)
    return _der(6, out)


def _pem(signature: str, key: str, bits: int = 0, curve: str = "") -> str:
    """A certificate of the subject ``s``, its key an RSA modulus of so many bits or a point of the curve."""
    name = _der(0x30, _der(0x31, _der(0x30, _oid("2.5.4.3"), _der(12, b"s"))))
    modulus = _der(0x30, _der(2, b"\0" + (1 << bits - 1 | 1).to_bytes(bits // 8, "big")), _der(2, b"\1\0\1")) if bits else b"\4" + b"p" * 64
    spki = _der(0x30, _der(0x30, _oid(key), _oid(curve) if curve else _der(5)), _der(3, b"\0", modulus))
    dates = _der(0x30, _der(23, b"240101000000Z"), _der(23, b"340101000000Z"))
    algorithm = _der(0x30, _oid(signature), _der(5))
    body = _der(0x30, _der(0xA0, _der(2, b"\2")), _der(2, b"\1"), algorithm, name, dates, name, spki)
    text = base64.encodebytes(_der(0x30, body, algorithm, _der(3, b"\0sig"))).decode()
    return f"-----BEGIN CERTIFICATE-----\n{text}-----END CERTIFICATE-----\n"


RSA, EC, LONG = "1.2.840.113549.1.1.1", "1.2.840.10045.2.1", "signature_long_lived"
CERTIFICATES = [
    (_pem("1.2.840.113549.1.1.5", RSA, 2048), [("CERT-001", f"rsa-2048|{LONG}|s", 0), ("CERT-002", f"rsa-pkcs1-sha1|{LONG}|s", 0), ("CERT-100", f"rsa-pkcs1-sha1|{LONG}|s", 0)]),
    (_pem("1.2.840.113549.1.1.11", RSA, 1536), [("CERT-001", f"rsa-undersized|{LONG}|s", 0), ("CERT-002", f"rsa-pkcs1-sha256|{LONG}|s", 0)]),
    (_pem("1.2.840.10045.4.3.2", RSA, 5120), [("CERT-001", f"rsa-unattributed|{LONG}|s", 0), ("CERT-002", f"ecdsa-unattributed|{LONG}|s", 0)]),
    ("-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----\n" + _pem("1.2.840.113549.1.1.11", EC, 0, "1.2.840.10045.3.1.7") + _pem("1.2.3.4", "2.16.840.1.101.3.4.4.2"), [
        ("CERT-001", f"ecdsa-p256|{LONG}|s", 0), ("CERT-002", f"rsa-pkcs1-sha256|{LONG}|s", 0), ("CERT-001", "ml-kem-768|key_establishment_long_lived|s", 1), ("CERT-002", f"unknown|{LONG}|s", 1),
    ]),
    ("no certificate {n}", []),
]


@over("supplier", "s_suppkey", "", CERTIFICATES)
def certificate_findings(files):
    found = certs.findings(certs.fields(files.select("path", F.encode("content", "UTF-8").alias("content"))))
    return found.select(F.col("location").alias("path"), F.col("rule_id").alias("api"), F.concat_ws("|", "algorithm_id", "usage_context", "subject_cn").alias("value"), F.col("block").alias("line"))


@over("supplier", "s_suppkey", "", [(text, [] if found else [("CertDecodeError", "", 0)]) for text, found in CERTIFICATES])
def certificate_warnings(files):
    found = certs.warnings(certs.fields(files.select("path", F.encode("content", "UTF-8").alias("content"))))
    return found.select("path", F.col("kind").alias("api"), F.lit("").alias("value"), F.lit(0).alias("line"))


CAPTURED = [
    ('rsa.GenerateKey(rand.Reader, {n})\nsha1.New()\nfoo("x", 2)', [("bits", "{n}", 1)]),
    ('jwt.NewWithClaims(jwt.SigningMethodHS{n}, claims)', [("method", "SigningMethodHS{n}", 1)]),
    ('rsa.GenerateKey(rand.Reader, keySize{n})', []),
]


@over("orders", "o_orderkey", "go", CAPTURED)
def captured_arguments(files):
    table = [("go", "crypto/rsa.GenerateKey", 1, "integer", "bits"), ("go", "jwt.NewWithClaims", 0, "member", "method")]
    slots = dims.local(files.sparkSession, table, "lang string, api string, slot int, extractor string, name string")
    found = extract.captures(extract.with_api(extract.call_sites(files)), slots)
    return found.select("path", "line", F.explode(F.map_entries("captured")).alias("e")).select("path", F.col("e.key").alias("api"), F.coalesce("e.value.s", F.col("e.value.i").cast("string")).alias("value"), "line")
