"""Each operator against a plain version, with nulls, empties, long texts, ties, repeats, empty tables, odd columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import reference as ref

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
P = pytest.importorskip("public_tokenizers")
WORD, BYTE, PIECE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def prose(rng, n, size=400):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6))) + rng.choice(["", "", ",", "."]) for _ in range(n)) if size else ""


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [None, "", "  \n\t ", "One two", "one  TWO", "123 !! 👍", "x" * 5000, prose(rng, 9000)]
    passage = prose(rng, 60)
    base = prose(rng, 200)
    words = base.split()
    for _ in range(12):  # near copies: a few words changed
        w = list(words)
        for _ in range(3):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base] * 4 + [base.upper(), base + " tail of some more words here"]
    texts += [prose(rng, rng.randint(3, 40)) + " " + passage + " " + prose(rng, rng.randint(3, 40)) for _ in range(6)]
    texts += [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += ["tie tie tie tie tie tie tie", "a b c d e f g", "a b c d e f g h", "<|endoftext|> in <|startoftext|> text", "a\x01b c"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame([(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], len(t or "")) for i, t in rows], DOCS)
    # Names that the operators use inside must not matter.
    extra = {n: F.lit("clash") for n in ("doc", "ids", "class", "component", "spans", "place", "queue", "bucket", "score", "held_out", "kept", "rest", "key")}
    return frame.withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_jaccard(spark, docs, rows, nothing):
    from cipherscope.llm.jaccard import jaccard_join

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(docs).collect()}
    assert got == ref.jaccard(rows)
    assert jaccard_join(nothing).count() == 0


def test_jaccard_with_salted_buckets(spark, docs, rows, monkeypatch):
    from cipherscope.llm import jaccard

    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect()}
    assert got == ref.jaccard(rows)


def shuffled(spark, run):
    """What run() returns, and the bytes that its stages wrote to the shuffle."""
    sc = spark.sparkContext._jsc.sc()
    first = sc.dagScheduler().nextStageId()
    out = run()
    last = sc.dagScheduler().nextStageId()
    sc.listenerBus().waitUntilEmpty(30_000)
    return out, sum(sc.statusStore().lastStageAttempt(i).shuffleWriteBytes() for i in range(first, last))


def test_jaccard_shuffles_no_text_that_links_with_none(spark, monkeypatch):
    from cipherscope.llm import jaccard

    # Long texts of four of twelve passages each share many shingles, but none links: up to three of five passages are common.
    rng = random.Random(5)
    passages = [" ".join(str(rng.randrange(10**9)) for _ in range(500)) for _ in range(12)]
    rows = [(i, " ".join(passages[j] for j in sorted(rng.sample(range(12), 4)))) for i in range(60)]
    rows = list({t: (i, t) for i, t in rows}.values()) + [(100, "only " + rows[7][1]), (101, rows[9][1])]
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got, size = shuffled(spark, lambda: jaccard.jaccard_join(docs).collect())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == ref.jaccard(rows)
    assert size < 6e6


def test_jaccard_parities_drop_no_link():
    from cipherscope.llm.jaccard import PARTS, folded, may_link, parity, signs, similar

    rng = np.random.default_rng(3)
    kept = 0
    for n in (1, 2, 5, 40, 511, 513, 3000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for share in (0, 0.1, 0.25, 0.3, 0.6, 1):
            for more in (0, n // 10, n // 4):
                y = np.unique(np.concatenate([x[int(share * n) :], rng.integers(0, 2**64, more, dtype=np.uint64)]))
                linked = min(len(x), len(y)) > 0 and similar(x, y, 75)
                found = may_link(parity(x), len(x), parity(y), len(y), 75)
                assert found or not linked
                kept += found and not linked
    assert kept < 20
    assert len(parity(x)) == 512 and (folded(parity(x), PARTS // 8).view(np.int64) == signs(parity(x))).all()


def test_jaccard_at_the_threshold(spark):
    from cipherscope.llm.jaccard import jaccard_join

    # 3 of 4 shingles shared links; 5 of 7 does not.
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, "p q r s t u v w x y"), (4, "p q r s t u v w x z"), (5, None), (None, "a b c d e f g")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 4, None), (2, 3, None), (None, 3, None), (3, 6, 3), (4, 6, 3) if 5 * 100 >= 75 * 7 else (4, 6, 4), (5, 0, 5)}


def test_repeats(spark, docs, rows, nothing):
    from cipherscope.llm.repeats import remove_spans, repeated_spans

    out = remove_spans(docs, repeated_spans(docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == ref.removed(rows)
    assert remove_spans(nothing, repeated_spans(nothing)).count() == 0


@pytest.mark.parametrize("length", [33, 64])
def test_repeats_of_other_lengths(spark, length):
    from cipherscope.llm.repeats import remove_spans, repeated_spans

    rng = random.Random(length)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(10, 90))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = remove_spans(frame, repeated_spans(frame, length)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == ref.removed(rows, length)


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_token_files(spark, docs, rows, nothing):
    from cipherscope.llm.token_files import read_token_files, write_token_files

    files = write_token_files(docs, WORD, end_id=1)
    lib, at, want = library(WORD), 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), ids))
        at += len(ids)
    assert [tuple(r) for r in read_token_files(files).orderBy("doc_id").collect()] == want
    digests = {r.doc_id: r.ids_crc32 for r in read_token_files(files, digest=True).collect()}
    assert digests == {i: zlib.crc32(np.array(ids, "<u4").tobytes()) for i, _, _, ids in want}
    assert read_token_files(write_token_files(nothing, WORD)).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bit_packing(bits):
    from cipherscope.llm.token_files import bits_for, pack, unpack

    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001)
    assert bits_for(2**bits) == bits
    data = pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (unpack(data, 1001, bits) == ids).all()


def test_random_access(tmp_path, monkeypatch):
    from cipherscope.llm import token_files as tf

    monkeypatch.setattr(tf, "BLOCK", 64)
    path = f"file://{tmp_path}/x.tokbits"
    ids = np.random.default_rng(0).integers(0, 2**11, 1000)
    w = tf.Writer(path, 11)
    for a, b in ((0, 10), (10, 10), (10, 700), (700, 1000)):
        w.add(np.array([a]), 0, ids[a:b], np.array([b - a]))
    w.close()
    r = tf.Reader(path)
    for a, b in ((0, 1000), (63, 65), (64, 128), (5, 5), (999, 1000)):
        assert (r.read(a, b) == ids[a:b]).all()
    assert [len(x) for _, x in r.documents()] == [10, 0, 690, 300]


def check_pieces(pieces, rows, end, window=4096):
    lib, by, seqs = library(WORD), {}, {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [end]
        got = sorted(by[i], key=lambda p: p.start)
        assert [p.start for p in got] == list(np.cumsum([0] + [p.length for p in got])[:-1])
        assert b"".join(bytes(p.ids) for p in got) == np.array(ids, "<u4").tobytes()
        assert all(p.doc_tokens == len(ids) for p in got)
    short = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
        short += at < window
    assert short <= 1


@pytest.mark.parametrize("targets", [None, {"a": 0.7, "b": 0.3}])
def test_packing(spark, docs, rows, nothing, targets):
    from cipherscope.llm.packing import pack

    check_pieces(pack(docs, WORD, 2, targets=targets, group_tokens=3000).collect(), rows, 2)
    check_pieces(pack(docs, WORD, 2, window=64, targets=targets, group_tokens=500).collect(), rows, 2, 64)
    assert pack(nothing, WORD, 2).count() == 0


def test_packing_keeps_proportions(spark):
    from cipherscope.llm.packing import pack

    rng = random.Random(1)
    rows = [(i, prose(rng, 50), None, "a" if i % 3 else "b", 0) for i in range(300)]
    pieces = pack(spark.createDataFrame(rows, DOCS), WORD, 2, window=512, group_tokens=5000).collect()
    total = sum(p.length for p in pieces)
    share = sum(p.length for p in pieces if p.source == "a") / total
    last = max(p.sequence_id for p in pieces)
    for s in range(last):
        own = sum(p.length for p in pieces if p.sequence_id == s and p.source == "a")
        assert abs(own - share * 512) <= 3


def test_packing_keeps_a_mixture_across_groups(spark):
    from cipherscope.llm.packing import pack

    rng = random.Random(2)
    rows = [(i, prose(rng, 50), None, ["a", "b", "b", None, "c"][i % 5], 0) for i in range(400)]
    targets = {"a": 0.5, "b": 0.3, "c": 0.2, "absent": 3.0}
    pieces = pack(spark.createDataFrame(rows, DOCS), WORD, 2, window=256, group_tokens=3000, targets=targets).collect()
    check_pieces(pieces, [(r[0], r[1]) for r in rows], 2, 256)
    totals, at = {}, {}
    for p in pieces:
        totals[p.source] = totals.get(p.source, 0) + p.length
    whole = int(totals["a"] / 0.5 // 256)  # "a" is used up first
    assert whole > 30
    for s in range(whole):
        own = {q: sum(p.length for p in pieces if p.sequence_id == s and p.source == q) for q in targets}
        for q in "abc":  # in each window, and in all windows up to it: nothing is lost at the groups' edges
            at[q] = at.get(q, 0) + own[q]
            assert abs(own[q] - targets[q] * 256) <= 4 and abs(at[q] - targets[q] * 256 * (s + 1)) <= 4
    assert not any(p.source is None and p.sequence_id < whole for p in pieces)


def test_bpe(spark, docs, rows, nothing):
    from cipherscope.llm.bpe import decode, encode, round_trip

    lib = library(BYTE)
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    ids = encode(docs, BYTE)
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    assert {r.doc_id: r.text for r in decode(ids, BYTE).collect()} == {i: lib.decode(x, skip_special_tokens=False) for i, x in want.items()}
    assert {r.doc_id: (r.ids, r.text) for r in round_trip(docs, BYTE).collect()} == {i: (x, lib.decode(x, skip_special_tokens=False)) for i, x in want.items()}
    broken = spark.createDataFrame([(1, [200, 201, 50256]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode(broken, BYTE).collect()} == {1: lib.decode([200, 201, 50256], skip_special_tokens=False), 2: "", 3: ""}
    assert encode(nothing, BYTE).count() == 0


def test_trie_counts(spark, docs, rows, nothing):
    import re

    from cipherscope.llm.trie_counts import MARK, UNKNOWN, piece_scores, token_counts

    scores = piece_scores(PIECE)
    short = [(i, t) for i, t in rows if len(t or "") < 3000]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in short}
    memo = {w: ref.viterbi_tokens(MARK + w, scores, UNKNOWN) for ws in words.values() for w in ws}
    got = {r.doc_id: (r.n_tokens, r.n_pretokens) for r in token_counts(docs, PIECE).collect()}
    assert len(got) == len(rows)
    for i, ws in words.items():
        assert got[i] == (sum(memo[w] for w in ws), len(ws))
    assert token_counts(nothing, PIECE).count() == 0


def test_language(spark, data):
    from cipherscope.llm.common import table
    from cipherscope.llm.langid import identify
    from cipherscope.llm.registry import held_out

    docs = table(spark, data, "documents")
    extra = spark.createDataFrame([(10**9, None, "en", "s", 0), (10**9 + 1, "12 !?", "fr", "s", 5), (10**9 + 2, "", None, None, 0)], DOCS)
    got = {r.doc_id: r for r in identify(docs.unionByName(extra), held_out()).collect()}
    for i in range(3):
        assert got[10**9 + i].lang_pred == "und" and got[10**9 + i].score == 0
    rows = docs.select("doc_id", "lang").collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in unseen) >= 0.9 * len(unseen)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_labels(spark, nothing):
    from cipherscope.llm.langid import identify

    held = F.lit(False)
    assert identify(nothing, held).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None, None, 0)], DOCS)
    assert [r.lang_pred for r in identify(unlabelled, held).collect()] == ["und"]


def test_forward_backward():
    import itertools

    from cipherscope.llm.langid import forward_backward

    rng = np.random.default_rng(0)
    emit, start, move = rng.normal(size=(2, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    marginals, pairs, z = forward_backward(emit, mask, start, move)
    all_pairs = np.zeros((3, 3))
    for n in range(2):
        t, total, want = int(mask[n].sum()), 0.0, np.zeros((4, 3))
        own = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=t):
            p = np.exp(start[path[0]] + sum(emit[n, i, path[i]] for i in range(t)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, k in enumerate(path):
                want[i, k] += p
            for a, b in zip(path, path[1:]):
                own[a, b] += p
        assert np.allclose(marginals[n], want / total) and np.isclose(z[n], np.log(total))
        all_pairs += own / total
    assert np.allclose(pairs, all_pairs)


def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    v = [rng.normal(size=16) for _ in range(300)] + [centres[i % 12] + 0.1 * rng.normal(size=16) for i in range(200)] + [centres[0]] * 20
    rows = [(i, [float(np.float32(x)) for x in y]) for i, y in enumerate(v)]
    odd = [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0, None] * 8), (604, [1.0] * 3), (605, [float(np.float32(7 * x)) for x in v[5]])]
    return rows, odd, spark.createDataFrame([(i, x, "clash") for i, x in rows + odd], "vec_id long, embedding array<float>, vector string").repartition(3)


def test_vector_dedup(spark):
    from cipherscope.llm.vector_dedup import near_duplicates

    rows, odd, frame = vectors(spark)
    good = rows + [odd[5]]
    x = np.array([v for _, v in good], float)
    cos = np.einsum("ik,jk->ij", x, x) / np.outer(*[np.linalg.norm(x, axis=1)] * 2)
    near = (cos >= 0.9) & ~np.eye(len(x), dtype=bool)
    ids = [i for i, _ in good]
    edges = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))]
    root = ref.components([i for i, _ in rows + odd], edges)
    got = {r.vec_id: r for r in near_duplicates(frame, leaf=64).collect()}
    assert len(got) == len(rows) + len(odd)
    links = dict(zip(ids, near.sum(axis=1)))
    found = sum(r.n_links for r in got.values())
    assert all(r.n_links <= links.get(i, 0) for i, r in got.items())
    assert found >= 0.95 * sum(links.values())
    assert sum(got[i].component_id == root[i] for i in root) >= 0.98 * len(root)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert near_duplicates(frame.limit(0)).count() == 0


def test_vector_dedup_in_tiles(spark, monkeypatch):
    from cipherscope.llm import vector_dedup as vd

    monkeypatch.setattr(vd, "TILE", 40)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=8)
    rows = [(i, [float(np.float32(y)) for y in centre + 0.02 * rng.normal(size=8)]) for i in range(150)]
    got = vd.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert all(r.n_links == 149 and r.component_id == 0 for r in got)


def test_nearest(spark):
    from cipherscope.llm.nearest import nearest
    from cipherscope.llm.vectors import cosines

    rows, odd, frame = vectors(spark)
    good = [(i, np.array(v, float)) for i, v in rows + [odd[5]]]
    got = {}
    for r in nearest(frame.where("vec_id % 10 = 0"), frame, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = np.array([v for _, v in good])
    for i, q in [(i, v) for i, v in good if i % 10 == 0]:
        s = cosines(np.broadcast_to(q, x.shape), x)
        want = sorted((-s[j], k) for j, (k, _) in enumerate(good) if k != i)[:5]
        assert [(n, v) for n, v, _ in sorted(got[i])] == [(n + 1, k) for n, (_, k) in enumerate(want)]
        assert np.allclose([c for _, _, c in sorted(got[i])], [-c for c, _ in want], atol=1e-14)
    assert set(got) == {i for i, _ in good if i % 10 == 0}
    few = frame.where("vec_id in (0, 1, 604)")
    assert [(r.query_id, r.vec_id) for r in nearest(few.where("vec_id = 0"), few, k=5).collect()] == [(0, 1)]
    assert nearest(frame.limit(0), frame, 5).count() == 0


def test_int8_bounds_lose_nothing():
    from cipherscope.llm.nearest import cell, quantised

    rng = np.random.default_rng(9)
    x = rng.normal(size=(2500, 24))
    x[50:60] = x[0]
    ids = np.arange(2500) // 2  # two rows an id
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in (0, 6, 55):
        own = ids[q : q + 1]
        _, c, low, high = cell(own, quantised(x[q : q + 1]), ids, quantised(x), 5)
        s = unit @ unit[q]
        assert ((low <= s[c] + 1e-12) & (s[c] <= high + 1e-12)).all() and len(c) < 200
        best = sorted({(-max(s[2 * i], s[2 * i + 1]), i) for i in range(1250) if i != own[0]})[:5]
        assert {i for _, i in best} <= set(ids[c].tolist())


def test_nearest_in_several_blocks(spark, monkeypatch):
    from cipherscope.llm import nearest as op

    for name, n in (("QUERIES", 7), ("CANDIDATES", 40), ("TILE", 16), ("SHARES", 2)):
        monkeypatch.setattr(op, name, n)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (300, 6)).astype(float)  # many ties, in different blocks
    x[(x == 0).all(axis=1)] = 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[9].tolist()), (None, x[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    from cipherscope.llm.vectors import cosines

    got = {}
    for r in op.nearest(frame.where("vec_id % 10 = 0"), frame, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 300, 10):
        s = cosines(np.broadcast_to(x[q], x.shape), x)
        s[3] = max(s[3], s[9])
        want = sorted((-v, i) for i, v in enumerate(s.tolist()) if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -v) for n, (v, i) in enumerate(want)]


def test_warc(spark):
    from cipherscope.llm.warc import digest, read_archives, write_archives

    long = "<p>" + "é" * 200_000
    rows = [(1, "http://a/", "same"), (2, "http://b/ x\n", "same"), (5, None, "same"), (3, "http://c/", None), (4, "http://d/", ""), (6, "u", long), (None, "n", "same"), (7, "r", "rep"), (7, "r", "rep")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = read_archives(write_archives(frame), payloads=True).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert {i: (r.record_type, r.refers_to) for i, r in by.items()} == {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), 3: ("revisit", 4), 4: ("response", None), 6: ("response", None), None: ("response", None), 7: ("response", None)}
    for i, _, html in rows:
        payload = (html or "").encode()
        assert by[i].payload_bytes == len(payload) and by[i].payload_digest == digest(payload)
        assert bytes(by[i].payload) == payload if by[i].record_type == "response" else by[i].payload is None
    assert by[2].url == "http://b/%20x%0A" and by[5].url == "urn:page:5"
    kept = read_archives(write_archives(frame, least=1)).where("page_id = 3").first()
    assert kept.record_type == "response"
    assert read_archives(write_archives(frame.limit(0))).count() == 0


def test_components(spark):
    from cipherscope.llm.components import components

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 2000 + i) for i in range(200)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(200)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = ref.components({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in components(frame).collect()}
    loops = {n for n in want if n not in got}
    assert got == {n: c for n, c in want.items() if n not in loops} and all(want[n] == n for n in loops)
    assert components(frame.limit(0)).count() == 0


def test_registered_queries_match_sql(spark, data):
    import duckdb

    from cipherscope.llm.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    for name, sql in ORACLE_SQL.items():
        frame, result = QUERIES[name](spark, data), con.sql(sql)
        assert sorted(frame.columns) == sorted(result.columns)
        assert sorted(map(str, (tuple(r) for r in frame.select(*result.columns).collect()))) == sorted(map(str, result.fetchall())), name


def test_pipeline(spark, data):
    import corpus_pipeline as cp
    from cipherscope.llm.common import stage, table

    docs = table(spark, data, "documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(cp.STAGES)
    assert list(steps) == ["language", "near_duplicates", "repeats", "packing"]
    docs = stage(steps["language"](spark, docs, data), "t")
    assert docs.columns == columns and docs.count() == len(before)
    docs = stage(steps["near_duplicates"](spark, docs, data), "t")
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert docs.columns == columns and kept == {i for i, (_, c) in ref.jaccard(list(before.items())).items() if i == c}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = stage(steps["repeats"](spark, docs, data), "t")
    want = ref.removed(rows)
    after = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(after) == {i for i, w in want.items() if w[1] == 0 or i in after}
    for i, r in after.items():
        n_bytes, gone, _, digest = want[i]
        assert len(r.text.encode()) <= n_bytes - gone and r.n_chars == len(r.text)
        if gone == 0:
            assert r.text == before[i]
        elif len(r.text.encode()) == n_bytes - gone:
            assert hashlib.sha256(r.text.encode()).hexdigest() == digest
    check_pieces(steps["packing"](spark, docs, data).collect(), [(i, r.text) for i, r in after.items()], 2)


def test_pipeline_of_nothing(spark, nothing, data):
    import corpus_pipeline as cp

    docs = nothing
    for _, step in cp.STAGES:
        docs = step(spark, docs, data)
        assert docs.count() == 0
