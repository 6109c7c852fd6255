"""Repacking, divergence audit and alignment against plain versions, with nulls, empties, long texts, ties, repeats and
clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
WORD, BYTE, PIECE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string"
CLASH = ("slot", "ids", "open", "grp", "place", "n", "d", "p", "q", "term", "block", "tile", "chunk", "pair", "count", "best", "offset", "head")


def word(rng):
    return "".join(rng.choice("abcdeéßXYZ") for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [None, "", " ", "  \n\t two  blanks ", "One", "one one ONE", "<s>x</s> <|endoftext|> <unk>", "a▁b", "日本語のテキスト 👍🏽 ﬁ", "x" * 3000, "it's 12,345 don't", "\x00\x01"]
    texts += [" ".join(word(rng) for _ in range(rng.choice([3, 30, 300]))) for _ in range(60)]
    texts += ["same text of a few words", "same text of a few words", " ".join(word(rng) for _ in range(9000))]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for i, t in enumerate(texts)]
    return out + [out[-1], (None, "null id", "de", "a"), (None, None, "de", "b"), (7000, "!!", "xx", "p"), (7001, "??", "xx", "q")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# Operator 11


def exact_bins(lengths, window):
    """Fewest bins by trying all ways (few lengths)."""
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for k in range(len(free)):
            if free[k] >= lengths[i] and free[k] not in free[:k]:
                place(i + 1, free[:k] + [free[k] - lengths[i]] + free[k + 1 :])
        place(i + 1, free + [window - lengths[i]])

    place(0, [])
    return best


def test_bound_never_exceeds_the_fewest_bins():
    from cipherscope.llm.repacking import best_fit_decreasing, lower_bound

    rng = random.Random(3)
    tight = 0
    for _ in range(150):
        window = rng.choice([10, 12, 60])
        lengths = np.array([rng.randint(1, window) for _ in range(rng.randint(1, 9))])
        fewest, bound = exact_bins(sorted(lengths.tolist(), reverse=True), window), lower_bound(np.bincount(lengths, minlength=window + 1))
        bins, offsets, free = best_fit_decreasing(lengths, window)
        assert bound <= fewest <= len(free)
        assert bound >= -(-int(lengths.sum()) // window)
        tight += bound == fewest
        for b in range(len(free)):
            own = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist()))
            assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) + free[b] == window
    assert tight > 120
    assert lower_bound(np.bincount([6] * 7, minlength=11)) == 7  # two never share a bin
    assert lower_bound(np.bincount([4] * 9, minlength=11)) == 5  # no three do


def test_repacking(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    from cipherscope.llm.repacking import certificate, repack

    coder = Tokenizer.from_file(WORD)
    window = 64
    found = repack(docs, WORD, end_id=1, window=window, group_tokens=2000, exchange_tokens=600).collect()
    ids = {i: coder.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _, _ in rows if i is not None}
    want = Counter()
    for i, t, _, _ in rows:
        own = coder.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(own), window):
            want[i, k // window, k, len(own[k : k + window]), tuple(own[k : k + window])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in found) == want
    assert max(map(len, ids.values())) > 4096
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= window
    n, bound = certificate(spark.createDataFrame([(r.length, r.sequence_id, r.offset) for r in found], "length long, sequence_id long, offset long"), window)
    assert n == len(by) and bound <= n <= bound + 1
    assert repack(nothing, WORD, end_id=1).count() == 0


def test_repacking_exchanges_what_no_partition_fills(spark):
    """Partitions of one length each leave gaps that only other partitions' lengths fill."""
    from cipherscope.llm.repacking import repack

    texts = [(i, " ".join(["one"] * (39 if i % 2 else 23))) for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartitionByRange(4, (F.col("doc_id") % 2), "doc_id")
    found = repack(frame, WORD, end_id=1, window=64)
    assert found.count() == 400 and found.select("sequence_id").distinct().count() == 200


# Operator 12


def plain_divergence(rows, min_docs=3, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(lang or "", source or "", terms(text)) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in own for t in set(d[2])).items() if n >= min_docs}
        counts = {None: Counter(t for d in own for t in d[2] if t in kept)}
        for s in {d[1] for d in own}:
            counts[s] = Counter(t for d in own if d[1] == s for t in d[2] if t in kept)
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in counts.items()}
        for s in counts.keys() - {None}:
            parts = {"pair": [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in counts if x not in (None, s)]}
            parts["term"] = [(t, (p[s][t] - p[None][t]) ** 2 // p[None][t]) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, k + 1) for k, (t, v) in enumerate(items[: top if part == "term" else None])]
    return sorted(out)


def as_rows(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence(docs, rows, nothing):
    from cipherscope.llm.divergence import divergence

    want = plain_divergence(rows)
    assert as_rows(divergence(docs)) == want
    assert ("xx", "p", "pair", "q", 0, 1) in want
    assert as_rows(divergence(docs, block_cells=7)) == want
    assert divergence(nothing).count() == 0


def test_divergence_of_many_sources(spark):
    """Several tiles of groups and blocks of columns."""
    from cipherscope.llm.divergence import divergence

    rng = random.Random(2)
    words = [word(rng) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 60])]) for _ in range(rng.randint(0, 12))), "en", f"s{i % 41}") for i in range(300)]
    found = divergence(spark.createDataFrame(rows, DOCS), block_cells=100, tile=8, top=4)
    assert as_rows(found) == plain_divergence(rows, top=4)


@pytest.mark.parametrize("states", [3, 1 << 18])
def test_joint_traversal(states, monkeypatch):
    from cipherscope.llm import divergence as d

    monkeypatch.setattr(d, "STATES", states)
    rng = np.random.default_rng(5)
    for n, m, cols, share in itertools.product((1, 5, 8), (1, 3), (1, 7, 40), (0.0, 0.1, 0.9)):
        grids = [np.where(rng.random((k, cols)) < share, rng.integers(1, 10**9, (k, cols)), 0) for k in (n, m)]
        bases = [rng.integers(1, 10**6, k) for k in (n, m)]
        full = [np.where(g > 0, g, b[:, None]) for g, b in zip(grids, bases)]
        height = 6
        trees = [d.Tree(*np.nonzero(g), height) for g in grids]
        weights = [np.append(g[np.nonzero(g)][t.order], 0) for g, t in zip(grids, trees)]
        there, back = d.joint_prices(*trees, height, cols, bases, weights)
        square = (full[0][:, None, :] - full[1][None, :, :]) ** 2
        assert (there == (square // full[1][None]).sum(axis=2)).all() and (back == (square // full[0][:, None]).sum(axis=2)).all()
        same, _ = d.joint_prices(trees[0], trees[0], height, cols, (bases[0],) * 2, (weights[0],) * 2)
        square = (full[0][:, None, :] - full[0][None, :, :]) ** 2
        upper = np.triu_indices(n, 1)
        assert (same[upper] == (square // full[0][None]).sum(axis=2)[upper]).all()


# Operator 13


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from cipherscope.llm.bpe import byte_symbols

    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    back = {c: i for i, c in enumerate(byte_symbols())}
    out, holding = [], Counter()
    for i, text, _, _ in rows:
        whole = (" " + text).encode() if text else b""
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(back[c] for c in a.id_to_token(t)) for t in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(t)[3:-1], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in ids_b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        spans = []
        for tokens in (bytes_a, bytes_b):
            ends = list(itertools.accumulate(map(len, tokens)))
            spans.append([(e - len(t), e) for t, e in zip(tokens, ends)])
        links = []
        k = 0
        for x, (s, e) in zip(ids_a, spans[0]):
            while k and spans[1][k - 1][1] > s:
                k -= 1
            while k < len(ids_b) and spans[1][k][1] <= s:
                k += 1
            m = k
            while m < len(ids_b) and spans[1][m][0] < e:
                links.append((x, ids_b[m]))
                m += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, per, low = [], 0, 0
        for c in cuts:
            own_a = [str(t) for t, (_, e) in zip(ids_a, spans[0]) if low < e <= c] if len(ids_a) < 2000 else None
            own_b = [str(t) for t, (_, e) in zip(ids_b, spans[1]) if low < e <= c] if len(ids_a) < 2000 else None
            if own_a is not None:
                groups.append(",".join(own_a) + "|" + ",".join(own_b))
                per += len(own_a) * len(own_b)
            low = c
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""
        out.append((i, len(ids_a), len(ids_b), len(cuts), links, digest if len(ids_a) < 2000 else None, per))
        holding.update(set(links))
    most = {}
    for (x, _), n in holding.items():
        most[x] = max(n, most.get(x, 0))
    return [(i, na, nb, ng, len(links), sum(holding[x] == most[x[0]] for x in links), sum(holding[x] for x in links), digest, per) for i, na, nb, ng, links, digest, per in out]


def test_alignment(docs, rows, nothing):
    from cipherscope.llm.alignment import aligned, alignment_texts

    for chunk_bytes in (1 << 24, 2000):
        got = aligned(docs, BYTE, PIECE, chunk_bytes=chunk_bytes).collect()
        got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256 if r.n_a < 2000 else None, r.n_group_links if r.n_a < 2000 else 0) for r in got]
        assert sorted(got, key=str) == sorted(plain_alignment(rows), key=str)
    assert aligned(nothing, BYTE, PIECE).count() == 0
    texts = {r.doc_id: r for r in alignment_texts(docs, BYTE, PIECE).collect()}
    assert texts[0].groups == texts[7].groups == "" and texts[7].n_a == 0  # null; the mark's own character
    assert texts[4].groups.count("|") == texts[4].n_groups


def test_links_have_their_bytes(spark):
    from cipherscope.llm.alignment import link_table

    found = link_table(spark.createDataFrame([(1, "Unbelievable tokenizations"), (2, None)], "doc_id long, text string"), BYTE, PIECE).collect()
    assert {r.doc_id for r in found} == {1} and sum(r.n_bytes for r in found) == len(" Unbelievable tokenizations")


def test_row_product():
    from cipherscope.llm.alignment import row_product

    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.random((6, 9)) < 0.3, rng.random((9, 7)) < 0.3
        csr = lambda m: (np.append(0, np.cumsum(m.sum(axis=1))), np.nonzero(m)[1])
        heads, cols, n = row_product(csr(x), csr(y))
        dense = np.zeros((6, 7), int)
        dense[np.repeat(np.arange(6), np.diff(heads)), cols] = n
        assert (dense == x.astype(int) @ y.astype(int)).all() and len(cols) == (dense > 0).sum()


def test_piece_codec_gives_the_librarys_ids():
    import sentencepiece

    from cipherscope.llm.alignment import PieceCodec

    model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECE), random.Random(8)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "日", "\t", "ing", ".", "<s>", "1", "　"]) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    data = [(" " + t).encode() for t in texts]
    ids, counts = PieceCodec.of(PIECE).encode(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data])))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [model.encode(t) for t in texts]


def test_ids_crc(spark):
    from cipherscope.llm.repacking import repack

    row = repack(spark.createDataFrame([(1, "two words")], "doc_id long, text string"), WORD, end_id=1).select("*", F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(bytes(row.ids)) and row.length * 4 == len(row.ids)


# Words that structure alone makes collide in a polynomial hash


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_thue_morse_words_stay_apart(spark):
    import sentencepiece  # noqa: F401
    from tokenizers import Tokenizer

    from cipherscope.llm.bpe import BytePairCodec
    from cipherscope.llm.jaccard import jaccard_join, shingle_sets
    from cipherscope.llm.scan import run_hashes
    from cipherscope.llm.tokens import ChunkEncoder
    from cipherscope.llm.trie_counts import TrieCounter

    pair = [thue_morse(2048, "i", "n"), thue_morse(2048, "n", "i")]
    data = [t.encode() for t in pair]
    buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.array([0, 2048, 4096])
    h = run_hashes(buf, offsets[:-1], offsets[1:])
    assert h[0] != h[1]
    assert len(set(run_hashes(buf, np.arange(0, 4096, 64), np.arange(64, 4160, 64)).tolist())) == len({buf[i : i + 64].tobytes() for i in range(0, 4096, 64)})
    assert not set(shingle_sets(buf, offsets)[0].tolist()) & set(shingle_sets(buf, offsets)[1].tolist())
    for codec, path in ((ChunkEncoder, WORD), (BytePairCodec, BYTE)):
        ids, counts = codec(path).encode(buf, offsets)
        plain = Tokenizer.from_file(path)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in pair]
    counter = TrieCounter.of(PIECE)
    assert counter.pretoken_counts(pair).tolist() == [counter.pretoken_counts([t])[0] for t in pair]
    rows = [(1, " ".join([pair[0]] * 9)), (2, " ".join([pair[1]] * 9))]
    assert {r.component_id for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2}
