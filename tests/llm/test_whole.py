"""Whole results where a cut, a clash of ids or a large group once lost some."""

import numpy as np


def near_group(rng, n, cosine, d=64):
    """Copies of one centre with noise of their own; pairs have about the given cosine."""
    centre = rng.normal(size=d)
    return centre / np.linalg.norm(centre) + np.sqrt((1 / cosine - 1) / d) * rng.normal(size=(n, d))


def test_vector_dedup_of_a_group_of_thousands(spark):
    from cipherscope.llm.vector_dedup import near_duplicates

    rng = np.random.default_rng(5)
    x = np.concatenate([near_group(rng, 3000, 0.91), rng.normal(size=(1500, 64))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = int((unit @ unit.T >= 0.9).sum()) - len(x)
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf=16).collect()  # 9 levels
    assert 0.999 * want <= sum(r.n_links for r in got) <= want


def test_forest_keeps_pairs_at_many_levels():
    from cipherscope.llm.vector_dedup import LEAST, SAMPLE, TREES, Tree

    # A million vectors: 12 levels; a third of them in one group, the others random.
    rng = np.random.default_rng(1)
    x = np.concatenate([near_group(rng, SAMPLE // 3 + 500, 0.9), rng.normal(size=(SAMPLE - SAMPLE // 3, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    group, sample = x[:500], x[500:]
    together = np.zeros((500, 500), bool)
    for t in range(TREES):
        row, leaf = Tree(sample, 12, t, 0.9, LEAST).leaves(group)
        _, leaf = np.unique(leaf, return_inverse=True)
        member = np.zeros((500, leaf.max() + 1), np.float32)
        member[row, leaf] = 1
        together |= member @ member.T > 0
    near = group @ group.T >= 0.9
    assert together[near].mean() >= 0.999


def test_repeats_of_rows_and_of_null_ids(spark):
    from cipherscope.llm.repeats import remove_spans, repeated_spans

    a, b, c, d = ("".join(np.random.default_rng(i).choice(list("abcdefgh "), 150)) for i in range(4))
    # One row twice; different and equal texts of the null id; an id of two texts, one with a passage from elsewhere.
    rows = [(7, a), (7, a), (None, b), (None, b), (None, "#" * 60 + c), (9, "x" + d), (9, "y" + a), (12, d)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.rest) for r in remove_spans(frame, repeated_spans(frame)).collect())
    assert got == sorted([(7, a), (7, a), (0, b), (0, b), (0, "#" * 60 + c), (9, "x" + d), (9, "y"), (12, "")])


def test_pipeline_keeps_texts_of_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    text = [" ".join(f"{w}{i}" for w in "a b c d e f g h i j".split()) for i in range(6)]
    # Different texts of the null id; a copy of one; an id of two texts, one a copy of a smaller id's; a row twice.
    rows = [(None, text[0]), (None, text[1]), (3, text[1]), (4, text[2]), (8, text[2]), (8, text[3]), (9, text[4]), (9, text[4]), (10, text[5])]
    frame = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(rows)], "doc_id long, text string, doc string, _row long")
    out = cp.near_duplicates(spark, frame.repartition(3), "")
    assert out.columns == frame.columns and {r["doc"] for r in out.collect()} == {"clash"}
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(0, text[0]), (0, text[1]), (4, text[2]), (8, text[3]), (9, text[4]), (10, text[5])])


def test_jaccard_links_all_texts_of_an_id(spark):
    from cipherscope.llm.jaccard import jaccard_join

    text = [" ".join(f"{w}{i}" for w in "a b c d e f g h".split()) for i in range(3)]
    rows = [(1, text[0]), (2, text[1]), (3, text[2])] + [(9, t) for t in text]  # the classes 1, 2 and 3 meet in 9
    got = {(r.doc_id, r.component_id) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 1)}


def test_packing_of_more_sources_than_are_broadcast(spark, monkeypatch):
    from cipherscope.llm import packing

    from .test_operators import WORD, check_pieces

    monkeypatch.setattr(packing, "BROADCAST_ROWS", 3)
    rows = [(i, "some words of a text " * (i % 7)) for i in range(90)]
    frame = spark.createDataFrame([(i, t, f"s{i % 30}") for i, t in rows], "doc_id long, text string, source string")
    check_pieces(packing.pack(frame, WORD, 2, window=64, group_tokens=200).collect(), rows, 2, 64)


def test_packing_sums_group_sizes_in_runs(spark, monkeypatch):
    from cipherscope.llm import packing

    from .test_operators import WORD, check_pieces

    monkeypatch.setattr(packing, "RUN", 3)
    rows = [(i, "some words of a text " * (i % 9)) for i in range(120)]
    frame = spark.createDataFrame([(i, t, "one" if i % 3 else None) for i, t in rows], "doc_id long, text string, source string")
    pieces = packing.pack(frame, WORD, 2, window=64, group_tokens=150).collect()
    assert max(p.sequence_id for p in pieces) > 30  # more groups than a run holds
    check_pieces(pieces, rows, 2, 64)


def test_token_files_of_one_doc_id(spark):
    from cipherscope.llm.token_files import read_token_files, write_token_files

    from .test_operators import WORD, library

    texts = [f"text {i} of a null doc_id" for i in range(400)] + [None, "", "same", "same"]
    rows = [(None, t) for t in texts] + [(7, "before"), (9, "after")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows, yet several tasks
    try:
        files = write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORD)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = files.orderBy("start").collect()
    assert len([f for f in parts if f.first_doc is None]) > 1  # nulls are no one task's
    assert [f.start for f in parts] == list(np.cumsum([0] + [f.n_tokens for f in parts])[:-1])
    got = read_token_files(files).collect()
    lib = library(WORD)
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in got) == sorted((i or 0, tuple(lib.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None] * len(texts) + [7, 9]


def test_language_of_text_without_blanks():
    from cipherscope.llm.langid import predict, train, word_runs

    def words(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return [buf[a:b].tobytes().decode() for a, b in zip(*word_runs(buf, np.array([0, len(buf)])))]

    assert words("ab 你好吗x, l’été " + "y" * 90 + "ไทย") == ["ab", "你好", "吗", "x", "l’été", "y" * 40, "y" * 40, "y" * 10, "ไท", "ย"]
    rng = np.random.default_rng(2)
    text = lambda first, n: "".join(chr(first + i) for i in rng.integers(0, 60, n))
    model = train([(lang, words(text(first, 128))) for lang, first in (("ja", 0x3042), ("zh", 0x4E00)) for _ in range(40)])
    # A quotation of 50 characters first, then 400 of the document's own language: all of it counts.
    buf = np.frombuffer((text(0x4E00, 50) + text(0x3042, 400)).encode(), np.uint8)
    label, score = predict(model, buf, np.array([0, len(buf)]))
    assert label == ["ja"] and 0.8 < score[0] < 0.95


def copied_texts(seed, n=60):
    """Texts of a few shared passages with edges of their own."""
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("abcd "), int(rng.integers(60, 700)))) for _ in range(8)]
    return [(i, "".join(rng.choice(list("abcd "), int(rng.integers(0, 90)))) + "".join(pool[j][int(rng.integers(0, 50)) :] for j in rng.integers(0, 8, int(rng.integers(0, 6))))) for i in range(n)]


def test_repeats_in_windows_of_a_text(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cipherscope.llm import repeats

    from . import reference as ref

    rows = copied_texts(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = ref.removed(rows)
    digest = lambda out: {r.doc_id: tuple(r)[1:] for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}

    def texts_cut(batch_bytes, hot, bits):
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "COUNTER_BITS", bits)
        monkeypatch.setattr(repeats, "windows", lambda offsets, most, overlap, own=windows: own(offsets, batch_bytes, overlap))
        return digest(repeats.remove_spans(frame, repeats.repeated_spans(frame)))

    windows = repeats.windows
    assert texts_cut(700, 10**6, 4) == want  # documents longer than a slice
    assert texts_cut(700, 3, 1) == want  # and buckets that are not sorted in one piece


def test_windows_cover_every_string_once():
    from cipherscope.llm.repeats import windows

    offsets = np.array([0, 5, 5, 1400, 1401, 2200])
    starts = []
    for a, b, lo, hi, before in windows(offsets, 300, 99):
        for d in range(a, b):
            first, last = (lo, hi) if b == a + 1 else (offsets[d], offsets[d + 1])
            starts += [(d, p) for p in range(first, last - 99)]
    assert starts == sorted(set(starts)) and len(starts) == (1395 - 99) + (799 - 99)


def test_pointers_come_from_the_round_before(spark):
    from cipherscope.llm.repeats import _sift

    # Two buckets of three rows; runs 7 and 9 open, equal ones again.
    rows = [(5, 7, 1, 0, 0), (5, 9, 2, 0, 0), (5, 7, 3, 0, 0), (6, 8, 1, 0, 1 << 16), (6, 8, 2, 0, 1 << 16), (4, 1, 9, 0, 0)]
    frame = spark.createDataFrame(rows, "bucket long, run long, doc long, part long, place long")
    for hot in (None, frame):
        got = _sift(frame, 100, hot).collect()
        opened = {(r.doc, r.pointer) for r in got if r.open}
        assert {d for d, _ in opened} == {1, 2} and len({p for _, p in opened}) == 1
        assert sorted((r.doc, r.start, r.stop) for r in got if not r.open) == [(2, 1, 101), (3, 0, 100)]


ODD = [(None, "a null id here"), (None, "another null id"), (5, "twice the same row"), (5, "twice the same row"), (5, "other text of five"), (7, None), (8, ""), (9, "x" * 70_000 + " " + "yz " * 900), (10, "tie"), (11, "tie")]


def odd_frame(spark, **extra):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, t, "en" if i != 9 else None, "s") for i, t in ODD], "doc_id long, text string, lang string, source string")
    return frame.withColumns({k: F.lit(v) for k, v in extra.items()}).repartition(3)


def test_codecs_of_null_and_repeated_ids(spark):
    from cipherscope.llm.bpe import round_trip
    from cipherscope.llm.packing import pack
    from cipherscope.llm.token_files import read_token_files, write_token_files
    from cipherscope.llm.trie_counts import token_counts

    from .test_operators import BYTE, PIECE, WORD, library

    frame, word, byte = odd_frame(spark, ids="clash", n_tokens=1, start=2), library(WORD), library(BYTE)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    ids = {t: word.encode(t or "", add_special_tokens=False).ids for _, t in ODD}
    got = [(r.doc_id, list(r.ids)) for r in read_token_files(write_token_files(frame, WORD, end_id=1)).collect()]
    assert sorted(got, key=key) == sorted([(i, [*ids[t], 1]) for i, t in ODD], key=key)
    pieces = pack(frame, WORD, 2, window=512).collect()
    assert sum(p.length for p in pieces) == sum(len(ids[t]) + 1 for _, t in ODD)
    assert sum(p.length for p in pieces if p.doc_id is None) == sum(len(ids[t]) + 1 for i, t in ODD if i is None)
    both = sorted(((r.doc_id, list(r.ids), r.text) for r in round_trip(frame, BYTE).collect()), key=key)
    assert both == sorted([(i, byte.encode(t or "").ids, t or "") for i, t in ODD], key=key)
    assert sorted((r.doc_id or 0, r.n_pretokens) for r in token_counts(frame, PIECE).collect()) == sorted((i or 0, len((t or "").split())) for i, t in ODD)


def test_token_counts_of_long_words(spark):
    from cipherscope.llm.trie_counts import MARK, UNKNOWN, piece_scores, token_counts

    from . import reference as ref
    from .test_operators import PIECE

    rng = np.random.default_rng(4)
    word = "".join(rng.choice(list("abcdeé"), 4000))
    frame = spark.createDataFrame([(1, word), (2, word[:3000] + " " + word)], "doc_id long, text string")
    scores = piece_scores(PIECE)
    one, two = (ref.viterbi_tokens(MARK + w, scores, UNKNOWN) for w in (word, word[:3000]))
    assert {r.doc_id: r.n_tokens for r in token_counts(frame, PIECE).collect()} == {1: one, 2: one + two}


def test_language_of_odd_rows(spark):
    from pyspark.sql import functions as F

    from cipherscope.llm.langid import identify, labelled

    frame = odd_frame(spark, score=0.5, lang_pred="clash", held_out=True, c_0="clash")
    got = identify(frame, F.lit(False)).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (7, 8)} == {"und"} and {r.lang_pred for r in got if r.doc_id == 5} == {"en"}
    kept = labelled(frame, F.lit(False))
    assert kept.columns == ["lang_pred", "score", "held_out", *(f"c_{i}" for i in range(len(frame.columns)))]


def test_language_of_a_long_text_in_windows():
    from cipherscope.llm.langid import predict, train

    model = train([(lang, [w] * 64) for lang, w in (("a", "alpha"), ("b", "beta")) for _ in range(30)])
    text = np.frombuffer(("alpha " * 300 + "beta " * 700 + "z" * 5000).encode(), np.uint8)
    whole, windowed = (predict(model, text, np.array([0, len(text)]), most) for most in (1 << 20, 256))
    assert whole[0] == windowed[0] == ["b"] and abs(whole[1][0] - windowed[1][0]) < 0.1


def test_many_languages_are_all_learned(spark):
    from pyspark.sql import functions as F

    from cipherscope.llm.langid import fit

    rows = [(i, f"w{i % 90}x{j}y " * 9, f"l{i % 90:02}") for j, i in enumerate(range(180))]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(False))
    assert model.languages == [f"l{i:02}" for i in range(90)]


def test_vectors_of_two_lengths_and_null_ids(spark):
    from cipherscope.llm.vector_dedup import near_duplicates

    rng = np.random.default_rng(6)
    short, long = rng.normal(size=4), rng.normal(size=9)
    rows = [(i, (short + 0.01 * rng.normal(size=4)).tolist()) for i in range(60)] + [(100 + i, (long + 0.01 * rng.normal(size=9)).tolist()) for i in range(60)]
    rows += [(None, short.tolist()), (None, [0.0] * 4), (3, long.tolist())]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=16).collect()
    assert len(got) == len(rows)
    links = {r.vec_id: r.n_links for r in got if r.vec_id not in (None, 3)}
    assert {links[i] for i in links if i < 100} == {60} and {links[i] for i in links if i >= 100} == {60}
    assert sorted(r.n_links for r in got if r.vec_id is None) == [0, 60]
    assert {r.component_id for r in got} == {None}  # the null id reaches id 3, which has a vector of either length


def test_pipeline_keeps_clashing_columns(spark):
    import corpus_pipeline as cp

    frame = odd_frame(spark, rest="clash", kept="clash", n_bytes="clash", spans="clash", lang_pred="clash", row="clash", node="clash", doc="clash")
    docs, rows = frame, len(ODD)
    for name, step in cp.STAGES[:-1]:
        docs = step(spark, docs, "")
        assert docs.columns == frame.columns and {r.lang_pred for r in docs.collect()} == {"clash"}
        assert docs.count() < rows or name == "repeats"
        rows = docs.count()
    assert cp.STAGES[-1][1](spark, docs, "").count() >= rows


def test_shared_folder_is_asked_for_on_a_cluster():
    import pytest

    from cipherscope.llm.common import shared_dir

    class Conf:
        master, applicationId, get = "spark://host:7077", "x", staticmethod(lambda key, default=None: default)

    class Session:
        conf = sparkContext = Conf

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
