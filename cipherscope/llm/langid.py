"""Language identification by a linear-chain conditional random field over words.

Text without blanks between words (Chinese, Japanese, Korean, Thai, Lao, Burmese, Khmer characters) is cut into words of
STEP characters, other runs of letters into words of at most LONG, so that all of a run counts, by its length.

Each word has affix features (up to three characters from either end), character n-grams of one to three, and lexicon
features (the languages whose frequent training words hold it), hashed into one weight table; transitions between the
labels of neighbouring words are learned with them. Chains of at most CHAIN words cover a whole text, a very long one in
windows; forward-backward gives every word a distribution over the languages, which also labels code-switched text, and a
document's label is the language with the largest sum of them. Its score is that sum's share.

Training is on a bounded sample (at most PER_LANGUAGE distinct texts of every language, one window of WINDOW words each),
chosen by a hash of the text; windows of different languages are joined into chains, so that transitions see switches.
Training minimises the penalised negative log-likelihood by Adam on the driver. Prediction uses the text alone.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is everything where nothing was
learned; ties go to the language that sorts first; repeated rows give repeated results; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, light
from .scan import doc_slices, mix, run_hashes, text_bytes
from .tokens import ragged

#: Documented bounds of the training sample: texts of each language at most (fewer where there are many languages: CELLS
#: over the square of their number, but one at least), words of each text's window. Every language is learned.
PER_LANGUAGE, CELLS, WINDOW = 800, 1 << 16, 64
#: Characters of a word in text without blanks, and at most in other text.
STEP, LONG = 2, 40
CHAIN, TABLE, LEXICON_LEAST, ROUNDS, PENALTY = 128, 1 << 17, 3, 60, 1e-4
UND = "und"


def word_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ASCII letters and bytes of other characters, cut into words; those without a letter are dropped once decoded."""
    letter = (((buf | 32) >= 97) & ((buf | 32) <= 122)) | (buf >= 128)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    first[edges] = letter[edges]
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(np.append(~letter | first, True))
    return cut_runs(buf, starts, stops[np.searchsorted(stops, starts, side="right")])


def cut_runs(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts runs where text without blanks begins or ends, inside it every STEP characters, elsewhere every LONG."""
    wide, at = np.zeros(len(buf) + 1, bool), np.flatnonzero(buf >= 0xE0)
    lead, then = buf[at], np.append(buf, 0)[at + 1]
    thai_lao, burmese_khmer = (lead == 0xE0) & (then >= 0xB8) & (then <= 0xBB), (lead == 0xE1) & ((then <= 0x82) | (then == 0x9E) | (then == 0x9F))
    wide[at] = thai_lao | burmese_khmer | ((lead >= 0xE3) & (lead <= 0xED)) | ((lead == 0xF0) & (then >= 0xA0))
    has = np.concatenate([[0], np.cumsum(wide)])
    some = (stops - starts > LONG) | (has[stops] > has[starts])
    if not some.any():
        return starts, stops
    lens = (stops - starts)[some]
    place, run = ragged(starts[some], lens), np.repeat(np.arange(len(lens)), lens)
    begins = (buf[place] & 0xC0) != 0x80
    place, run = place[begins], run[begins]
    kind = wide[place]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (kind[1:] != kind[:-1])
    first = np.flatnonzero(fresh)
    count = np.arange(len(place)) - first[np.cumsum(fresh) - 1]
    cut = count % np.where(kind, STEP, LONG) == 0
    place, run = place[cut], run[cut]
    ends = stops[some][run]
    same = run[1:] == run[:-1]
    ends[:-1][same] = place[1:][same]
    starts, stops = np.concatenate([starts[~some], place]), np.concatenate([stops[~some], ends])
    order = np.argsort(starts, kind="stable")
    return starts[order], stops[order]


#: Words' features: six affixes (two to four characters of ^word$ from either end), then all runs of one to three.
AFFIXES, GRAMS = (2, 3, 4), (1, 2, 3)


def feature_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words' features, one word after another, and each word's first. Words are not empty."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    marked = "".join(f"^{w}$" for w in words)
    chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    # runs[n][i]: the hash of the n characters from i on.
    runs, h = {}, np.zeros(len(chars), np.uint64)
    for n in range(1, 5):
        h = h[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + (chars[n - 1 :] + np.uint64(n))
        runs[n] = h
    rows = lambda x, kind: (mix(x + np.uint64(kind)) % np.uint64(TABLE)).astype(np.int32)
    counts = 2 * len(AFFIXES) + sum(size - n + 1 for n in GRAMS)
    first = np.cumsum(counts) - counts
    out, place = np.empty(int(counts.sum()), np.int32), first.copy()
    for n in AFFIXES:
        short = np.minimum(size, n)  # a word of one character has three with its marks
        for kind, at in ((1, start), (2, start + size - short)):
            for m in np.unique(short):
                own = short == m
                out[place[own]] = rows(runs[int(m)][at[own]], kind)
            place += 1
    for n in GRAMS:
        out[ragged(place, size - n + 1)] = rows(runs[n][ragged(start, size - n + 1)], 3)
        place += size - n + 1
    return out, first


def forward_backward(emit: np.ndarray, mask: np.ndarray, start: np.ndarray, move: np.ndarray, learn: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of chains (chain, place, label), the summed pairs of neighbouring labels (with ``learn``), and each
    chain's log-sum.

    ``emit`` and ``move`` are scores; places where ``mask`` is false lie behind a chain's end.
    """
    n, t, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e, a = np.exp(emit - top), np.exp(move)
    alpha, scale = np.empty((t, n, k)), np.ones((t, n))
    x = e[:, 0] * np.exp(start)
    for i in range(t):
        if i:
            x = np.where(mask[:, i, None], (alpha[i - 1] @ a) * e[:, i], alpha[i - 1])
        s = x.sum(axis=1)
        scale[i] = s
        alpha[i] = x / s[:, None]
    beta, pairs = np.ones((n, k)), np.zeros((k, k))
    marginals = np.empty((n, t, k))
    for i in range(t - 1, -1, -1):
        m = alpha[i] * beta
        marginals[:, i] = m / m.sum(axis=1, keepdims=True)
        if i:
            y = e[:, i] * beta
            on = mask[:, i]
            if learn and on.any():
                w = 1 / np.einsum("ni,ij,nj->n", alpha[i - 1][on], a, y[on])
                pairs += (alpha[i - 1][on] * w[:, None]).T @ y[on] * a
            z = y @ a.T
            beta = np.where(on[:, None], z / z.sum(axis=1, keepdims=True), beta)
    marginals *= mask[:, :, None]
    return marginals, pairs, np.log(scale).sum(axis=0) + (top[:, :, 0] * mask).sum(axis=1)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    known: np.ndarray  # the lexicon's words' scores
    start: np.ndarray
    move: np.ndarray

    def emissions(self, words: list[str], together: int = 8192) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for i in range(0, len(words), together):
            rows, first = feature_rows(words[i : i + together])
            out[i : i + together] = np.add.reduceat(self.weights[rows], first, axis=0)
        if self.lexicon:
            at = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
            out[at >= 0] += self.known[at[at >= 0]]
        return out


def train(windows: list[tuple[str, list[str]]], seed: int = 5) -> Model:
    """``windows``: (language, words). Deterministic for the same windows."""
    windows = sorted((lang, ws) for lang, ws in windows if ws)
    languages = sorted({lang for lang, _ in windows})
    k = len(languages)
    if not k:
        return Model([], np.zeros((TABLE, 0)), {}, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(windows))
    vocabulary: dict[str, int] = {}
    tokens, labels = [], []
    for i in order:
        lang, ws = windows[i]
        tokens += [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
        labels += [languages.index(lang)] * len(ws)
    tokens, labels = np.array(tokens), np.array(labels)
    words = list(vocabulary)
    counts = np.zeros((len(words), k))
    np.add.at(counts, (tokens, labels), 1)
    known = (counts >= LEXICON_LEAST).astype(float)
    frequent = np.flatnonzero(known.any(axis=1))
    # Chains of CHAIN words run through windows of several languages.
    n = -(-len(tokens) // CHAIN)
    mask = np.arange(n * CHAIN).reshape(n, CHAIN) < len(tokens)
    ids, gold = np.zeros((n, CHAIN), np.int64), np.zeros((n, CHAIN), np.int64)
    ids[mask], gold[mask] = tokens, labels
    both = mask[:, 1:]
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    rows, first = feature_rows(words)
    batches = [slice(i, min(i + 256, n)) for i in range(0, n, 256)]
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(first, append=len(rows)))
    params = [np.zeros((k, TABLE + k)), np.zeros(k), np.zeros((k, k))]
    errors: list[float] = []
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, ROUNDS + 1):
        w, start, move = params
        emit = np.stack([np.add.reduceat(w[j].take(rows), first) for j in range(k)], axis=1) + known @ w[:, TABLE:].T
        by_word, begins, pairs, error = np.zeros((len(words), k)), np.zeros(k), -gold_pairs, 0.0
        for b in batches:  # chains, so that memory does not grow with the number of languages times the sample
            marginals, found, _ = forward_backward(emit[ids[b]], mask[b], start, move)
            diff = (marginals - np.eye(k)[gold[b]]) * mask[b][:, :, None]
            by_word += np.stack([np.bincount(ids[b].ravel(), diff[:, :, j].ravel(), len(words)) for j in range(k)], axis=1)
            begins += diff[:, 0].sum(axis=0)
            error += np.abs(diff).sum()
            pairs += found
        each = np.ascontiguousarray(by_word.T)
        grad_w = np.stack([np.bincount(rows, each[j].take(owner), TABLE) for j in range(k)])
        grads = [np.concatenate([grad_w, each @ known], axis=1), begins, pairs]
        for p, g, a, b in zip(params, grads, m1, m2):
            g = g / len(tokens) + PENALTY * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        errors.append(error)
        if step > 12 and error > 0.99 * errors[-7]:  # no longer falling
            break
    lexicon = {words[i]: at for at, i in enumerate(frequent)}
    return Model(languages, np.ascontiguousarray(params[0][:, :TABLE].T, np.float32), lexicon, (known[frequent] @ params[0][:, TABLE:].T).astype(np.float32), params[1], params[2])


def windows_of(buf: np.ndarray, offsets: np.ndarray, most: int):
    """(first document, offsets of a window's documents): runs of about ``most`` bytes; a longer document comes in windows
    that end at a byte which is no letter, or else between characters."""
    for a, b in doc_slices(offsets, most):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= most:
            yield a, offsets[a : b + 1]
            continue
        while lo < hi:
            upto = min(hi, lo + most)
            if upto < hi:
                own = buf[lo:upto]
                gap = np.flatnonzero((own < 128) & (((own | 32) < 97) | ((own | 32) > 122)))
                gap = gap if len(gap) else np.flatnonzero(((own & 0xC0) != 0x80)[1:])
                upto = lo + int(gap[-1]) + 1 if len(gap) else upto
            yield a, np.array([lo, upto])
            lo = upto


def predict(model: Model, buf: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> tuple[list[str], np.ndarray]:
    """(label, score) of the documents buf[offsets[i]:offsets[i + 1]]."""
    docs, k = len(offsets) - 1, len(model.languages)
    sums, words_in = np.zeros((docs, max(k, 1))), np.zeros(docs, np.int64)
    for a, own in windows_of(buf, offsets, most) if k else ():
        found, counts = label_sums(model, buf[own[0] : own[-1]], own - own[0])
        sums[a : a + len(counts)] += found
        words_in[a : a + len(counts)] += counts
    best = sums.argmax(axis=1)
    share = sums[np.arange(docs), best] / np.maximum(words_in, 1)
    labels = [model.languages[b] if n else UND for b, n in zip(best, words_in)]
    return labels, np.where(words_in > 0, np.clip(share, 0, 1), 0.0)


def label_sums(model: Model, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's marginals summed over its words, and its number of words."""
    docs, k = len(offsets) - 1, len(model.languages)
    sums = np.zeros((docs, k))
    starts, ends = word_runs(buf, offsets)
    if not len(starts):
        return sums, np.zeros(docs, np.int64)
    codes, distinct = pd.factorize(run_hashes(buf, starts, ends))
    where = np.zeros(len(distinct), np.int64)
    where[codes] = np.arange(len(codes))
    raw = buf.tobytes()
    words = b"\0".join([raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]).decode().lower().split("\0")
    ascii_letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    has = np.concatenate([[0], np.cumsum(ascii_letter)])
    is_word = has[ends[where]] > has[starts[where]]
    for i in np.flatnonzero(~is_word):
        is_word[i] = any(map(str.isalpha, words[i]))
    table = np.zeros((len(words), k), np.float32)
    table[is_word] = model.emissions([w for w, r in zip(words, is_word) if r])
    on = is_word[codes]
    codes, starts = codes[on], starts[on]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words_in = np.bincount(doc, minlength=docs)
    # Chains: the words of a document in runs of CHAIN, those of like length together.
    firsts = np.cumsum(words_in) - words_in
    chains = -(-words_in // CHAIN)
    chain_doc = np.repeat(np.arange(docs), chains)
    part = np.arange(len(chain_doc)) - np.repeat(np.cumsum(chains) - chains, chains)
    begin = firsts[chain_doc] + part * CHAIN
    length = np.minimum(CHAIN, words_in[chain_doc] - part * CHAIN)
    order = np.argsort(length, kind="stable")
    for i in range(0, len(order), 1024):
        own = order[i : i + 1024]
        t = int(length[own].max())
        mask = np.arange(t) < length[own][:, None]
        at = np.where(mask, begin[own][:, None] + np.arange(t), 0)
        marginals, _, _ = forward_backward(table[codes[at]].astype(np.float64), mask, model.start, model.move, learn=False)
        np.add.at(sums, chain_doc[own], marginals.sum(axis=1))
    return sums, words_in


def fit(docs: DataFrame, held_out) -> Model:
    """Learns from the text and lang of rows where ``held_out`` is not true, on the bounded sample: of every language the
    same number of distinct texts, those with the smallest hashes."""
    known = docs.where(~F.coalesce(held_out, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return train([])
    each = max(1, min(PER_LANGUAGE, CELLS // len(sizes) ** 2))
    # A draw of about twice as many first, so that few texts are shuffled and ordered.
    chance = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * each / n)))])
    at = F.xxhash64("text")
    drawn = known.where(F.pmod(at, F.lit(1 << 30)) / float(1 << 30) < chance[F.col("lang")])
    drawn = drawn.select(F.col("lang").alias("label"), at.alias("at"), "text").groupBy("label", "at").agg(F.min("text").alias("text"))
    order = Window.partitionBy("label").orderBy("at")
    sample = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select("label", "text", F.shiftrightunsigned("at", 8).alias("at"))

    def cut(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            rows = []
            for i, (lang, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                own = buf[offsets[i] : offsets[i + 1]]
                starts, ends = word_runs(own, np.array([0, len(own)]))
                first = at % max(1, len(starts) - WINDOW + 1)
                raw = own.tobytes()
                words = [raw[a:b].decode().lower() for a, b in zip(starts[first : first + WINDOW], ends[first : first + WINDOW])]
                rows.append((lang, [w for w in words if any(map(str.isalpha, w))]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["lang", "words"])

    return train([(r[0], r[1]) for r in sample.mapInArrow(cut, "lang string, words array<string>").collect()])


def labelled(docs: DataFrame, held_out, model: Model | None = None) -> DataFrame:
    """lang_pred, score, held_out, and the columns of docs as c_0, c_1, ... in their order (so that no names clash)."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, held_out))  # bounded: the weight table and lexicon
    kept = [F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.coalesce(held_out, F.lit(False)).alias("held_out"), *kept)
    at = docs.columns.index("text") + 1

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                labels, scores = predict(sent.value, *text_bytes(batch.column(at)))
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(scores), *batch.columns], ["lang_pred", "score", *batch.schema.names])

    schema = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(light(run), "lang_pred string, score double" + schema)


def identify(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    found = labelled(docs.select("doc_id", "text", "lang"), held_out)
    return found.select(F.col("c_0").cast("long").alias("doc_id"), "held_out", "lang_pred", "score")
