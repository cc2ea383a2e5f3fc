"""Operator 7: language identification of words in code-switched text by a linear-chain conditional random field.

A word is a run of letters (ASCII letters and bytes from 128 on). Its features are hashed: prefixes and suffixes of 1 to 3 bytes,
2-, 3- and 4-grams of bytes with the word's ends, and the word itself (the lexicon). Each has a learned weight for each
language, and each pair of languages a learned transition. Forward-backward over the whole text gives each word's
distribution; a document's is the mean over its words, and the likeliest language is predicted.

Training takes TRAIN_DOCS labelled documents in expectation (for each language the ids with the least hashes) and the whole
text of each, in runs of RUN words. Sequences are spliced from runs of documents of different languages, so that the
transitions learn how text switches; steps are Adagrad on the likelihood.

Forward-backward treats a batch of texts as one chain in which a text's first word forgets what came before. The chain
is cut in blocks: the product of a block's matrices carries messages over it, so the work is in vectors over all blocks
and the longest text costs no more steps than many short ones. The result is exact.

Edge cases: null texts and texts without a letter are `und` with score 0, and so is everything if no training row has a
language; repeated rows are predicted each; null ids are never trained on and not held out; words of bytes that no
training word had are decided by their neighbours; an empty table gives an empty result. Other columns pass through
`keep_identified` (code-switched text is kept: each word may have a language of its own) and are ignored by `identify`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text
from .shared import same_columns, unused

TRAIN_DOCS = 1000
RUN = 12
LENGTH = 48
EPOCHS = 3
TABLE_BITS = 17
BLOCK = 256
UNKNOWN = "und"
#: A document is rejected if its words have less than this for their likeliest languages, each word its own, on average.
KEEP_FROM = 0.5

_U = np.uint64
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SALT = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 16, dtype=_U) | _U(1)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before it."""
    inside = np.concatenate((_LETTER[data], [False]))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def _lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 with A-Z and the capitals of Latin-1 in lower case."""
    out = data.copy()
    out[(data >= 65) & (data < 91)] += 32
    latin = np.zeros(len(data), dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[latin] += 32
    return out


def _slot(h: np.ndarray) -> np.ndarray:
    return (text.mix(h) >> _U(64 - TABLE_BITS)).astype(np.int64)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all features of all words, and the bounds of each word's slots. `data` is in lower case."""
    size = ends - starts
    # The words one after another, each with a 0 byte before and after.
    bounds = np.concatenate(([0], np.cumsum(size + 2)))
    flat = np.zeros(int(bounds[-1]) + 4, dtype=_U)
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    flat[bounds[word] + 1 + at] = data[starts[word] + at]
    place = np.arange(int(bounds[-1]))
    owner = np.repeat(np.arange(len(size)), size + 2)
    last = bounds[1:][owner]
    slots, owners = [], []
    gram = flat[:-4] * _SALT[0]
    for n in (2, 3, 4):
        gram = gram * _U(0x100000001B3) + flat[n - 1 : len(flat) - 4 + n - 1]
        fits = place + n <= last
        slots.append(_slot(gram[fits] + _SALT[n]))
        owners.append(owner[fits])
    head = tail = np.zeros(len(size), dtype=_U)
    for n in (1, 2, 3):
        fits = size >= n
        near = np.minimum(n - 1, size - 1)
        head = head * _U(0x100000001B3) + data[starts + near]
        tail = tail * _U(0x100000001B3) + data[ends - 1 - near]
        for h, salt in ((head, 4 + n), (tail, 8 + n)):
            slots.append(_slot(h[fits] + _SALT[salt]))
            owners.append(np.flatnonzero(fits))
    slots.append(_slot(text.span_hashes(data, starts, ends) + _SALT[12]))
    owners.append(np.arange(len(size)))
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return slots[order], np.searchsorted(owners[order], np.arange(len(size) + 1))


def _emissions(data, starts, ends, table: np.ndarray) -> np.ndarray:
    """Scores (words, languages); each distinct word is looked at once."""
    _, first, back = np.unique(text.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    slots, bounds = word_features(data, starts[first], ends[first])
    return np.add.reduceat(table[slots], bounds[:-1], axis=0)[back] if len(first) else np.zeros((0, table.shape[1]))


def forward_backward(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of a chain of words. scores: (n, k) log potentials; first: where a sequence begins; transition (k, k)
    and start (k): log potentials."""
    before, after = passes(scores, first, transition, start)
    gamma = before * after
    return gamma / gamma.sum(axis=1, keepdims=True)


def pair_marginals(before: np.ndarray, after: np.ndarray, potentials: np.ndarray, transition: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For words `at`, none the first of its sequence: the probabilities of the labels of the word before and of the word, from
    the pass that ends before it, the transition, the word's own potentials and the pass that begins after it."""
    own = np.exp(potentials[at] - potentials[at].max(axis=1, keepdims=True)) * after[at]
    pair = before[at - 1][:, :, None] * np.exp(transition - transition.max())[None] * own[:, None, :]
    return pair / pair.sum(axis=(1, 2), keepdims=True)


def passes(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward pass up to each word, its own potentials included, and the backward pass from the words after it, each
    row up to a factor."""
    n, k = scores.shape
    if not n:
        return scores, scores
    blocks = -(-n // BLOCK)
    p = np.zeros((blocks * BLOCK, k))
    p[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    p[n:] = 1
    f = np.zeros(blocks * BLOCK, dtype=bool)
    f[:n] = first
    f[n:] = True
    p, f = p.reshape(blocks, BLOCK, k), f.reshape(blocks, BLOCK)
    a, s = np.exp(transition - transition.max()), np.exp(start - start.max())
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(BLOCK):
        product = np.where(f[:, t, None, None], product.sum(axis=2, keepdims=True) * s, product @ a) * p[:, t, None, :]
        product /= product.sum(axis=(1, 2), keepdims=True)
    into, out = np.zeros((blocks, k)), np.zeros((blocks, k))
    v = np.full(k, 1 / k)
    for b in range(blocks):
        into[b] = v
        v = v @ product[b]
        v /= v.sum()
    v = np.full(k, 1 / k)
    for b in range(blocks - 1, -1, -1):
        out[b] = v
        v = product[b] @ v
        v /= v.sum()
    alpha = np.zeros_like(p)
    v = into
    for t in range(BLOCK):
        v = np.where(f[:, t, None], v.sum(axis=1, keepdims=True) * s, v @ a) * p[:, t]
        v = v / v.sum(axis=1, keepdims=True)
        alpha[:, t] = v
    beta = np.zeros_like(p)
    v = out
    for t in range(BLOCK - 1, -1, -1):
        beta[:, t] = v
        v = v * p[:, t]
        v = np.where(f[:, t, None], (v * s).sum(axis=1, keepdims=True), v @ a.T)
        v = v / v.sum(axis=1, keepdims=True)
    return alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]


def gradients(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log likelihood of the labels: by the scores, the transitions and the starts. What is seen less what is expected."""
    before, after = passes(scores, first, transition, start)
    gamma = before * after
    delta = -gamma / gamma.sum(axis=1, keepdims=True)
    delta[np.arange(len(label)), label] += 1
    follow = np.flatnonzero(~first)
    d_transition = -pair_marginals(before, after, scores, transition, follow).sum(axis=0)
    np.add.at(d_transition, (label[follow - 1], label[follow]), 1)
    return delta, d_transition, delta[first].sum(axis=0)


class LanguageModel:
    """Learned weights: `languages`, a table (slots, languages), transitions and starts."""

    def __init__(self, languages: list[str], table: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.languages, self.table, self.transition, self.start = languages, table, transition, start

    def words(self, column: pa.Array):
        """For each slice of texts: (spans' starts, ends, words before each text, marginals)."""
        data, offsets = text.as_bytes(column)
        for i, j in text.slices(offsets):
            part = _lower(data[offsets[i] : offsets[j]])
            starts, ends, counts = _spans(part, offsets[i : j + 1] - offsets[i])
            first = np.zeros(len(starts), dtype=bool)
            first[counts[:-1][counts[:-1] < counts[1:]]] = True
            yield starts, ends, counts, forward_backward(_emissions(part, starts, ends, self.table), first, self.transition, self.start)

    def documents(self, column: pa.Array) -> tuple[list[str], list[float], list[float]]:
        """Of each text: the language, its share of the words, and how sure its words are of their languages on average."""
        names, scores, sure = [], [], []
        if not self.languages:
            return [UNKNOWN] * len(column), [0.0] * len(column), [0.0] * len(column)
        for _, _, counts, gamma in self.words(column):
            total = np.concatenate((np.zeros((1, gamma.shape[1])), np.cumsum(gamma, axis=0)))
            most = np.concatenate(([0.0], np.cumsum(gamma.max(axis=1))))
            n = np.maximum(np.diff(counts), 1)
            mean = (total[counts[1:]] - total[counts[:-1]]) / n[:, None]
            best = mean.argmax(axis=1)
            for k, b, m, c in zip(np.diff(counts), best, mean, (most[counts[1:]] - most[counts[:-1]]) / n, strict=True):
                at = len(names)
                lettered = k > 0 and _has_letter(column, at)
                names.append(self.languages[b] if lettered else UNKNOWN)
                scores.append(float(min(1.0, m[b])) if lettered else 0.0)
                sure.append(float(min(1.0, c)) if lettered else 0.0)
        return names, scores, sure


def _has_letter(column: pa.Array, at: int) -> bool:
    """Only texts without an ASCII letter are read character by character."""
    raw = column[at].as_buffer()
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return bool(((data | 32) >= 97).any() and (_LETTER[:128][data[data < 128]].any() or any(c.isalpha() for c in column[at].as_py())))


def _train(rows: list[tuple[str, bytes]], seed: int = 7) -> LanguageModel:
    """rows: (language, a run of words, in lower case and separated by spaces)."""
    languages = sorted({x for x, _ in rows})
    k = len(languages)
    table, transition, start = np.zeros((1 << TABLE_BITS, k)), np.zeros((k, k)), np.zeros(k)
    if not rows:
        return LanguageModel([], table, transition, start)
    data = np.frombuffer(b" ".join(x for _, x in rows) + b" ", dtype=np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(x) + 1 for _, x in rows])))
    starts, ends, counts = _spans(data, bounds)
    _, first, word = np.unique(text.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    slots, at = word_features(data, starts[first], ends[first])
    label = np.repeat([languages.index(x) for x, _ in rows], np.diff(counts))
    rng = np.random.Generator(np.random.PCG64(seed))
    g_table, g_transition, g_start = np.full_like(table, 1e-6), np.full_like(transition, 1e-6), np.full_like(start, 1e-6)
    runs = [(a, b) for a, b in zip(counts[:-1], counts[1:], strict=True) if b > a]
    for epoch in range(EPOCHS):
        order = np.concatenate([np.arange(*runs[i]) for i in rng.permutation(len(runs))])
        for i in range(0, len(order), 64 * LENGTH):
            own = order[i : i + 64 * LENGTH]
            y, w = label[own], word[own]
            new = np.arange(len(own)) % LENGTH == 0
            kinds, back = np.unique(w, return_inverse=True)
            spans = [np.arange(at[x], at[x + 1]) for x in kinds]
            used, width = slots[np.concatenate(spans)], np.array([len(x) for x in spans])
            edge = np.concatenate(([0], np.cumsum(width)[:-1]))
            scores = np.add.reduceat(table[used], edge, axis=0)[back]
            delta, d_transition, d_start = gradients(scores, new, transition, start, y)
            by_kind = np.zeros((len(kinds), k))
            np.add.at(by_kind, back, delta)
            lanes, inverse = np.unique(used, return_inverse=True)
            d_table = np.stack([np.bincount(inverse, weights=np.repeat(by_kind[:, c], width), minlength=len(lanes)) for c in range(k)], axis=1)
            for value, grad, past, pick in ((table, d_table, g_table, lanes), (transition, d_transition, g_transition, slice(None)), (start, d_start, g_start, slice(None))):
                grad = grad / 64
                past[pick] += grad * grad
                value[pick] += 0.1 * grad / np.sqrt(past[pick]) - 1e-5 * value[pick]
    return LanguageModel(languages, table.astype(np.float32), transition, start)


def _held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit_language(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Learns from text and lang of the documents that are not held out."""
    pool = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).select("doc_id", "lang", "text")
    per = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text"), 0.02).alias("n")).collect()}  # one row a language
    if not per:
        return _train([])
    quota, parts = max(1, train_docs // len(per)), 1_000_000
    rates = F.create_map(*[F.lit(x) for lang, n in per.items() for x in (lang, min(parts, 10 + int(1.1 * quota * parts / n)))])

    @text.tidy
    def runs(batches):
        for batch in batches:
            out = []
            for lang, x in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                data = _lower(np.frombuffer(x.encode(), dtype=np.uint8))
                starts, ends, _ = _spans(data, np.array([0, len(data)]))
                for a in range(0, len(starts), RUN):
                    out.append((lang, b" ".join(data[s:e].tobytes() for s, e in zip(starts[a : a + RUN], ends[a : a + RUN], strict=True))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out]), pa.array([b for _, b in out], pa.binary())], ["lang", "run"])

    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    chosen = pool.where(draw < F.element_at(rates, F.col("lang"))).withColumn("draw", draw).dropDuplicates(["lang", "doc_id", "draw"])
    least = Window.partitionBy("lang").orderBy("draw", "doc_id")  # a little more than `quota` rows a language
    chosen = chosen.withColumn("place", F.row_number().over(least)).where(F.col("place") <= quota).select("lang", "text")
    rows = chosen.mapInArrow(runs, "lang string, run binary").collect()  # the texts of train_docs documents at most
    return _train(sorted((r["lang"], bytes(r["run"])) for r in rows))


def _labels(spark, model: LanguageModel):
    """A function of a column of texts: struct of language, score and sureness. Only texts go to Python and only labels come
    back; the model is sent once to each executor."""
    shipped = spark.sparkContext.broadcast((model.languages, model.table, model.transition, model.start))

    @F.arrow_udf("name string, score double, sure double")
    def label(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = LanguageModel(*shipped.value)
        try:
            for column in columns:
                names, scores, sure = known.documents(column)
                yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.float64())], ["name", "score", "sure"])
        finally:
            text.release()

    return label.asNondeterministic()  # else a filter on the label makes the planner label twice


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang -> doc_id, held_out, lang_pred, score."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    label = _labels(docs.sparkSession, fit_language(docs))
    return docs.select("doc_id", label("text").alias("x")).select("doc_id", _held_out().alias("held_out"), F.col("x.name").alias("lang_pred"), F.col("x.score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose words are in learned languages, one or several, with their columns; without a labelled row to
    learn from, all that have a letter."""
    model = fit_language(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    (own,) = unused(docs, "_label")
    rows = docs.withColumn(own, _labels(docs.sparkSession, model)(F.col("text").cast("string")))
    return rows.where((F.col(own)["name"] != UNKNOWN) & (F.col(own)["sure"] >= KEEP_FROM)).select(*same_columns(docs))


def op7(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
