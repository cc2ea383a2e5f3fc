"""Operator 13: alignment of two tokenizers' tokens over the same texts, and how often their ids are linked.

A text's tokens by A (byte-level BPE) and B (pieces with byte fallback) spell the same bytes. Byte offsets where a token
of each ends are shared cuts; they divide both sequences into groups, and each A token is linked with each B token of its
group. `align` finds the groups by divide and conquer: of an interval it takes a shared cut near the middle, found by
bisecting one tokenizer's ends for those of the other from the middle outwards, and does the same with both halves; an
interval without a cut is a leaf, a group. Intervals of one level are halved together, in vectors.

The first division needs no search: neither tokenizer has a token that spans the place between a character that is no
white space and a space, so both end there. Texts are divided at these places into runs, equal runs are encoded and
aligned once for as long as a task keeps them, and documents are put together from their runs.

Documents that hold a pair are counted over blocks: a task writes for each block of its documents the distinct linked
pairs with their numbers of documents, and for each document which of the block's pairs it holds how often. Pairs of all
blocks are summed, the highest count of each A id is taken, and every block gets the counts of its own pairs back. No
table of pairs is broadcast or collected; what is shuffled is a row for each block and pair, not one for each link.

Edge cases: null and empty texts, and those that one tokenizer does not spell byte for byte (U+2581 is a space to B),
have no tokens: zeros and an empty column. Repeated rows count as documents of their own; a null doc_id is kept; an
empty table gives an empty result. Long texts without spaces are one run, aligned like any other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text, tokens
from .shared import Tables

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text in a block of documents, and in what is encoded at once.
BLOCK_CHARS, GROUP_CHARS = 16_000_000, 1_000_000
#: Runs a task keeps at most, and how long a kept run may be.
TABLE_ROWS, KEPT_CHARS = 400_000, 60
# A space and what follows, up to a space that comes after neither white space nor U+2581 (in which B's tokens may go on)
# and is not the last character (of a text of one space B makes nothing).
_RUN = re.compile(r" [^ ]*(?:(?:(?<=[\s▁]) | \Z)[^ ]*)*")


def _probe(few: np.ndarray, many: np.ndarray, f0: np.ndarray, f1: np.ndarray, steps: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """For intervals of the ends `few`: the index of a shared cut near the middle in `few` and in `many`, or -1."""
    at_few, at_many = np.full(len(f0), -1), np.full(len(f0), -1)
    middle, open_ = (f0 + f1 - 2) // 2, np.flatnonzero(f1 - f0 > 1)
    for step in range(steps):
        if not len(open_):
            break
        i = middle[open_] + (step + 1) // 2 * (1 if step % 2 else -1)
        inside = (i >= f0[open_]) & (i < f1[open_] - 1)
        i = np.where(inside, i, f0[open_])
        j = np.searchsorted(many, few[i])
        hit = inside & (many[j] == few[i])
        at_few[open_[hit]], at_many[open_[hit]] = i[hit], j[hit]
        open_ = open_[~hit & (f1[open_] - f0[open_] - 1 > step + 1)]
    for k in open_.tolist():  # none within `steps` of the middle: look at the whole interval
        i = np.arange(f0[k], f1[k] - 1)
        j = np.searchsorted(many, few[i])
        shared = np.flatnonzero(many[j] == few[i])
        if len(shared):
            best = shared[np.argmin(np.abs(i[shared] - middle[k]))]
            at_few[k], at_many[k] = i[best], j[best]
    return at_few, at_many


def align(ends_a: np.ndarray, ends_b: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending byte offsets where the tokens of a text end, and ascending offsets that are known as shared cuts, the
    text's end among them -> for each group, in order, the number of A tokens and of B tokens up to its end.

    All intervals of a level are halved at once; the shorter side is walked, the other bisected.
    """
    a1, b1 = np.searchsorted(ends_a, known) + 1, np.searchsorted(ends_b, known) + 1
    a0, b0 = np.concatenate(([0], a1[:-1])), np.concatenate(([0], b1[:-1]))
    leaves = []
    while len(a1):
        cut_a, cut_b = np.full(len(a1), -1), np.full(len(a1), -1)
        swap = a1 - a0 > b1 - b0
        for side, few, many, f0, f1, to_few, to_many in ((~swap, ends_a, ends_b, a0, a1, cut_a, cut_b), (swap, ends_b, ends_a, b0, b1, cut_b, cut_a)):
            to_few[side], to_many[side] = _probe(few, many, f0[side], f1[side])
        leaf = cut_a < 0
        leaves.append(np.stack([a1[leaf], b1[leaf]], axis=1))
        a0, a1, b0, b1, cut_a, cut_b = (x[~leaf] for x in (a0, a1, b0, b1, cut_a + 1, cut_b + 1))
        a0, a1, b0, b1 = (np.concatenate(x) for x in ((a0, cut_a), (cut_a, a1), (b0, cut_b), (cut_b, b1)))
    ends = np.concatenate(leaves)
    ends = ends[np.argsort(ends[:, 0])]
    return ends[:, 0], ends[:, 1]


def token_bytes(entries: list[str], byte_level: bool) -> list[bytes]:
    """The bytes that each entry of a vocabulary spells."""
    if byte_level:  # a printable character stands for its own byte, the characters from U+0100 on for the other bytes in order
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        of = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        return [bytes(of[c] for c in x) if all(c in of for c in x) else x.encode() for x in entries]
    return [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in entries]


def _tokenizers(path_a: str, path_b: str) -> types.SimpleNamespace:
    """Both, loaded once in the life of a worker process."""
    home = sys.modules.setdefault("matchlake_worker_state", types.ModuleType("matchlake_worker_state"))
    name = f"{path_a}|{path_b}"
    if name not in home.__dict__:
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        a.encode_special_tokens = True
        entries = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        bytes_a, bytes_b = token_bytes(entries, True), token_bytes(pieces, False)
        # an id and what follows it: within A, after A, within B, after B
        said = [f"{i}{c}" for n, c in ((len(bytes_a), ","), (len(bytes_a), "|"), (len(bytes_b), ","), (len(bytes_b), ";")) for i in range(n)]
        home.__dict__[name] = types.SimpleNamespace(
            a=a, b=b, bytes_a=bytes_a, bytes_b=bytes_b, said=said, length=np.array([len(x) for x in said]),
            size_a=np.array([len(x) for x in bytes_a]), size_b=np.array([len(x) for x in bytes_b]), whole=any("▁" in p.lstrip("▁") for p in pieces),
        )
    return home.__dict__[name]


def _spelt(ids: list[int], table: list[bytes], raw: bytes) -> bool:
    return b"".join(map(table.__getitem__, ids)) == raw


def _encoded(state, runs: list[str]) -> tuple[list[str], list[int], list[int], list[str]]:
    """Runs that both spell, their ids one after another, and the runs that one does not spell. Runs begin with a space,
    which B adds by itself; those that end in neither white space nor U+2581 part again where they are joined."""
    plain = [r for r in runs if not (r[-1].isspace() or "▁" in r)]
    both = "".join(plain)
    a, b = state.a.encode(both, add_special_tokens=False).ids, state.b.encode(both[1:]) if both else []
    if not (_spelt(a, state.bytes_a, both.encode()) and _spelt(b, state.bytes_b, both.encode())):
        plain, a, b = [], [], []
    good, bad, known = list(plain), [], set(plain)
    for run in runs:
        if run not in known:
            own_a, own_b = state.a.encode(run, add_special_tokens=False).ids, state.b.encode(run[1:])
            if _spelt(own_a, state.bytes_a, run.encode()) and _spelt(own_b, state.bytes_b, run.encode()):
                good.append(run)
                a, b = a + own_a, b + own_b
            else:
                bad.append(run)
    return good, a, b, bad


#: Links of a group up to which they are listed one by one; beyond, distinct ids are multiplied.
LISTED = 4096


def _pairs(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs of ids as (group, a * size + b, times); pairs of a group may be repeated."""
    na, nb = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
    listed = na * nb <= LISTED
    of = np.repeat(np.arange(len(ga)), na)
    tokens_a = np.flatnonzero(listed[of])
    each = nb[of[tokens_a]]
    within = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    group = np.repeat(of[tokens_a], each)
    out = [(group, np.repeat(a[tokens_a], each) * size + b[(gb - nb)[group] + within], np.ones(len(group), np.int64))]
    for g in np.flatnonzero(~listed).tolist():
        (x, n), (y, m) = (np.unique(z, return_counts=True) for z in (a[ga[g] - na[g] : ga[g]], b[gb[g] - nb[g] : gb[g]]))
        out.append((np.full(len(x) * len(y), g), (x[:, None] * size + y).ravel(), (n[:, None] * m).ravel()))
    group, pair, times = (np.concatenate(c) for c in zip(*out, strict=True))
    if len(out) > 1:
        order = np.argsort(group, kind="stable")
        group, pair, times = group[order], pair[order], times[order]
    return group, pair, times


class _Runs:
    """Aligned runs of a task: counts, groups as text, and linked id pairs (a * size of B's vocabulary + b)."""

    def __init__(self, state):
        self.state, self.size = state, len(state.bytes_b)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.texts: list[str] = []
        self.facts = [np.zeros((0, 6), np.int64)]  # n_a, n_b, n_groups, n_links, number of pairs, spelt
        self.pairs, self.times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, runs: list[str]) -> None:
        if not runs:
            return
        state = self.state
        good, a, b, bad = _encoded(state, runs)
        self.at.update(zip(good + bad, range(len(self.texts), len(self.texts) + len(runs)), strict=True))
        if good:
            a, b = np.array(a), np.array(b)
            known = np.cumsum([len(r.encode()) for r in good])
            ends_a = np.cumsum(state.size_a[a])
            ga, gb = align(ends_a, np.cumsum(state.size_b[b]), known)
            run_a = np.searchsorted(ends_a, known) + 1
            run_g = np.searchsorted(ga, run_a) + 1  # groups up to the end of each run
            # the tokens of A and of B, group by group
            na, nb = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
            of_a, of_b = np.repeat(np.arange(len(ga)), na), np.repeat(np.arange(len(gb)), nb)
            place_a, place_b = np.arange(len(a)) + (gb - nb)[of_a], np.arange(len(b)) + ga[of_b]
            code = np.empty(len(a) + len(b), np.int64)
            last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            last_a[ga - 1] = last_b[gb - 1] = 1
            code[place_a] = a + last_a * len(state.bytes_a)
            code[place_b] = 2 * len(state.bytes_a) + b + last_b * self.size
            ends = np.cumsum(state.length[code])[gb[run_g - 1] + run_a - 1].tolist()
            said = "".join(map(state.said.__getitem__, code.tolist()))
            self.texts += [said[i : j - 1] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
            group, pairs, times = _pairs(a, b, ga, gb, self.size)
            runs_of = np.repeat(np.arange(len(good)), np.diff(run_g, prepend=0))
            links = np.bincount(runs_of, na * nb, len(good)).astype(np.int64)
            self.facts.append(np.stack([np.diff(run_a, prepend=0), np.diff(gb[run_g - 1], prepend=0), np.diff(run_g, prepend=0), links, np.bincount(runs_of[group], minlength=len(good)), np.ones(len(good), np.int64)], axis=1))
            self.pairs.append(pairs)
            self.times.append(times)
        self.texts += [""] * len(bad)
        self.facts.append(np.zeros((len(bad), 6), np.int64))

    def tables(self):
        for name in ("facts", "pairs", "times"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        return self.facts[0], self.pairs[0], self.times[0]


def _aligned(runs: _Runs, texts: list[str]):
    """For texts: facts of each, the groups' digest of each, and (text, pair, times) with each pair once a text."""
    split = [([" " + x] if runs.state.whole else _RUN.findall(" " + x)) if x else [] for x in texts]
    if len(runs.at) > TABLE_ROWS:
        runs.clear()
    runs.add(list(dict.fromkeys(r for r in chain.from_iterable(split) if r not in runs.at)))
    facts, pairs, times = runs.tables()
    at = [list(map(runs.at.__getitem__, s)) for s in split]
    number = np.array([len(x) for x in at])
    flat = np.fromiter(chain.from_iterable(at), np.int64, int(number.sum()))
    doc = np.repeat(np.arange(len(texts)), number)
    sums = np.stack([np.bincount(doc, facts[flat, k], len(texts)) for k in range(6)], axis=1).astype(np.int64)
    spelt = (sums[:, 5] == number) & (number > 0)
    sums[~spelt] = 0
    said = [hashlib.sha256(";".join(map(runs.texts.__getitem__, x)).encode()).hexdigest() if ok else "" for x, ok in zip(at, spelt, strict=True)]
    doc, flat = doc[spelt[doc]], flat[spelt[doc]]
    first = np.concatenate(([0], np.cumsum(facts[:, 4])))
    each = facts[flat, 4]
    place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[flat], each)
    span = runs.size * len(runs.state.bytes_a)
    key = np.repeat(doc, each) * span + pairs[place]
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(times[place][order], heads) if len(key) else np.zeros(0, np.int64)
    key = key[heads]
    for long in [r for r in dict.fromkeys(chain.from_iterable(split)) if len(r) > KEPT_CHARS]:
        runs.at.pop(long, None)  # looked up no more; what it spells goes when the table is begun anew
    return sums, said, key // span, key % span, total


_ROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("which", pa.binary()), ("times", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])
_DDL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, which binary, times binary, a int, b int, docs long"


def _blocks(path_a: str, path_b: str):
    @text.tidy
    def work(batches):
        runs = _Runs(_tokenizers(path_a, path_b))
        task, block = TaskContext.get().partitionId(), 0
        docs, held, chars = [], [], 0

        def group(ids, texts):
            sums, said, doc, pair, times = _aligned(runs, texts)
            docs.extend(zip(ids, sums, said, np.bincount(doc, minlength=len(texts)).tolist(), strict=True))
            held.append((pair, times))

        def written():
            pair, times = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            own, which, number = np.unique(pair, return_inverse=True, return_counts=True)
            which, times, at = which.astype("<u4").ravel(), times.astype("<i8"), 0
            name = task << 32 | block
            rows = []
            for i, sums, said, n in docs:
                rows.append({"block": name, "doc_id": i, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums[:4].tolist(), strict=True)), "groups_sha256": said, "which": which[at : at + n].tobytes(), "times": times[at : at + n].tobytes()})
                at += n
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, _ROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ROW)
            for k in range(0, len(own), 50_000):
                part = slice(k, k + 50_000)
                columns = {"block": np.full(len(own[part]), name), "a": (own[part] // runs.size).astype(np.int32), "b": (own[part] % runs.size).astype(np.int32), "docs": number[part]}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(own[part]), f.type) for f in _ROW], schema=_ROW)

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(x or "")
                size += len(texts[-1])
                if size >= GROUP_CHARS:
                    group(ids, texts)
                    chars, ids, texts, size = chars + size, [], [], 0
                    if chars >= BLOCK_CHARS:
                        yield from written()
                        docs, held, chars, block = [], [], 0, block + 1
        if texts:
            group(ids, texts)
        if docs:
            yield from written()

    return work


_OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _counted(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents, with what the counts of its pairs, in the order of (a, b), make of their links."""
    pairs = pairs.sort_by([("a", "ascending"), ("b", "ascending")])
    count, best = (pairs.column(c).to_numpy() for c in ("count", "is_best"))
    n_best, total = [], []
    for which, times in zip(docs.column("which").to_pylist(), docs.column("times").to_pylist(), strict=True):
        which, times = np.frombuffer(which, "<u4"), np.frombuffer(times, "<i8")
        n_best.append(int(times[best[which]].sum()) if len(which) else 0)
        total.append(int((times * count[which]).sum()) if len(which) else 0)
    made = {"n_best": n_best, "count_sum": total}
    return pa.table([pa.array(made[f.name], f.type) if f.name in made else docs.column(f.name) for f in _OUT], schema=_OUT)


def aligned(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id (integer), text -> the documents with their numbers of tokens, groups and links, how many of their links have
    the highest count of their A id, the sum of their links' counts and a digest of their groups; and the table of pairs:
    a, b, count (documents that hold the pair linked), is_best."""
    t = Tables(docs.sparkSession, "align")
    work = _blocks(tokens.path_of(byte_bpe, folder), tokens.path_of(pieces, folder))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = t.put(texts.mapInArrow(work, _DDL), "blocks")
    held = rows.where("a IS NOT NULL").select("block", "a", "b", "docs")
    counts = held.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    # an A id has at most as many pairs as B has entries
    counts = t.put(counts.withColumn("is_best", F.col("count") == F.max("count").over(Window.partitionBy("a"))), "counts")
    back = held.select(F.col("block").alias("of"), "a", "b").join(counts, ["a", "b"])
    found = rows.where("a IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "which", "times").groupBy("block").cogroup(back.groupBy("of"))
    return found.applyInArrow(_counted, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), counts


def op13(spark, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))[0]
