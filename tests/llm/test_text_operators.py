"""Operators on documents against brute force, with the odd rows that each must stand."""

import collections
import functools
import hashlib
import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchlake.llm import fingerprints, language, minhash, mixing, packing, quality, rollup, text, tokens
from matchlake.llm.shared import new_path
from tests.compare import duck_rows, spark_rows

WORDS = "the of and lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor".split()
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, token string, label int, evidence double"


def prose(k, n=40):
    rng = np.random.default_rng(k)
    return " ".join(f"{rng.choice(WORDS)}{rng.integers(30)}" for _ in range(n))


def odd_rows():
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    rows = [
        (0, base, "en", "a"), (1, base.upper().replace(" ", "\n"), "en", "a"), (2, " ".join(near), "en", None), (3, None, "en", "a"), (4, "", None, "b"), (5, " \t\n", "en", "b"), (6, "one two", "en", "b"),
        (7, "One  TWO", "en", "b"), (8, LONG, "en", "a"), (9, "—— 123 !!", None, None), (10, "é ß ẞ İ <|endoftext|>\x0b x y", "fr", "b"), (6, "one two", "en", "b"), (None, prose(9), None, "a"), (None, None, None, None),
        *[(20 + k, prose(100 + k), "en" if k % 2 else "de", f"s{k % 3}") for k in range(12)],
    ]
    return [(*r, len(r[1] or ""), 1, "t", 2, 0.5) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(x):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def shingles(x):
    w = words(x)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_shingle_sets_have_the_sizes_of_the_plain_sets():
    texts = [r[1] for r in odd_rows()]
    got = list(text.shingle_sets(pa.array(texts, pa.string())))
    assert [len(g) for g in got] == [len(shingles(x)) for x in texts]
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        assert len(np.intersect1d(got[i], got[j])) == len(shingles(a) & shingles(b)), (i, j)


# ---- 5


def brute_components(rows):
    """By full sets; rows of one id are one document."""
    sets, up = {}, {}
    for i, x in rows:
        if i is not None:
            sets.setdefault(i, shingles(x))
            up[i] = i

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_of_odd_rows(odd, none):
    want = brute_components([(r[0], r[1]) for r in odd_rows()])
    for exact in (False, True):
        got = minhash.near_duplicates(odd, exact).collect()
        assert len(got) == odd.count()
        assert all((r.n_shingles, r.component_id, r.kept) == want[r.doc_id] for r in got if r.doc_id is not None)
        assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
        assert minhash.near_duplicates(none, exact).count() == 0


def cloud_rows() -> list[tuple[int, str]]:
    """Copies with up to a third of their words changed, chains of copies, and unlike texts around one passage."""
    rng = np.random.default_rng(5)
    centre, passage, rows = prose(3, 120).split(), prose(4, 60), []
    for k in range(90):
        w = list(centre)
        for i in rng.integers(0, len(w), rng.integers(0, 9)):
            w[i] = f"x{k}y{i}"
        rows.append((k, " ".join(w)))
    chain = prose(6, 200).split()
    for k in range(30):
        chain[6 * k] = f"c{k}"
        rows.append((1000 - k, " ".join(chain)))
    return rows + [(2000 + k, f"{passage} {prose(500 + k, int(rng.integers(1, 60)))}") for k in range(60)]


def near(df, exact=False):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, exact).collect()}


@pytest.mark.parametrize("exact", [False, True])
def test_near_duplicates_of_a_cloud_and_a_shared_passage(spark, exact):
    rows = cloud_rows()
    assert near(spark.createDataFrame(rows, "doc_id long, text string"), exact) == brute_components(rows)


def test_exact_near_duplicates_need_no_collisions(spark, monkeypatch):
    """Where signatures are asked for more than links must have, the exact way still finds links at the very threshold."""
    monkeypatch.setattr(minhash, "MATCHES", minhash.COORDINATES)
    rows = []
    for k in range(12):
        words = prose(700 + k, 8 + 4 * k).split()[: 7 + 4 * k]  # 3 + 4k shingles
        n = len(words) - 4
        more = [f"y{k}{i}" for i in range(n // 3)]  # n of n + n // 3 shingles
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + more))]
    want = brute_components(rows)
    assert sum(kept for _, _, kept in want.values()) == 12
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df) != want and near(df, True) == want


def test_near_duplicates_of_the_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert near(spark.read.parquet(f"{data}/documents.parquet"), True) == brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op5(spark, data).collect()}
    assert got == brute_components(rows)


# ---- 4


def test_fingerprints(spark, odd, none):
    rows = [r for r in odd.select("doc_id", "text").collect()]
    order = sorted(((-(1 << 63) if r.doc_id is None else r.doc_id, r.text or "") for r in rows), key=lambda r: (-r[0], r[1]))
    got = fingerprints.edited_likeness(odd, parts=4).collect()
    seen = collections.Counter((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got)
    want = collections.Counter()
    for k, (i, x) in enumerate(order):
        y, n = order[(k + 1) % len(order)][1], len(x)
        want[i, n, hashlib.sha256((x[: n - n // 2] + y[: n // 2]).encode()).hexdigest()] += 1
    assert seen == want
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].fingerprint == by[1].fingerprint != by[2].fingerprint and by[3].fingerprint == ""
    assert by[1].near_next == 1.0 and 0.7 < by[2].near_next < 1  # exact: the sets are small
    assert by[2].near_next == len(shingles(odd_rows()[2][1]) & shingles(odd_rows()[1][1])) / len(shingles(odd_rows()[2][1]) | shingles(odd_rows()[1][1]))
    assert fingerprints.edited_likeness(none).count() == 0


def test_fingerprints_of_the_table(spark, data):
    """The query against plain sets of shingles: exact for short texts, within the sketch's error for long ones."""
    import hashlib

    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.op4(spark, data).collect()}
    assert len(got) == len(docs)
    shingles = lambda x: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(words(x))
    for i, (doc, x) in enumerate(docs):
        y = docs[(i + 1) % len(docs)][1]
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        r = got[doc]
        assert r.n_chars == len(x) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (y, r.near_next)):
            a, b = shingles(x), shingles(other)
            want = len(a & b) / len(a | b) if a and b else float(not a and not b)
            assert near == pytest.approx(want, abs=1e-12 if len(a | b) <= fingerprints.K else 0.15)


def test_sketches_estimate_and_merge(spark):
    sets = [np.unique(text.mix(np.arange(a, b, dtype=np.uint64))) for a, b in ((0, 6000), (3000, 9000), (0, 3000))]
    a, b, c = map(fingerprints.sketch, sets)
    assert abs(fingerprints.resemblance(a, b) - 1 / 3) < 0.1 and abs(fingerprints.containment(c, a) - 1) < 0.15 and abs(fingerprints.distinct(a) - 6000) < 1200
    assert np.array_equal(fingerprints.merge([a, b]), fingerprints.sketch(np.union1d(sets[0], sets[1])))
    assert np.array_equal(fingerprints.from_text(fingerprints.to_text(a)), a)
    rows = spark.createDataFrame([("g", "a b c d e f"), ("g", "q r s t u"), ("h", None)], "g string, text string").withColumn("fingerprint", fingerprints.fingerprint("text"))
    got = {r.g: r.n for r in fingerprints.merge_fingerprints(rows, "g").withColumn("n", fingerprints.distinct_of("fingerprint")).collect()}
    assert got == {"g": 3.0, "h": 0.0}


# ---- 8


def test_mix_is_the_sql(spark, data):
    assert spark_rows(mixing.op8(spark, data)) == duck_rows(mixing.OP8_SQL, data)


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == odd.count() and none.transform(mixing.mix_sources).count() == 0
    assert all(0 <= r.taken <= 2 * r.size for r in rows) and collections.Counter(r.size for r in rows) == collections.Counter(len(words(r[1])) for r in odd_rows())
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in rows)
    again = mixing.mix_sources(odd.orderBy("text")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_of_repeated_rows_and_null_ids(spark):
    """A hot null id and a hot id meet their targets, and inclusion odds differ within a source."""
    for rows in ([(None, "a b c d e f g h i j", "x")] * 1000, [(7, "a b c d e f g h i j k l m n o", "x")] * 900, [(i, "w " * (1 + i % 50), "x") for i in range(2000)]):
        got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert len(got) == len(rows) and abs(sum(r.taken for r in got) - got[0].target) <= max(r.size for r in got)
    copies = collections.defaultdict(list)
    for r in got:
        copies[r.size > 20].append(r.copies)
    assert np.mean(copies[True]) > np.mean(copies[False]) + 0.05


def test_targets_stop_and_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 0 and got["b"] + got["c"] == pytest.approx(1.5 * 2010 - 20)
    assert got["b"] == pytest.approx((1.5 * 2010 - 20) / 3) and got["c"] == pytest.approx(2 * got["b"])


# ---- 9 and 1


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.path_of(tokens.WORD_BPE))


def whole_ids(x):
    return tokenizer().encode(x or "", add_special_tokens=False).ids


def test_tokens_are_the_tokenizers():
    texts = [r[1] or "" for r in odd_rows()] + ["Hello WORLD's don't 'S  x", "ΑΣ σ", "12 ½ '' 'd", "x" * 5000, "a\x1cb"]
    for x, raw in zip(texts, tokens.encode(texts, tokens.path_of(tokens.WORD_BPE)), strict=True):
        assert list(memoryview(raw).cast("I")) == whole_ids(x), x[:50]


def check_packed(rows, docs, capacity=packing.CAPACITY):
    by, at = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id, r.piece].append(r)
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    for i, x in docs:
        ids = [*whole_ids(x), 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            assert any((r.start, r.length, r.ids_crc32) == (k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))) for r in by[i, k // capacity])
    return len(at)


def test_packing(odd, none):
    rows, docs = packing.pack(odd).collect(), [(r[0], r[1]) for r in odd_rows()]
    assert len(rows) == sum(-(-(len(whole_ids(x)) + 1) // packing.CAPACITY) for _, x in docs)
    total = sum(r.length for r in rows)
    assert check_packed(rows, docs) == -(-total // packing.CAPACITY)
    assert packing.pack(none).count() == 0


def test_packing_of_one_repeated_id(spark):
    """One id may have most of the rows: no salt has them all, and every sequence is filled without gaps."""
    short, long = "a few words of text ", "a few words of text " * 900
    df = spark.createDataFrame([(7, short)] * 400 + [(7, long)] * 3 + [(None, short)] * 50 + [(8, None)], "doc_id long, text string").repartition(4)
    got = packing.pack(df).collect()
    assert collections.Counter(r.doc_id for r in got if r.piece == 0) == {7: 403, None: 50, 8: 1}
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(places) <= 1 + -(-sum(r.length for r in got) // packing.CAPACITY)


def test_packing_of_the_table(spark, data):
    rows = packing.op9(spark, data).collect()
    check_packed(rows, {(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()})
    n = len({r.sequence_id for r in rows})
    assert n <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_near_its_bound(seed):
    rng = np.random.default_rng(seed)
    capacity = [10, 64, 2048][seed % 3]
    count = collections.Counter(np.minimum(capacity, 1 + rng.exponential(capacity / 4, 3000).astype(int)).tolist())
    used, seen = collections.Counter(), collections.Counter()
    for length, first, beyond, sequence, _ in packing.plan(dict(count), capacity):
        seen[length] += beyond - first
        for i in range(beyond - first):
            used[sequence + i] += length
    assert seen == count and max(used.values()) <= capacity
    assert len(used) <= 1.02 * max(-(-sum(k * n for k, n in count.items()) // capacity), sum(n for k, n in count.items() if 2 * k > capacity)) + 1


def test_reduction_loses_nothing():
    """On small instances, fixing the dominating sets leaves an instance whose optimum is the old one less the sets."""

    def optimum(items, capacity):
        items, best = sorted(items, reverse=True), [len(items)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for room in {b for b in bins if b >= items[i]}:
                at = bins.index(room)
                place(i + 1, [*bins[:at], room - items[i], *bins[at + 1 :]])
            place(i + 1, [*bins, capacity - items[i]])

        place(0, [])
        return best[0]

    rng = np.random.default_rng(1)
    for _ in range(60):
        items = rng.integers(1, 11, 9).tolist()
        count = dict(collections.Counter(items))
        fixed = packing.reduce_instance(count, 10)
        left = [k for k, n in count.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (optimum(left, 10) if left else 0) == optimum(items, 10), items


def test_rollup_keeps_totals(spark, data, odd):
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.op1(spark, data).collect()}
    want = collections.defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        if n := len(whole_ids(r.text)):
            want[r.source, r.lang][0] += 1
            want[r.source, r.lang][1] += n
    assert got == {k: tuple(v) for k, v in want.items()}
    counted = {(r.doc_id, r.n_tokens) for r in rollup.token_counts(odd).collect()}
    assert counted == {(r[0], len(whole_ids(r[1]))) for r in odd_rows()}


def test_rollup_batches_are_idempotent(spark):
    root = new_path(spark, "test-rollup")
    feed = spark.createDataFrame([("insert", "a", "en", "v", 5), ("insert", None, None, "v", None), ("delete", "a", "en", "v", 2)], "op string, source string, lang string, tokenizer string, n_tokens long")
    assert rollup.totals(spark, root).count() == 0
    assert rollup.apply_batch(spark, root, "1", feed) and not rollup.apply_batch(spark, root, "1", feed)
    rows = lambda: {(r.source, r.n_docs, r.n_tokens) for r in rollup.totals(spark, root).collect()}
    assert rows() == {("a", 0, 3), (None, 1, 0)}
    revise = spark.createDataFrame([("revise", "a", "en", "w", 9, "a", "en", "v", 3)], "op string, source string, lang string, tokenizer string, n_tokens long, old_source string, old_lang string, old_tokenizer string, old_n_tokens long")
    assert rollup.apply_batch(spark, root, "2", revise)
    assert rollup.compact(spark, root)
    assert rows() == {("a", 1, 9), ("a", -1, 0), (None, 1, 0)} and not rollup.apply_batch(spark, root, "2", revise)
    assert rollup.apply_batch(spark, root, "3", feed.limit(0))


def test_two_compactions_at_once_and_replays_after_deletion(spark, monkeypatch):
    from matchlake.llm.shared import remove

    root = new_path(spark, "test-compactions")
    feed = spark.createDataFrame([("insert", "a", "en", "v", 5)], "op string, source string, lang string, tokenizer string, n_tokens long")
    rows = lambda: [(r.n_docs, r.n_tokens) for r in rollup.totals(spark, root).collect()]
    assert rollup.apply_batch(spark, root, "1", feed)
    seen = rollup._batches(spark, root)
    with monkeypatch.context() as m:
        m.setattr(rollup, "_batches", lambda *a: seen)  # both have read the folder before either commits
        assert rollup.compact(spark, root) and not rollup.compact(spark, root)
    assert rows() == [(1, 5)] and not rollup.apply_batch(spark, root, "1", feed)
    assert rollup.apply_batch(spark, root, "2", feed) and rollup.compact(spark, root) and rows() == [(2, 10)]
    remove(spark, *(f"{root}/committed/{x}" for x in ("generation-1", "1", "2")))
    assert rows() == [(2, 10)]
    assert not rollup.apply_batch(spark, root, "1", feed) and not rollup.apply_batch(spark, root, "2", feed) and rows() == [(2, 10)]


# ---- task functions


def test_task_functions_stay_small():
    """Nothing that grows in a process, such as by training, travels with a task."""
    from pyspark import cloudpickle

    from matchlake.llm import fingerprints, minhash, packing

    language._train([("en", b"one two three " * 20_000), ("de", b"eins zwei drei " * 20_000)])
    list(tokens.encode(["one two three"] * 10, tokens.path_of(tokens.WORD_BPE)))
    cut = packing._pieces(tokens.path_of(tokens.WORD_BPE), 2048)
    for f in (minhash._sign, minhash._sets, minhash._compare, minhash._own_shingles, quality._described, fingerprints._edit, cut):
        assert len(cloudpickle.dumps(f)) < 100_000


# ---- 2


def test_quality_separates_labelled_rows(spark, data):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = {r.doc_id: r.keep for r in quality.op2(spark, data).collect()}
    assert np.mean([got[i] == bool(q) for i, q in labels.items()]) > 0.97


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (20, 1), (8, 0), (8, 0), (21, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.quality <= 1 for r in rows)
    assert all(not r.keep and r.quality == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert {r.keep for r in quality.score_quality(odd, labels.limit(0)).collect() if r.doc_id in (0, 20)} == {True}
    assert quality.score_quality(none, labels).count() == 0


def test_posteriors_are_the_plain_ones(spark, data):
    """Rates of hosts and paths and each posterior, made anew from the evidence by loops."""
    model = quality.fit_quality(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    rows = [r for r in quality.score_quality(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")).collect()]
    own = {i: 1 / (1 + np.exp(-r.evidence)) for i, r in enumerate(rows) if r.evidence is not None}
    rate = np.mean(list(own.values()))
    assert model.rate == pytest.approx(rate)
    logit = lambda p: np.log(p / (1 - p))
    for i, r in enumerate(rows):
        if r.evidence is None:
            assert r.quality == 0 and not r.keep
            continue
        host = [q for j, q in own.items() if j != i and rows[j].source == r.source]
        path = [q for j, q in own.items() if j != i and (rows[j].source, rows[j].lang) == (r.source, r.lang)]
        of_host = (model.host_weight * rate + sum(host)) / (model.host_weight + len(host))
        of_path = (model.path_weight * of_host + sum(path)) / (model.path_weight + len(path))
        assert r.site_rate == pytest.approx(of_path) and r.quality == pytest.approx(1 / (1 + np.exp(-(r.evidence + logit(of_path) - logit(rate)))), abs=1e-9)
        assert r.keep == (r.quality >= 0.5)


def test_quality_of_labels_that_were_held_out(spark):
    """Half of some 400 labels; half of the 87 of the smallest table would be too few to fit 27 weights."""
    folder = "/root/testdata/sf0.01"
    labels, docs = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("labels", "documents"))
    half = labels.where("crc32(cast(doc_id AS string)) % 2 = 0")
    got = {r.doc_id: r.keep for r in quality.score_quality(docs, half).collect()}
    assert np.mean([got[r.doc_id] == bool(r.quality) for r in labels.exceptAll(half).collect()]) > 0.93


def test_sparse_sites_shrink(spark):
    """Two hosts, one of one document: its rate stays near the global rate."""
    docs = spark.createDataFrame([(i, prose(i), "p", "big") for i in range(60)] + [(99, prose(99), "p", "small")], "doc_id long, text string, lang string, source string")
    rows = {r.source: r.site_rate for r in quality.score_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert rows["small"] == pytest.approx(0.5, abs=0.05) and rows["big"] == pytest.approx(0.5, abs=0.05)


# ---- 7


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    for n in (1, 3, 6):
        k = 3
        scores, first, a, s = rng.normal(size=(n, k)), rng.random(n) < 0.3, rng.normal(size=(k, k)), rng.normal(size=k)
        first[0] = True
        want = np.zeros((n, k))
        for y in itertools.product(range(k), repeat=n):
            v = np.exp(sum(scores[t, y[t]] + (s[y[t]] if first[t] else a[y[t - 1], y[t]]) for t in range(n)))
            for t in range(n):
                want[t, y[t]] += v
        assert np.allclose(language.forward_backward(scores, first, a, s), want / want.sum(axis=1, keepdims=True))
    scores, first = rng.normal(size=(900, 3)), np.zeros(900, dtype=bool)
    first[[0, 256, 300]] = True
    whole = np.concatenate([language.forward_backward(scores[i:j], first[i:j], a, s) for i, j in ((0, 256), (256, 300), (300, 900))])
    assert np.allclose(language.forward_backward(scores, first, a, s), whole)


def test_gradients_of_the_chain_are_those_of_finite_differences():
    rng, k, n = np.random.default_rng(8), 3, 7
    scores, first, a, s, y = rng.normal(size=(n, k)), np.array([1, 0, 0, 0, 1, 0, 0], bool), rng.normal(size=(k, k)), rng.normal(size=k), rng.integers(0, k, n)

    def likelihood(scores, a, s):
        total = 0.0
        for run in np.split(np.arange(n), np.flatnonzero(first)[1:]):
            way = lambda z: s[z[0]] + scores[run, z].sum() + a[z[:-1], z[1:]].sum()  # noqa: E731, B023
            total += way(y[run]) - np.log(sum(np.exp(way(np.array(z))) for z in itertools.product(range(k), repeat=len(run))))
        return total

    for got, where in zip(language.gradients(scores, first, a, s, y), (0, 1, 2), strict=True):
        want, parts = np.zeros_like(got), [scores, a, s]
        for i in np.ndindex(*got.shape):
            step = np.zeros_like(got)
            step[i] = 1e-5
            up, down = (likelihood(*[x + d * step if j == where else x for j, x in enumerate(parts)]) for d in (1, -1))
            want[i] = (up - down) / 2e-5
        assert np.allclose(got, want, atol=1e-6)


def test_training_documents_are_bounded(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    twins = docs.union(docs.limit(1).crossJoin(spark.range(300)).select(docs.columns))
    seen = []
    monkeypatch.setattr(language, "_train", lambda rows: seen.append(rows))
    language.fit_language(twins, 20)
    languages = {r[0] for r in seen[0]}
    longest = max(len((r.text or "").split()) for r in docs.collect())
    assert languages == {r.lang for r in docs.select("lang").distinct().collect()} and len(seen[0]) <= 20 * (1 + longest // language.RUN)


def test_language_of_held_out_documents(spark, data):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = language.op7(spark, data).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_language_of_odd_rows(spark, odd, none, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language.fit_language(docs)
    label = language._labels(spark, model)
    rows = {r.doc_id: r.x for r in odd.select("doc_id", label("text").alias("x")).collect()}
    assert all((rows[i]["name"], rows[i]["score"]) == ("und", 0.0) for i in (3, 4, 5, 9)) and rows[8]["name"] in model.languages
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.keep_identified(odd).columns == odd.columns


def test_words_of_mixed_text_are_told_apart(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language.fit_language(docs)
    one = {r.lang: r.text for r in docs.where("lang IN ('en', 'fr') AND n_chars BETWEEN 500 AND 3000").orderBy("n_chars").collect()}
    half = {k: " ".join(v.split()[:60]) for k, v in one.items()}
    (_, _, _, gamma), = model.words(pa.array([half["en"] + " " + half["fr"]]))
    best = [model.languages[i] for i in gamma.argmax(axis=1)]
    assert best[:40].count("en") > 36 and best[-40:].count("fr") > 36
