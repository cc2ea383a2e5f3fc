"""Conversation repair, repeated strings and token alignment against brute force, with the odd rows that each must stand."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from matchlake.llm import alignment, conversations, suffixes, tokens

# ---- 11

TALK = "conv_id long, turn long, role string, text string, ord long, digest string"


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else str(x)
        d, role, text = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20, blank(role), blank(text)
        if d == 1:
            text = ""
        if d == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    """All ways, state by state: the least (cost, audit, repaired) of each."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    made = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(4):
            for p, (c, a, r) in list(best.items()):
                role, q = made[p]
                way = (c + 5, a + "I", (*r, f"{role}:"))
                best[q] = min(best.get(q, way), way)
        return best

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for p, (c, a, r) in inserted(best).items():
            ways = [(p, (c + 2, a + "D", r))]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (p, role[:1]) in step:
                    ways.append((step[p, role[:1]], (c + extra, a + "K", (*r, f"{role}:{text}"))))
                to, q = made[p]
                ways.append((q, (c + extra + 1, a + "R", (*r, f"{to}:{text}"))))
            for q, way in ways:
                new[q] = min(new.get(q, way), way)
        best = new
    return min(way for q, way in inserted(best).items() if q in (0, 3))


def _repaired(rows):
    """conv_id -> what the query returns of it."""
    out = {}
    damaged = collections.defaultdict(list)
    for conv, turn, role, text in _damage(rows):
        damaged[conv].append((turn, role, text))
    for conv in {r[0] for r in rows}:
        own = sorted(damaged[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        faults = _faults(own)
        turns = {r[0] for r in own} - {None}
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(own))
        cost, audit, left = _cheapest(own, faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def _talk(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice((1, 2, 3, 5, 9))):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "User"))
            rows.append((conv, rng.choice((turn, turn, turn, turn + 3, None)), role, rng.choice(("One.", "Two!", "cut", " ", "", None, "Three? \n", "a.b", "Ünï.", "x" * 50 + "."))))
    rows += [(None, k, ("user", "assistant")[k % 2], f"Said {k}.") for k in range(7)] + [(-5, k % 40, ("user", "assistant", "system")[k % 3], f"Said {k % 30}{'.' if k % 4 else ''}") for k in range(300)]
    return rows


def _said(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def _repair_query(spark, rows, tmp_path):
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(*r, 7, "x") for r in rows], TALK).write.parquet(path)
    return conversations.op11(spark, str(tmp_path))


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_of_odd_conversations(spark, tmp_path, seed):
    rows = _talk(seed)
    got, want = _said(_repair_query(spark, rows, tmp_path)), _repaired(rows)
    assert got == want


def test_repairs_of_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _said(conversations.op11(spark, data)) == _repaired(rows)


def test_repair_of_an_empty_table(spark, tmp_path):
    assert _repair_query(spark, [], tmp_path).count() == 0


def test_a_conversation_over_many_ranges(spark, tmp_path):
    rows = [(1, k, ("user", "assistant")[k % 2], f"Said {k % 700}.") for k in range(3000)] + [(2, 0, "user", "Hm.")]
    assert _said(_repair_query(spark, rows, tmp_path)) == _repaired(rows)


def test_repaired_rows_alternate_and_keep_their_texts(spark):
    rows = spark.createDataFrame(_talk(3, 60), "conv_id long, turn long, role string, text string")
    found = conversations.repair(conversations.damaged(rows))
    talks = collections.defaultdict(list)
    for r in conversations.repaired(found).collect():
        talks[r.conv_id].append(r)
    digests = {r.conv_id: r.repaired_sha256 for r in conversations.digests(found).collect()}
    for conv, own in talks.items():
        own.sort(key=lambda r: r.place)
        roles = "".join(r.role[0] for r in own).removeprefix("s")
        assert roles == "ua" * (len(roles) // 2) and [r.place for r in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == digests[conv]


def test_tables_put_together_are_those_of_the_rows():
    rng = random.Random(4)
    for _ in range(50):
        kinds = [rng.randrange(12) for _ in range(rng.randint(2, 9))]
        at = rng.randrange(1, len(kinds))
        parts = []
        for own in (kinds[:at], kinds[at:]):
            t = conversations.ROWS[own[0]]
            for k in own[1:]:
                t = conversations.joined(t, conversations.ROWS[k])
            parts.append(t)
        whole = conversations.solve([conversations.ROWS[k] for k in kinds])
        cuts = conversations.solve(parts)
        assert cuts == [whole[at - 1], whole[-1]]
        assert whole[:at] == conversations.solve([conversations.ROWS[k] for k in kinds[:at]], 0, cuts[0])


# ---- 12


def _repeats(texts, length=400):
    texts = [(x or "").encode() for x in texts]
    seen = collections.Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for x in texts:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        out.append((len(x), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def _prose(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefgh éß.") for _ in range(n))


def _cleaned(df):
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def _texts():
    shared, whole = _prose(1, 450), _prose(2, 900)
    rows = [(1, whole), (2, whole), (2, whole), (3, _prose(3, 300) + shared + _prose(4, 200)), (4, shared[:420] + _prose(5, 100)), (5, _prose(6, 90) + shared[20:] + shared[:430]), (6, None), (7, ""), (8, "a" * 1500), (9, _prose(7, 150) * 6), (None, shared), (None, None), (10, "\x00" * 401), (11, whole[:399]), (12, _prose(8, 399))]
    return rows + [(100 + k, _prose(100 + k, 60) + shared[100:400] + _prose(200 + k, 400 - k)) for k in range(12)] + [(200 + k, _prose(300 + k, 50) + whole[:500] + _prose(400 + k, 20)) for k in range(8)]


@pytest.mark.parametrize("hot", [500, 3])
def test_repeated_strings_of_odd_texts(spark, hot):
    rows = _texts()
    docs = spark.createDataFrame([(i, x, "k", 5) for i, x in rows], "doc_id long, text string, key string, start int")
    want = collections.Counter((i, *r) for (i, _), r in zip(rows, _repeats([x for _, x in rows]), strict=True))
    assert _cleaned(suffixes.remove_repeated(docs, hot=hot)) == want


def test_repeated_strings_of_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, _repeats([r.text for r in rows]), strict=True))
    assert _cleaned(suffixes.op12(spark, data)) == want and sum(x[2] * n for x, n in want.items()) > 0


def test_starts_of_one_very_common_string_are_split_among_tasks(spark):
    """A third of the starts have the hashes (0, 0); every other string occurs twice, but for 1,000 that occur once."""
    names = {"autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "16", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    names = {f"spark.sql.{k}": v for k, v in names.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        string = "CASE WHEN id < 60000 THEN 0 WHEN id < 180000 THEN 1 + id % 60000 ELSE id END"
        starts = spark.range(0, 181_000, 1, 8).selectExpr("id AS key", "id AS body", "1 AS starts", "1L AS weight", "0 AS at", f"{string} AS one", f"{string} AS two")
        found = suffixes._repeated_of_hot(starts, suffixes.Tables(spark, "test")).select("key")
        assert sorted(r.key for r in found.collect()) == list(range(180_000))
        assert "SortMergeJoin(skew=true)" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repeated_strings_of_an_empty_table(spark):
    assert suffixes.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    from matchlake.llm import text

    monkeypatch.setattr(text, "SLICE_BYTES", 1000)
    passage = _prose(1, 700)
    data = np.frombuffer((_prose(2, 3000) + passage + _prose(3, 2500) + passage[:450] + _prose(4, 1700)).encode(), np.uint8)
    starts = []
    for _, offsets, part, place in suffixes._pieces(data, np.array([0, len(data)]), 400):
        begin, count, *_ = suffixes.regions_of(part, offsets)
        starts += [place + b + k for b, n in zip(begin, count, strict=True) for k in range(n)]
    assert sorted(starts) == list(range(len(data) - 399))


@pytest.mark.parametrize("length", [3, 8, 20])
def test_two_stage_sorting(length):
    rng = random.Random(length)
    for _ in range(40):
        regions, starts = [], []
        for _ in range(rng.randint(1, 9)):
            n = rng.randint(1, 30)
            regions.append(bytes(rng.choice((0, 97, 98, 254)) for _ in range(n + length - 1)))
            starts.append(n)
        t = np.frombuffer(b"".join(bytes(c + 1 for c in r) + b"\0" for r in regions) + bytes(length), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(r) + 1 for r in regions])))
        wanted = np.zeros(len(t), bool)
        for i, n in zip(at, starts, strict=False):
            wanted[i : i + n] = True
        found, raw = suffixes.order(t, wanted, length).tolist(), t.tobytes()
        assert sorted(found) == np.flatnonzero(wanted).tolist()
        assert [raw[i : i + length] for i in found] == sorted(raw[i : i + length] for i in found)
        prefix = suffixes.common_prefixes(t, np.array(found[:-1], int), np.array(found[1:], int), length)
        for i, j, n in zip(found, found[1:], prefix, strict=False):
            assert raw[i : i + n] == raw[j : j + n] and (n == length or raw[i + n : i + n + 1] != raw[j + n : j + n + 1])
        seen = collections.Counter(r[i : i + length] for r, n in zip(regions, starts, strict=True) for i in range(n))
        got = suffixes.repeated(regions, starts, [1] * len(regions), length)
        assert [g.tolist() for g in got] == [[seen[r[i : i + length]] > 1 for i in range(n)] for r, n in zip(regions, starts, strict=True)]


# ---- 13


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(tokens.path_of(alignment.BYTE_BPE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokens.path_of(alignment.PIECES))


def _plain_alignment(rows, encoders):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) by definition, each text encoded whole."""
    a, b = encoders
    state = alignment._tokenizers(tokens.path_of(alignment.BYTE_BPE), tokens.path_of(alignment.PIECES))
    docs, count = [], collections.Counter()
    for doc, x in rows:
        groups = []
        if x:
            ids_a, ids_b = a.encode(" " + x, add_special_tokens=False).ids, b.encode(x)
            raw = (" " + x).encode()
            if b"".join(state.bytes_a[i] for i in ids_a) == raw == b"".join(state.bytes_b[i] for i in ids_b):
                ends_a, ends_b = (list(itertools.accumulate(len(table[i]) for i in ids)) for table, ids in ((state.bytes_a, ids_a), (state.bytes_b, ids_b)))
                a0 = b0 = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    a1, b1 = ends_a.index(end) + 1, ends_b.index(end) + 1
                    groups.append((ids_a[a0:a1], ids_b[b0:b1]))
                    a0, b0 = a1, b1
        docs.append((doc, groups))
        count.update({(p, q) for g in groups for p in g[0] for q in g[1]})
    best = {}
    for (p, _), n in count.items():
        best[p] = max(n, best.get(p, 0))
    out = []
    for doc, groups in docs:
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return collections.Counter(out)


def _linked(df):
    return collections.Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


ODD = [
    None, "", " ", "  ", "\n", "\t x", "a", "One two  three   four.\n\n Five", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ x", "x▁ y", "naïve — “quoted” 日本語のテキスト です 。", "😀 👩‍👩‍👧 é", "\x00 \x1f\x85  y　z", "don't we'll I'M 123456 3.14159",
    "A" * 3000, "zx" * 2000, "lorem ipsum " * 400, "a\r\nb \r\n c", " lead", "trail ", "tail \n", "﻿bom", "x  y", "—— 123 !!", "é ß ẞ İ",
]


def test_alignment_of_odd_texts(spark, encoders):
    rows = [(k, x) for k, x in enumerate(ODD)] + [(None, "a null id"), (7, ODD[7]), (7, ODD[7])]
    docs = spark.createDataFrame([(i, x, 1, "b") for i, x in rows], "doc_id long, text string, block int, a string")
    assert _linked(alignment.aligned(docs)[0]) == _plain_alignment(rows, encoders)


def test_alignment_of_the_table(spark, data, encoders, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(5)
    assert _linked(alignment.aligned(docs)[0]) == _plain_alignment(rows, encoders)


def test_alignment_of_an_empty_table(spark):
    out, pairs = alignment.aligned(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and pairs.count() == 0


def test_groups_are_the_shared_cuts():
    rng = random.Random(5)
    for n in (1, 2, 5, 40, 400):
        for share in (0.01, 0.3, 0.9):
            ends = sorted(rng.sample(range(1, 4 * n + 1), n))
            a, b = ([e for e in ends if rng.random() < share] + [4 * n + 1] for _ in range(2))
            ga, gb = alignment.align(np.array(a), np.array(b), np.array([4 * n + 1]))
            assert [a[i - 1] for i in ga] == [b[i - 1] for i in gb] == sorted(set(a) & set(b))


def test_pairs_of_large_groups_are_those_listed(monkeypatch):
    rng = np.random.default_rng(6)
    a, b, ga, gb = rng.integers(0, 9, 60), rng.integers(0, 7, 50), np.array([2, 30, 60]), np.array([1, 40, 50])
    found = []
    for most in (4096, 10, 0):
        monkeypatch.setattr(alignment, "LISTED", most)
        total = collections.Counter()
        group, pair, times = alignment._pairs(a, b, ga, gb, 7)
        assert (np.diff(group) >= 0).all()
        for g, p, n in zip(group.tolist(), pair.tolist(), times.tolist(), strict=True):
            total[g, p] += n
        found.append(total)
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == 2 * 1 + 28 * 39 + 30 * 10
