import functools
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from llm.util import odd_documents
from tidestep.llm import repeats, topk, transducer
from tidestep.llm.repeats import remove_repeats
from tidestep.llm.suffixes import shares, suffix_array
from tidestep.llm.token_counts import count_tokens
from tidestep.llm.tokens import library
from tidestep.llm.topk import top_k


def brute_top(rows, k):
    whole = {r: [math.floor(64 * x) for x in v] for r, (i, v) in rows.items()}
    out = []
    for q, (qi, _) in rows.items():
        if qi % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), rows[c][0], c) for c in rows if c != q and len(whole[c]) == len(whole[q]))[:k]
            out += [(qi, n + 1, i, -s) for n, (s, i, _) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_top_k_against_brute_force(spark, scale):
    rng = random.Random(3)
    vec = lambda n: [float(np.float32(rng.gauss(0, scale))) for _ in range(n)]
    rows = [(i, vec(6)) for i in range(200)] + [(500 + i, [0.25 * scale] * 6) for i in range(60)] + [(20, vec(6)), (700, vec(3)), (701, vec(3)), (720, vec(3))]
    bad = [(None, vec(6)), (40, None), (60, [None] * 6), (80, [math.nan] * 6), (100, [math.inf] * 6), (120, [])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit("x")}).repartition(3)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute_top(dict(enumerate(rows)), 20)
    assert top_k(df.limit(0), F.lit(True)).collect() == []


def block_of(rows, ids, x, pivots):
    d = topk._table(x, pivots)
    return topk.Block.of({"n": len(x), "dim": x.shape[1], "rows": rows.tobytes(), "ids": ids.tobytes(), "x": x.tobytes(), "d": d.tobytes()})


def test_pivots_rule_candidates_out():
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 60, (40, 16))
    x = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(0, 3, (3000, 16))).astype(np.int64)
    ids, pivots = np.arange(3000), np.arange(0, 3000, 12)
    blocks = [block_of(ids[k : k + 1000], ids[k : k + 1000], x[k : k + 1000], x[pivots]) for k in (0, 1000, 2000)]
    search = topk.Search(20, block_of(ids[:30], ids[:30], x[:30], x[pivots]), pivots, x[pivots])
    shares = []
    for b in blocks:
        before = search.scored
        search.meet(b)
        shares.append((search.scored - before) / 30 / 1000)
    assert search.met == 30 * 2999 and search.scored < 0.25 * search.met and shares[2] < shares[0]
    for i in range(30):
        s = x @ x[i]
        want = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        assert search.best[i][:, 1].tolist() == want and search.best[i][:, 0].tolist() == s[want].tolist()


def test_transducer_equals_the_library():
    rng = random.Random(1)
    alphabet = "ab c'tsrevml d<|>endoftext \n\t　\xa0.!1９ñß日Σ́"
    texts = ["", " ", "don't 's 've 'v 'rx ''s a'", "  <|endoftext|>  x", "<|endoftext|><|endoftext|>", "aaaa" * 90, " " * 300 + "x", "x  \n"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    t, tokens = transducer.transducer(), library("byte_bpe_50k.json")
    for x in texts:
        n = len(tokens.encode(x, add_special_tokens=False).ids)
        assert t.count(x) == n and t.unit(x) == n
        cuts = sorted({0, len(x), *(c for _ in range(4) if not inside(x, c := rng.randint(0, len(x)), t.special))})
        m = map_of(x, cuts)
        assert transducer.total(m) == n


def inside(x, at, special):
    return any(0 <= x.find(s, max(0, at - len(s) + 1), at + len(s) - 1) < at for s in special)


def map_of(x, cuts, look=transducer.LOOK):
    maps = [transducer.chunk_map(x[a:b], x[max(0, a - look) : a], a <= look) for a, b in zip(cuts, cuts[1:], strict=False)]
    return functools.reduce(transducer.compose, maps, transducer.chunk_map(""))


def test_maps_compose_in_any_grouping():
    x = "ab cdefgh'll  x\n\n yy don't 123abc" * 3
    cuts = [0, 3, 9, 11, 12, 40, 41, 90, len(x)]
    maps = [transducer.chunk_map(x[a:b], x[max(0, a - 20) : a], a <= 20) for a, b in zip(cuts, cuts[1:], strict=False)]
    start = transducer.name_of(transducer.transducer().start)
    left = functools.reduce(transducer.compose, maps)
    right = functools.reduce(lambda b, a: transducer.compose(a, b), maps[::-1])
    assert left == right and start in left and set(maps[0]) == {start} and any(len(m) > 1 for m in maps)


def test_one_megabyte_without_spaces_is_scanned_by_many_maps(spark):
    rng = random.Random(9)
    run = "".join(rng.choice("etaoinshrdlu") for _ in range(150_000)) + "a" * 650_000 + "-" * 100_000 + "日本" * 50_000
    df = spark.createDataFrame([(1, run), (2, "b" * 70_000)], "doc_id bigint, text string")
    tokens = library("byte_bpe_50k.json")
    want = {r.doc_id: len(tokens.encode(r.text, add_special_tokens=False).ids) for r in df.collect()}
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == want
    cuts = [*range(0, len(run), 32_768), len(run)]
    maps = [transducer.chunk_map(run[a:b], run[max(0, a - transducer.LOOK) : a], a <= transducer.LOOK) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert len(maps) > 30 and transducer.total(functools.reduce(transducer.compose, maps)) == want[1]
    for m in maps:  # digests and numbers only
        assert len(m) <= transducer.LOOK and all(len(e) == len(x) == 16 and isinstance(n, int) for e, (x, n, _) in m.items())


def test_a_text_whose_maps_do_not_compose_is_counted_in_one_run(spark):
    df = spark.createDataFrame([(1, "a" * 700 + "b" * 300 + " c d")], "doc_id bigint, text string")
    n = len(library("byte_bpe_50k.json").encode(df.first().text, add_special_tokens=False).ids)
    assert transducer.total(map_of(df.first().text, [0, 250, 500, 750, 1004], look=0)) is None
    assert [r.n_tokens for r in count_tokens(df, chunk=250, look=0).collect()] == [n]


@pytest.mark.parametrize("chunk", [32_768, 50])
def test_token_counts(spark, chunk):
    df = odd_documents(spark).withColumn("n_tokens", F.lit("clash"))
    tokens = library("byte_bpe_50k.json")
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(tokens.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    got = count_tokens(df, chunk=chunk).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert count_tokens(df.limit(0), chunk=chunk).collect() == []


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(150):
        strings = [bytes(rng.choice(rng.choice([b"ab", b"a", b"\0a\0b", b"abcdef"])) for _ in range(rng.randint(1, rng.choice([3, 12, 40])))) for _ in range(rng.randint(1, 6))]
        buf, length = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
        ends = np.cumsum(length)
        suffix = lambda p: buf[p : ends[np.searchsorted(ends, p, side="right")]].tobytes()  # noqa: B023, E731
        sa = suffix_array(buf, length)
        assert sorted(sa.tolist()) == list(range(len(buf)))
        got = [suffix(p) for p in sa]
        assert got == sorted(got)
    assert shares(np.frombuffer(b"abcabd", np.uint8), np.array([0]), np.array([3]), 2).tolist() == [True]


def test_suffixes_are_sorted_only_where_windows_need_it():
    rng = random.Random(6)
    for k in range(300):
        depth = rng.choice([1, 2, 5, 9, 17, 50])
        letters = rng.choice([b"ab", b"a", b"\0a\0b", b"abcdef"])
        strings = [bytes(rng.choice(letters) for _ in range(depth + rng.randint(0, 20))) for _ in range(rng.randint(1, 8))]
        strings += [s[: rng.randint(depth, len(s))] for s in strings]
        buf, length = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
        heads, begin = length - depth + 1, np.cumsum(length) - length
        sa = suffix_array(buf, length, heads, depth)
        assert len(set(sa.tolist())) == len(sa)
        windows = {int(b) + j for b, h in zip(begin, heads, strict=True) for j in range(h)}
        got = [p for p in sa.tolist() if p in windows]
        assert set(got) == windows
        words = [buf[p : p + depth].tobytes() for p in got]
        assert words == sorted(words)
        if len(set(letters)) > 2 and depth == 50 and k % 2:
            assert len(sa) < 0.6 * len(buf)


@pytest.mark.parametrize("length", [17, 50, 100])
def test_blocks_hold_their_anchors(length):
    rng = random.Random(length)
    for _ in range(8):
        held = [(repeats.NONE if rng.random() < 0.1 else rng.randint(0, 5), bytes(rng.choice(b"ab c") for _ in range(rng.choice([0, 3, length, length + 1, 250])))) for _ in range(rng.randint(1, 9))]
        x = repeats.Block(*repeats.pack_block(held, length), length)
        h = repeats.gram_hashes(x.buf) if len(x.buf) >= repeats.GRAM else []
        begin, want = 0, []
        for i, t in held:
            before = None
            for w in range(begin, begin + len(t) - length + 1 if i != repeats.NONE else 0):
                at = min(range(w, w + length - repeats.GRAM + 1), key=lambda j: (int(h[j]) >> 19, j))  # noqa: B023
                if at == before:
                    want[-1][2] += 1
                else:
                    want.append([at, w, 1, i])
                before = at
            begin += len(t)
        assert [list(map(int, r)) for r in zip(x.anchor, x.first, x.count, x.doc, strict=True)] == want
        for r, a, n in zip(x.contexts(np.arange(len(want)), length), x.first, x.count, strict=True):
            assert r[2:].tobytes() == x.text[a : a + int(n) + length - 1].ljust(2 * length, b"\0")


def test_repeats_some_rows_at_once(monkeypatch):
    monkeypatch.setattr(repeats, "ROWS", 7)
    monkeypatch.setattr(repeats, "GRAMS", 64)
    rng = random.Random(2)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(4)]
    rows = [(k, "".join(rng.choice(passages)[: rng.randint(0, 200)] + rng.choice("xyz") for _ in range(rng.randint(0, 5)))) for k in range(40)]
    length, parts, shares_of = 50, 5, (0, 13, 14, 40)
    packed = [repeats.pack_block([(i, t.encode()) for i, t in rows[a:z]], length) for a, z in zip(shares_of, shares_of[1:], strict=False)]
    blocks = pa.Table.from_batches([repeats._batch(repeats.BLOCKS, [(k, *p) for k, p in enumerate(packed)])])
    by = lambda t, c, n, f: pa.concat_tables([f(t.filter(pc.equal(t[c], k))) for k in range(n) if pc.any(pc.equal(t[c], k)).as_py()])
    told = pa.Table.from_batches(list(repeats._anchors(parts, length)(iter(blocks.to_batches()))))
    repeated = by(told, "part", parts, repeats._repeated)
    contexts = by(blocks, "block", 3, lambda b: repeats._contexts(parts, length)(b, repeated.filter(pc.equal(repeated["block"], b["block"][0]))))
    marks = by(contexts, "part", parts, repeats._resolve(length))
    out = by(blocks, "block", 3, lambda b: repeats._cut(length, "doc_id", True)(b, marks.filter(pc.equal(marks["block"], b["block"][0]))))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["kept"]) for r in out.to_pylist())
    assert got == brute_repeats(rows) and any(r[2] for r in got)


def test_few_messages_between_blocks_and_parts():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, 1 << 20, dtype=np.uint8).tobytes().decode() for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 20), pa.array(range(20)), pa.array(texts)], names=["part", "id", "text"])
    blocks = list(repeats._pack(repeats.BLOCK_BYTES, 50)(iter([batch])))
    assert len(blocks) == 2  # the messages are these times the parts
    told = pa.Table.from_batches(list(repeats._anchors(5, 50)(iter(blocks))))
    assert told.num_rows == 2 * 5 and 20 * 2**20 / 18.5 < sum(map(len, told.column("hashes").to_pylist())) / 4 < 20 * 2**20 / 17.5


@pytest.mark.parametrize("collide", [False, True])
def test_equal_rows_are_compared_in_full(monkeypatch, collide):
    if collide:
        monkeypatch.setattr(repeats, "row_hashes", lambda words: words[:, 0] % np.uint64(3))
    monkeypatch.setattr(repeats, "ROWS", 5)
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 200):
        rows = rng.integers(0, 2, (n, 102), dtype=np.uint8) * (np.arange(102) < 5).astype(np.uint8) + np.uint8(1)
        first, number = repeats._equal_rows(rows)
        assert len(first) == len({r.tobytes() for r in rows}) and number[first].tolist() == list(range(len(first)))
        assert np.array_equal(rows[first][number], rows)


def test_marks_look_only_at_contexts_that_may_be_equal(monkeypatch):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).encode()
    alone, twice = [letters(300) for _ in range(6)], letters(300)
    x = repeats.Block(*repeats.pack_block([(k, t) for k, t in enumerate([*alone, twice, twice])], 50), 50)
    made, contexts = [], repeats.Block.contexts
    monkeypatch.setattr(repeats.Block, "contexts", lambda self, some, length: made.append(len(some)) or contexts(self, some, length))
    some = np.flatnonzero(x.doc < 7)  # one of each context is named, as the round before the last step does
    mark = (len(some), repeats._squeeze(some.astype("<u4"), np.zeros(len(some), "u1"), x.count[some], np.full(len(some), -1, "<i8")))
    gone = repeats.covered(x, [mark], 50)
    assert gone.all() and sum(made) == 2 * int((x.doc == 6).sum())


def brute_repeats(rows, length=50):
    starts = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                starts[w] = min(starts.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - length + 1):
                if starts[b[i : i + length]] < d:
                    gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3000, "part_bytes": 20_000}])
def test_repeats_against_brute_force(spark, sizes):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(160))
    rows = [(r.doc_id, r.text) for r in odd_documents(spark, 30).collect()]
    rows += [(1000 + k, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 60) : 160 - rng.randint(0, 60)] + str(k)) for k in range(40)]
    rows += [(2000, "é" * 40), (2001, "é" * 41), (2002, "a" * 49), (2003, "a" * 49), (2004, "a" * 50), (2005, "b" + "a" * 70)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit(1)).repartition(4)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in remove_repeats(df, **sizes).collect())
    assert got == brute_repeats(rows)
    assert remove_repeats(df.limit(0)).collect() == []
