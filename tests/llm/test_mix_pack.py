import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from llm.util import odd_documents
from tidestep.llm.huffman import BLOCK, Code, code_lengths
from tidestep.llm.mixing import emitted, mix_sources
from tidestep.llm.packing import Plan, pack_documents
from tidestep.llm.token_files import read_token_files, write_token_files
from tidestep.llm.tokens import byte_ids, library, word_ids


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_against_brute_force(spark):
    df = odd_documents(spark)
    rows = df.collect()
    got = mix_sources(df).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += count(r.text)
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == count(r.text) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-9)
    again = sorted((str(r.doc_id), r.taken) for r in mix_sources(df.repartition(3), carry=False).collect())
    assert again == sorted((str(r.doc_id), r.taken) for r in got)
    assert mix_sources(df.limit(0)).collect() == []


def test_order_within_a_source_is_by_hash(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "'w w w' as text", "if(id % 3 = 0, 'b', 'a') as source")
    got = {r.doc_id: r for r in mix_sources(df, carry=False).collect()}
    for s, share in (("a", 5 / 7), ("b", 2 / 7)):
        own = sorted((d for d in got if (d % 3 == 0) == (s == "b")), key=lambda d: hashlib.md5(f"mix|{d}".encode()).hexdigest())
        budget = int(min(6000 * share, 3 * 3 * len(own)))
        full, rest = divmod(budget, 3 * len(own))
        for d in own:
            extra = min(3, rest)
            rest -= extra
            assert got[d].taken == 3 * full + extra


def test_emitted_words(spark):
    df = odd_documents(spark)
    mixed = mix_sources(df)
    out = emitted(mixed)
    words = lambda d: sum(len((r.text or "").split()) for r in d.collect())
    assert words(out) == mixed.selectExpr("sum(taken)").first()[0]
    assert set(out.columns) == set(df.columns)


@pytest.mark.parametrize("kind", ["uniform", "half", "short", "full", "pairs"])
def test_plan(kind):
    rng = np.random.default_rng(1)
    lens = {"uniform": rng.integers(1, 1025, 3000), "half": rng.integers(400, 700, 2000), "short": rng.integers(1, 40, 5000), "full": np.full(9, 1024), "pairs": np.array([600] * 500 + [424] * 500 + [300] * 7)}[kind]
    counts = dict(zip(*(a.tolist() for a in np.unique(lens, return_counts=True)), strict=True))
    plan = Plan(counts)
    keys, first, sequence, offset = plan.arrays()
    length = np.repeat(np.array(sorted(counts)), [counts[k] for k in sorted(counts)])
    rank = np.concatenate([np.arange(counts[k]) for k in sorted(counts)])
    at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
    s, o = sequence[at] + rank - first[at], offset[at]
    check_sequences(s, o, length)
    assert len(set(s.tolist())) == plan.sequences
    large = int((lens > 512).sum())
    assert plan.sequences <= max(-(-int(lens.sum()) // 1024), large) * 1.2 + 1


def check_sequences(s, o, length):
    order = np.lexsort((o, s))
    s, o, length = s[order], o[order], length[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + length)[:-1][~new[1:]]).all() and (o + length).max() <= 1024


def test_packing_against_the_library(spark):
    df = odd_documents(spark)
    got = pack_documents(df).toPandas()
    check_sequences(got.sequence_id.to_numpy(), got.offset.to_numpy(), got.length.to_numpy())
    tokens = library("byte_bpe_50k.json")
    want = []
    for r in df.collect():
        ids = np.array([*tokens.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        start, end = 0, len(ids) % 1024 or min(len(ids), 1024)
        piece = 0
        while start < len(ids):
            want.append((str(r.doc_id), piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), ids[start:end].tobytes()))
            piece, start, end = piece + 1, end, end + 1024
    ids = [None if x != x else int(x) for x in got.doc_id]
    have = zip(map(str, ids), got.piece, got.start, got.length, got.ids_crc32, map(bytes, got.ids), strict=True)
    assert sorted(have) == sorted(want)
    assert pack_documents(df.limit(0)).collect() == []


@pytest.mark.parametrize(("n", "symbols", "limit"), [(0, 5, 16), (1, 5, 16), (300, 3, 16), (5000, 700, 10), (20_000, 49_408, 16)])
def test_huffman_round_trip(n, symbols, limit):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), symbols - 1).astype(np.uint32)
    counts = np.bincount(ids, minlength=symbols)
    lengths = code_lengths(counts, limit)
    assert lengths.max(initial=0) <= limit and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    code = Code(lengths)
    payload, starts = code.encode(ids)
    assert (code.decode(payload, starts, n) == ids).all() and len(starts) == -(-n // BLOCK)


def test_lengths_are_optimal_without_a_limit_in_the_way():
    import heapq

    counts = np.random.default_rng(3).integers(1, 1000, 60)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert int((counts * code_lengths(counts, 30)).sum()) == cost


def test_token_files_round_trip(spark, tmp_path):
    df = odd_documents(spark)
    path = f"file://{tmp_path}/ids"
    write_token_files(df, path)
    got = read_token_files(spark, path).collect()
    tokens = library("word_bpe_49k.json")
    want = [(r.doc_id, np.array([*tokens.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")) for r in df.collect()]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got) == sorted((str(d), len(i), zlib.crc32(i.tobytes()), i.tobytes()) for d, i in want)
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    write_token_files(df.limit(0), f"{path}-none")
    assert read_token_files(spark, f"{path}-none").collect() == []


def test_fast_encoders_equal_the_library():
    import random

    rng = random.Random(9)
    alphabet = "ab c'tsré<|>endoftext \n\t　\xa0.!1９ñß日Σ́İ"
    texts = ["", "a<|endoftext|>b <|startoftext|>", "É é Σ ΣΑΣ", "a" * 5000, "!" * 3000, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50))) for _ in range(800))]
    for t in texts:
        assert byte_ids(t).tolist() == library("byte_bpe_50k.json").encode(t, add_special_tokens=False).ids
        assert np.frombuffer(word_ids(t), "<u2").tolist() == library("word_bpe_49k.json").encode(t, add_special_tokens=False).ids
