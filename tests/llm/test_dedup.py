import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm.util import odd_documents, prose
from tidestep.llm.common import Scratch, join_facts, recording, without
from tidestep.llm.components import components
from tidestep.llm.exact_dedup import exact_dedup, one_of_each_text
from tidestep.llm.simhash import _links, fingerprint, simhash_groups


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_against_brute_force(spark):
    df = odd_documents(spark)
    groups = defaultdict(list)
    for r in df.collect():
        groups[normal(r.text)].append(r)
    for counters in (1024, 8):  # with and without heavy hitters
        out = exact_dedup(df, counters=counters)
        got = out.collect()
        assert len(got) == df.count() and {"text", "source", "n_chars", "Score"} <= set(out.columns)
        kept = defaultdict(int)
        for r in got:
            own = groups[normal(r.text)]
            ids = [x.doc_id for x in own if x.doc_id is not None]
            assert r.group_size == len(own) and r.keep_id == (min(ids) if ids else None)
            assert r.text_sha256 == hashlib.sha256(normal(r.text).encode()).hexdigest()
            kept[normal(r.text)] += r.kept
            assert not r.kept or r.doc_id == r.keep_id
        assert set(kept.values()) == {1} and len(kept) == len(groups)
    one = one_of_each_text(df)
    assert one.columns == df.columns
    assert sorted((normal(r.text), str(r.doc_id)) for r in one.collect()) == sorted((t, str(min((x.doc_id for x in g if x.doc_id is not None), default=None))) for t, g in groups.items())
    assert one_of_each_text(df.limit(0)).collect() == []


def test_internal_names_are_an_error_and_scratch_goes(spark):
    with pytest.raises(ValueError, match="__td_x"):
        without(spark.range(1).withColumn("__td_x", F.lit(1)))
    with recording() as made:
        scratch = Scratch(spark, "test")
    kept = scratch.keep(spark.range(5))
    path = scratch.paths[id(kept)].removeprefix("file://")
    assert made == [scratch] and os.path.isdir(path)
    scratch.drop()
    assert not os.path.isdir(path)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_facts_splits_hot_keys(spark, how):
    rows = spark.range(900).selectExpr("id", "if(id % 3 = 0, -1, id) as k")
    facts = spark.range(-1, 500).selectExpr("id as k", "id * 2 as f")
    got = sorted(map(tuple, join_facts(rows, facts, "k", how, parts=10).select("id", "k", "f").collect()), key=str)
    assert got == sorted(map(tuple, rows.join(facts, "k", how).select("id", "k", "f").collect()), key=str)


def test_exact_hot_group_and_empty_table(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 1, 'hot', concat('t', id)) as text")
    got = exact_dedup(df, carry=False).where("text_sha256 = sha2('hot', 256)").selectExpr("min(keep_id)", "max(keep_id)", "max(group_size)", "sum(int(kept))").first()
    assert tuple(got) == (1, 1, 1000, 1)
    assert exact_dedup(df.limit(0)).collect() == []


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_fingerprint(block):
    rng = random.Random(2)
    for text in ["", " ", "a", "A b", "a b c d", "É A", *(prose(rng, n) for n in (4, 5, 50))]:
        assert fingerprint(text.encode(), block=block) == slow_fingerprint(text)


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [50_000, 2])
def test_simhash_against_brute_force(spark, hot):
    df = odd_documents(spark)
    rows = df.collect()
    got = simhash_groups(df, hot=hot).collect()
    assert len(got) == len(rows)
    fps = {k: slow_fingerprint(r.text) for k, r in enumerate(rows)}
    of = brute_components(fps)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[of[k]].append(r.doc_id)
    want = sorted((str(r.doc_id), f"{fps[k]:016x}", str(min(least[of[k]], default=None))) for k, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash_groups(df.limit(0)).collect() == []


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6).astype(np.uint64)
    key, fp = [], []
    for k, b in enumerate(base):
        for _ in range(3 if k < 3 else 60):  # small and large meetings
            x = b
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= np.uint64(1) << np.uint64(bit)
            key.append(k)
            fp.append(x)
    fp = np.unique(np.array(fp, np.uint64))
    near = lambda x: min(range(len(base)), key=lambda k: (int(x) ^ int(base[k])).bit_count())
    key = np.array([near(x) for x in fp])
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    u, v = _links(key, fp, 4)
    pairs = [(int(a), int(b)) for a, b in zip(u.view(np.uint64), v.view(np.uint64), strict=True)]
    want = brute_components({int(x): int(x) for x in fp})
    root = {int(x): int(x) for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    groups = lambda f: {frozenset(x for x in root if f(x) == f(y)) for y in root}
    assert groups(find) == groups(lambda x: want[x])
    assert len(pairs) < 10 * len(fp)


def test_components_of_a_chain_a_star_and_an_empty_table(spark):
    chain = [(i + 1, i) for i in range(40)]
    star = [(1000 + i, 100) for i in range(50)]
    edges = spark.createDataFrame(chain + star, "u bigint, v bigint")
    got = {r.node: r.root for r in components(edges, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {1000 + i: 100 for i in range(50)}
    assert components(edges.limit(0), Scratch(spark, "test")).collect() == []
