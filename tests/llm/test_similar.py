import random

import numpy as np
import pytest

from llm.test_dedup import normal
from llm.util import odd_documents
from tidestep.llm import simhash
from tidestep.llm.common import Scratch
from tidestep.llm.simhash import one_of_each_similar, segments, shingle_set, similar_links, wide_fingerprint


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in normal(text)).split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def edited(rng, n=60):
    """Texts with one to three changed words, some around 0.8, with a line that many share."""
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 40, 90]))]
        base += "one line that very many of the texts have in common".split() * rng.choice([0, 1])
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.choice([0, 1, 2, 3])):
                copy[at] = rng.choice(words).upper()
            out.append(" ".join(copy))
    return out


def family(rng, n=150):
    """One text of 120 words and copies of it that each change a few words."""
    base = [f"v{k}" for k in range(120)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 4])):
            copy[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def brute(sets):
    return {(a, b) for i, a in enumerate(sets) for b in sets[:i] if a and b and 5 * len(a & b) >= 4 * len(a | b)}


def components(sets, pairs):
    near = {s: {s} for s in sets}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out, seen = [], set()
    for s in sets:
        group, todo = set(), [s]
        while todo and s not in seen:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        seen |= group
        out += [group] if group else []
    return out


@pytest.mark.parametrize(("large", "hot"), [(64, 50_000), (4, 50_000), (64, 40)])
def test_links_against_brute_force(spark, monkeypatch, large, hot):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(4)
    texts = [*edited(rng), *family(rng), *(r.text for r in odd_documents(spark).select("text").collect())]
    scratch = Scratch(spark, "test")
    docs = scratch.keep(spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row bigint, id bigint, text string"))
    nodes, links = similar_links(docs, scratch, hot)
    first = {r.node: r["first"].row for r in nodes.collect()}
    sets = list(dict.fromkeys(map(shingles, texts)))
    assert len(first) == len(sets)
    got = {frozenset((shingles(texts[first[r.u]]), shingles(texts[first[r.v]]))) for r in links.collect()}
    want = {frozenset(p) for p in brute(sets)}
    assert got <= want and len(want) > 500  # nothing below 0.8
    # links connect what all pairs connect, without being all pairs
    mine, all_ = components(sets, map(tuple, got)), components(sets, map(tuple, want))
    assert len(mine) - len(all_) <= 0.05 * (len(sets) - len(all_)) and max(map(len, mine)) == max(map(len, all_))


def kept_components(spark, texts, **more):
    """The components of the sets of shingles that the links make, and those of all similar pairs."""
    scratch = Scratch(spark, "test")
    docs = scratch.keep(spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row bigint, id bigint, text string"))
    nodes, links = similar_links(docs, scratch, **more)
    first = {r.node: r["first"].row for r in nodes.collect()}
    pairs = [(shingles(texts[first[r.u]]), shingles(texts[first[r.v]])) for r in links.collect()]
    sets = list(dict.fromkeys(map(shingles, texts)))
    return {frozenset(g) for g in components(sets, pairs)}, {frozenset(g) for g in components(sets, brute(sets))}


@pytest.mark.parametrize(("halves", "large", "hot"), [(False, 64, 50_000), (True, 64, 50_000), (False, 4, 20)])
def test_no_similar_pair_is_lost_whatever_the_size(spark, monkeypatch, halves, large, hot):
    """Pairs at 0.8, with the segments of few and of many fingerprints, and with split meetings."""
    if halves:
        monkeypatch.setattr(simhash, "cuts", lambda n, bits=64: [(0, bits // 2), (bits // 2, bits // 2)])
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "OFTEN", 3)
    rng, texts = random.Random(8), []
    for k in range(80):
        # 9 a shingles, of which another end of a words takes a: 8 a of 10 a in common
        at = rng.choice([1, 2, 5, 10])
        base = [f"p{k}q{j}" for j in range(9 * at + 4)]
        texts += [" ".join(base), " ".join([*base[: len(base) - at], *(f"r{k}s{j}" for j in range(at))]), " ".join([*base[:-at], *(f"t{k}u{j}" for j in range(at))])]
    texts += [*family(rng, 60), *edited(rng, 30)]
    got, want = kept_components(spark, texts, hot=hot)
    assert got == want and sum(len(g) > 1 for g in want) > 60


def test_candidates_of_a_large_family_stay_in_proportion(spark, monkeypatch):
    compared, join = [], simhash.salted_join
    monkeypatch.setattr(simhash, "salted_join", lambda pairs, *a, **k: (compared.append(((*a[1:], "s" in a[0].columns), pairs.count())), join(pairs, *a, **k))[1])
    texts = family(random.Random(3), 900)
    got, want = kept_components(spark, texts)
    assert got == want
    assert sum(n for ends, n in compared if ends == ("u", "v", True)) <= 8 * len(set(texts))


def test_segments_cover_the_distance():
    for n in (1, 10**6, 2**21, 2**22, 10**10):
        for distance in (2, 3, 4, 5):
            s = segments(n, distance)
            assert sum(r + 1 for _, _, r in s) == distance + 1 and all(0 <= r <= 2 for _, _, r in s)
            assert all(a + b <= 64 for a, b, _ in s)
    assert segments(2**21, 4) == ((0, 22, 1), (22, 21, 1), (43, 21, 0)) and len(segments(2**22, 4)) == 2
    with pytest.raises(ValueError):
        segments(2**40, 6)


@pytest.mark.parametrize("radii", [(1, 1, 0), (2, 1), (2, 2, 2)])
def test_balls_meet_within_the_radius(radii):
    rng, at, segs = random.Random(2), 0, []
    for r in radii:
        segs.append((at, 64 // len(radii), r))
        at += 64 // len(radii)
    for _ in range(60):
        a = rng.getrandbits(64)
        k = rng.randrange(len(segs))
        b = a
        for bit in rng.sample(range(segs[k][1]), segs[k][2]):
            b ^= 1 << (segs[k][0] + bit)
        for j, s in enumerate(segs):
            if j != k:
                b ^= rng.getrandbits(s[1]) << s[0]
        fp = np.array([a, b], np.uint64)
        seen = [set(), set()]
        for keys, who in simhash.ball(fp, 0, tuple(segs)):
            for x, i in zip(keys.tolist(), np.arange(2)[who].tolist(), strict=True):
                seen[i].add(x)
        assert seen[0] & seen[1]


def test_wide_fingerprints_of_like_sets_are_near():
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    copy = [*base[:100], "new", *base[101:]]
    a, b = (wide_fingerprint(shingle_set(" ".join(w).encode())) for w in (base, copy))
    apart = [(x ^ y).bit_count() for x, y in zip(a, b, strict=True)]
    assert len(apart) == 4 and 0 < sum(apart) < 40
    assert wide_fingerprint(shingle_set(b"")) == [0] * 4
    assert len(shingle_set(b"a b")) == len(shingle_set(b"A  b C d e")) == 1 and len(shingle_set(b"a " * 9)) == 1


def test_odd_rows_and_empty_table(spark):
    df = spark.createDataFrame([(2, "a b", 1), (1, "A  b", 1), (None, "a b", 1), (3, None, 1), (4, "", 1), (5, " ", 1), (6, "a b c", 1), (6, "a b c", 1)], "doc_id bigint, text string, component_id int")
    out = one_of_each_similar(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 6]
    assert one_of_each_similar(df.limit(0)).collect() == []
