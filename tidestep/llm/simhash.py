"""SimHash near-duplicates by multi-index hashing.

1. One pass over the texts gives a fingerprint per document (Arrow batches, numpy).
2. Equal fingerprints collapse: copies never meet again before the last join.
3. The bits are cut into segments with a radius each. If two fingerprints differ in at most
   ``distance`` bits, then by the pigeonhole principle some segment differs in at most its
   radius, because sum(radius + 1) > distance. Every fingerprint enters the table of each
   segment and also visits the values of a small Hamming ball around its segment: for radius
   1, of two values that differ in one bit only the one that has it set visits the other; for
   radius 2, both visit their neighbours and meet half-way. Segments widen with the number of
   fingerprints, so that a value's visitors stay few.
4. Fingerprints that meet under one (segment, value) are compared in full. Where very many
   meet, they are dealt to blocks and every two blocks meet on their own. Small meetings give
   their verified links; in large ones a search that never looks again at a found
   fingerprint gives a star for each component instead of all pairs.
5. Components are joined by distributed star steps (components.py).

``similar_links`` takes these links as its first candidates and finds the rest exactly, by the
prefix filter: of two sets of Jaccard 0.8 or more, the first fifth of each, in any one order of all
shingles, has a shingle in common. Frequent shingles come last in that order, and parity bitmaps,
which never differ in more bits than two sets do in shingles, rule out most pairs that meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.llm.common import HIDDEN, Scratch, join_facts, table, without
from tidestep.llm.components import components

Segments = tuple[tuple[int, int, int], ...]

DISTANCE = 4
SMALL = 16
#: Visitors from which a (segment, value) is split over several tasks.
HOT = 50_000
OUT = ("fingerprint", "component_id")
ROW = f"{HIDDEN}row"

#: Of the verified search: words of a shingle, words of 64 bits in the short and in the longest
#: parity bitmap, and the members of a meeting from which its pairs are looked at by member.
WIDTH, BITMAP, LONGEST, LARGE = 5, 16, 1024, 64
#: Documents whose shingles are counted, from how many of these a shingle is frequent, and how many
#: frequent shingles come last in the order. Any order gives the same links.
SAMPLED, OFTEN, MOST_FREQUENT = 16_384, 4, 100_000
#: Slots by which texts are left out before a join; they bound what is broadcast.
SLOTS = 1 << 22
#: Words whose hashes a worker remembers.
MOST_WORDS = 500_000


def cuts(n: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments for n fingerprints: three, or two once three would be narrower than log2(n)."""
    count = 3 if n <= 1 << (bits // 3) else 2
    edge = [-(-bits * k // count) for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def segments(n: int, distance: int) -> Segments:
    """The cuts with a radius each; the radii plus one sum to distance + 1, and none is above 2."""
    own = cuts(n)
    each, more = divmod(distance + 1, len(own))
    if each + (more > 0) > 3:
        raise ValueError(f"a distance of {distance} needs a radius above 2")
    return tuple((a, b, each + (k < more) - 1) for k, (a, b) in enumerate(own) if each + (k < more))


def _shingles(text: bytes, width: int, seed: int, block: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text in UTF-8, in blocks, repeats included."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, block):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + block], last[at : at + block], strict=True)], np.uint64)


def _majority(blocks: Iterator[np.ndarray]) -> int:
    """Bits that are set in over half of the numbers."""
    counts, n = np.zeros(64, np.int64), 0
    for h in blocks:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, width: int = 4, seed: int = 42, block: int = 1 << 16) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned integer; zero for a text without words."""
    return _majority(_shingles(text, width, seed, block))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """XXH64 of words, remembered; emptied when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


_HASHES = WordHashes()


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes of their words' hashes; fewer words than ``width`` are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(own) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(own))):
        total += own[k : k + n] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    return np.unique(_mixed(total))


def wide_fingerprint(shingles: np.ndarray, numbers: int = 4) -> list[int]:
    """Numbers of 64 bits for a set of shingles: of their hashes, and of these mixed anew."""
    out = []
    for _ in range(numbers):
        out.append(_majority(iter([shingles])))
        shingles = _mixed(shingles + np.uint64(0x9E3779B97F4A7C15))
    return out


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Words whose bits tell whether an odd number of a set's shingles falls on them; about as many bits as shingles."""
    words = BITMAP
    while words < LONGEST and 64 * words < len(shingles):
        words *= 2
    odd = np.bincount((shingles % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """A bitmap as it is with n words."""
    return np.bitwise_xor.reduce(words.reshape(-1, n), axis=0)


def prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which two sets of Jaccard 0.8 or more have one in common.

    The order: those that are not frequent by hash, then the frequent ones (sorted) by rank.
    Of fewer than four shingles only equal sets are similar, so they need none.
    """
    n = len(shingles)
    if n < 4:
        return shingles[:0]
    most = n - (4 * n + 4) // 5 + 1
    at = np.minimum(np.searchsorted(frequent, shingles), max(0, len(frequent) - 1))
    often = frequent[at] == shingles if len(frequent) else np.zeros(n, bool)
    rare = shingles[~often][:most]
    last = shingles[often][np.argsort(rank[at[often]])] if len(rare) < most else shingles[:0]
    return np.concatenate((rare, last[: most - len(rare)]))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return run


def ball(fp: np.ndarray, first: int, segs: Segments) -> Iterator[tuple[np.ndarray, np.ndarray | slice]]:
    """(keys, which of fp) of all tables that fingerprints enter or visit; tables are numbered from ``first``."""
    for k, (shift, bits, radius) in enumerate(segs, first):
        value = (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        base = np.uint64(k << 32)
        yield base | value, slice(None)
        for bit in range(bits if radius else 0):
            mask = np.uint64(1 << bit)
            who = slice(None) if radius == 2 else (value & mask) != 0
            yield base | (value[who] ^ mask), who


def _visits(segs: Segments):
    """Every (segment, value) that a fingerprint enters or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fp), 1 << 16):
                fp = all_fp[at : at + (1 << 16)]
                for keys, who in ball(fp, 0, segs):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[who].view(np.int64))], names=["key", "fp"])

    return run


def _links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u > v as signed numbers) that connect what is within the distance under one key; key is sorted."""
    if not len(key):
        return fp[:0], fp[:0]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((cut, [len(key)])))
    left, right = [fp[:0]], [fp[:0]]
    of = np.repeat(size, size)
    few = of <= SMALL
    k, f = key[few], fp[few]
    for step in range(1, min(SMALL, int(size.max()))):
        same = k[step:] == k[:-step]
        a, b = f[step:][same], f[:-step][same]
        near = np.bitwise_count(a ^ b) <= distance
        left.append(a[near])
        right.append(b[near])
    for at, n in zip(cut[size > SMALL], size[size > SMALL], strict=True):
        rest = np.unique(fp[at : at + n])
        while len(rest):
            root, todo, rest = rest[0], [rest[:1]], rest[1:]
            while todo and len(rest):
                for x in todo.pop():
                    near = np.bitwise_count(rest ^ x) <= distance
                    if near.any():
                        found, rest = rest[near], rest[~near]
                        todo.append(found)
                        left.append(found)
                        right.append(np.full(len(found), root, fp.dtype))
    a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
    u, v = np.maximum(a, b), np.minimum(a, b)
    both = np.unique(np.stack([u, v], axis=1)[u != v], axis=0)
    return both[:, 0], both[:, 1]


def whole_keys(out: Callable[..., Iterator[pa.RecordBatch]]):
    """Calls out(columns...) with whole keys, in order, of batches sorted by their first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last key so far may go on in the next batch
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(now[0]):
                continue
            if held and held[0][0][0] == now[0][-1]:
                held.append(now)
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            yield from out(*(np.concatenate(c) for c in zip(*held, [c[:last] for c in now], strict=True)))
            held = [[c[last:] for c in now]]
        if held:
            yield from out(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _meetings(distance: int):
    def out(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v = _links(key, fp.view(np.uint64), distance)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return whole_keys(out)


def split_hot(visits: DataFrame, hot: int, scratch: Scratch, of: str = "fp") -> DataFrame:
    """visits (key, ...) with the keys of more than ``hot`` visitors split: every two blocks of their visitors share a new key."""
    many = scratch.keep(visits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "hot")
    if not many.count():
        return visits
    blocks = F.ceil(F.col("n") / hot).cast("int")
    own = F.pmod(F.xxhash64(of), blocks).cast("int")
    # block b meets block c in the cell (min, max); a key that two cells share by chance only means a check in vain
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda c: F.xxhash64("key", F.least(own, c), F.greatest(own, c)))
    joined = visits.join(F.broadcast(many), "key", "left")  # fewer rows than visits / hot
    keys = F.when(F.col("n").isNull(), F.array("key")).otherwise(cells)
    return joined.select(F.explode(keys).alias("key"), *[c for c in visits.columns if c != "key"])


def by_key(visits: DataFrame) -> DataFrame:
    parts = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return visits.repartition(parts, "key").sortWithinPartitions("key")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """One row per row of df: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Lower-cases A-Z, takes words between ASCII white space and shingles of ``width`` words
    with repeats. A bit is 1 if set in over half the shingles' XXH64. Fingerprints are linked
    at ``distance`` or fewer differing bits; component_id is the smallest id reachable.

    Null, empty and all-space texts have fingerprint zero, linked like any other. Texts of
    fewer words than ``width`` have one shingle; texts of any length are read whole. Repeated
    rows stay repeated. Null ids are ignored by the minimum; a component of null ids only has
    component_id null. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = scratch.keep(slim.mapInArrow(_fingerprints(width), f"id {kind}, fp bigint"), "fingerprints")

    each = scratch.keep(docs.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    visits = each.select("fp").mapInArrow(_visits(segments(each.count(), distance)), "key bigint, fp bigint")
    visits = scratch.keep(visits, "visits")
    edges = by_key(split_hot(visits, hot, scratch)).mapInArrow(_meetings(distance), "u bigint, v bigint").distinct()
    roots = components(edges, scratch)
    scratch.drop(visits)
    rooted = scratch.keep(each.join(roots.withColumnRenamed("node", "fp"), "fp"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    moved = scratch.keep(join_facts(rooted.select("fp", "root"), least, "root"), "moved")
    each = each.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    out = join_facts(docs, scratch.keep(each, "facts"), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


BITS = [f"b{k}" for k in range(BITMAP)]
PAIRS = "u bigint, v bigint"


def _marks(frequent: np.ndarray, rank: np.ndarray):
    """(row, id, text) to (row, id, node, fp, size, b0, ..., map, keys): the hash of the set of shingles, its fingerprint, size, short and long bitmap and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, maps, keys = [], [], []
            for t in batch.column(2).cast(pa.binary()):
                s = shingle_set(t.as_py() or b"")
                out.append((xxhash.xxh64_intdigest(s.tobytes()), *wide_fingerprint(s, 1), len(s), *folded(bitmap(s), BITMAP).tolist()))
                maps.append(bitmap(s).tobytes())
                keys.append(prefix(s, frequent, rank).view(np.int64))
            columns = np.array(out, np.uint64).reshape(-1, 3 + BITMAP).view(np.int64)
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys], dtype=np.int64))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            numbers = [pa.array(np.ascontiguousarray(columns[:, k])) for k in range(3 + BITMAP)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, pa.array(maps, pa.binary()), lists], names=["row", "id", "node", "fp", "size", *BITS, "map", "keys"])

    return run


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of about SAMPLED documents have, sorted, and the place of each among them, the rarest first."""
    one_in = max(1, docs.count() // SAMPLED)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select(F.col("row").alias("node"), F.col("text").cast("string").alias("text"))
    counted = some.mapInArrow(_sets, "node bigint, s array<bigint>").select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).collect()
    found = np.array([r.s for r in rows], np.int64).view(np.uint64)
    by = np.argsort(found)
    return found[by], -by


def _several(key: np.ndarray, node: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose key is not alone."""
    same = key[1:] == key[:-1]
    hit = np.concatenate((same, [False])) | np.concatenate(([False], same))
    yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(node[hit]), pa.array(place[hit])], names=["key", "node", "place"])


def _near(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets with bitmaps a and b and sizes m and n may have Jaccard 0.8 or more; never false where they have."""
    fit = 4 * np.maximum(m, n) <= 5 * np.minimum(m, n)
    return fit & (9 * np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64) <= m + n)


def _in_reach(i: np.ndarray, j: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets of sizes m and n may be similar if the shingle at places i and j is the first that they share.

    At the first one that similar sets share this holds, so they are found there.
    """
    return 9 * np.minimum(m - i, n - j) >= 4 * (m + n)


def _met(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    both = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1)[u != v], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], names=["u", "v"])


def _grouped(key: np.ndarray, node: np.ndarray, columns: tuple[np.ndarray, ...]):
    """The columns sorted by key and node, the start of each key, and how many rows it has."""
    by = np.lexsort((node, key))
    key = key[by]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key, node[by], [c[by] for c in columns], cut, np.diff(np.concatenate((cut, [len(key)])))


def _steps(key: np.ndarray, most: int, left: list[np.ndarray], right: list[np.ndarray], node: np.ndarray, fits: Callable[..., np.ndarray]) -> None:
    """All pairs of one key that fit, by their distance in the order; no key has more than ``most`` rows."""
    for step in range(1, min(most, len(key))):
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        same = same[fits(same + step, same)]
        left.append(node[same + step])
        right.append(node[same])


def _first_round(key: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray, *bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of each meeting that may be similar: with its least node, and of those left over with one another; in large ones only until each is found once."""
    key, node, (m, p, *words), cut, count = _grouped(key, node, (size, place, *bits))
    w = np.stack(words, axis=1)
    least = np.repeat(cut, count)
    hit = _near(w, w[least], m, m[least])
    left, right = [node[hit]], [node[least[hit]]]
    rest = np.flatnonzero(~hit)
    large = np.repeat(count, count)[rest] > LARGE
    few = rest[~large]
    _steps(key[few], LARGE, left, right, node[few], lambda i, j: _in_reach(p[few[i]], p[few[j]], m[few[i]], m[few[j]]) & _near(w[few[i]], w[few[j]], m[few[i]], m[few[j]]))
    many = rest[large]
    for todo in np.split(many, np.flatnonzero(key[many][1:] != key[many][:-1]) + 1) if len(many) else ():
        queue: list[int] = []
        while len(todo):
            if queue:
                x = queue.pop()
            else:
                x, todo = todo[0], todo[1:]
            near = _near(w[todo], w[x], m[todo], m[x])
            if near.any():
                found, todo = todo[near], todo[~near]
                left.append(node[found])
                right.append(np.full(len(found), node[x]))
                queue.extend(found)
    yield _met(left, right)


def _second_round(key: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray, root: np.ndarray, *bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All pairs of each meeting that may be similar and are not connected yet."""
    key, node, (m, p, r, *words), cut, count = _grouped(key, node, (size, place, root, *bits))
    w = np.stack(words, axis=1)
    mixed = np.repeat(np.logical_or.reduceat(r != np.repeat(r[cut], count), cut), count) if len(key) else np.zeros(0, bool)
    large = np.repeat(count, count) > LARGE
    few = np.flatnonzero(mixed & ~large)
    left, right = [], []
    _steps(key[few], LARGE, left, right, node[few], lambda i, j: (r[few[i]] != r[few[j]]) & _in_reach(p[few[i]], p[few[j]], m[few[i]], m[few[j]]) & _near(w[few[i]], w[few[j]], m[few[i]], m[few[j]]))
    for at, n in zip(cut, count, strict=True):
        if n <= LARGE or not mixed[at]:
            continue
        own = slice(at, at + n)
        names, klass, sizes = np.unique(r[own], return_inverse=True, return_counts=True)
        for i in at + np.flatnonzero(klass != sizes.argmax()):  # no pair is of the largest class alone
            hit = np.flatnonzero((r[own] != r[i]) & _in_reach(p[own], p[i], m[own], m[i]) & _near(w[own], w[i], m[own], m[i]))
            left.append(node[at + hit])
            right.append(np.full(len(hit), node[i]))
    yield _met(left, right)


def dealt_once(visits: DataFrame, hot: int, scratch: Scratch, of: str = "node") -> DataFrame:
    """visits (key, ...) with the keys of more than ``hot`` visitors dealt to blocks, each of which also gets the key's least visitor; their rows stay in proportion."""
    counted = visits.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(of).alias("least"))
    many = scratch.keep(counted.where(F.col("n") > hot), "hot")
    if many.isEmpty():
        return visits
    blocks = F.ceil(F.col("n") / hot).cast("int")
    every = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.xxhash64("key", b))
    own = F.array(F.xxhash64("key", F.pmod(F.xxhash64(of), blocks).cast("int")))
    keys = F.when(F.col("n").isNull(), F.array("key")).when(F.col(of) == F.col("least"), every).otherwise(own)
    joined = visits.join(F.broadcast(many), "key", "left")  # fewer rows than visits / hot
    return joined.select(F.explode(keys).alias("key"), *[c for c in visits.columns if c != "key"])


def dealt_by_root(visits: DataFrame, hot: int, scratch: Scratch) -> DataFrame:
    """visits (key, node, root, ...) with the keys of more than ``hot`` visitors split, so that every two of different roots meet.

    Only those outside a key's largest class are repeated, for each block of that class and of their own.
    """
    counted = visits.groupBy("key", "root").agg(F.count(F.lit(1)).alias("t")).groupBy("key").agg(F.sum("t").alias("n"), F.max(F.struct("t", F.col("root").alias("top"))).alias("most"))
    many = scratch.keep(counted.where(F.col("n") > hot).select("key", "n", "most.t", "most.top"), "hot")
    if many.isEmpty():
        return visits
    tops, others = F.ceil(F.col("t") / hot).cast("int"), F.ceil((F.col("n") - F.col("t")) / hot).cast("int")
    place = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    upto = lambda blocks: F.sequence(F.lit(0), blocks - 1)
    with_others = F.transform(upto(others), lambda b: F.xxhash64("key", F.lit(-1), b, place(tops)))
    with_tops = F.transform(upto(tops), lambda b: F.xxhash64("key", F.lit(-1), place(others), b))
    with_own = F.transform(upto(others), lambda b: F.xxhash64("key", F.least(place(others), b), F.greatest(place(others), b)))
    keys = F.when(F.col("n").isNull(), F.array("key")).when(F.col("root") == F.col("top"), with_others).otherwise(F.concat(with_tops, with_own))
    # a key of one class has nothing left to connect
    joined = visits.join(F.broadcast(many), "key", "left").where("n is null or n > t")
    return joined.select(F.explode(keys).alias("key"), *[c for c in visits.columns if c != "key"])


def salted_join(pairs: DataFrame, facts: DataFrame, key: str, other: str, parts: int = 1024, least: int = 200, salts: int = 8) -> DataFrame:
    """pairs joined with facts, which have one row for a key.

    A key that holds more than 1/parts of the pairs, and more than ``least``, is spread over
    ``salts`` by the other column; its facts go as often, so few keys should.
    """
    heavy = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(pairs.count() / parts, least)).select(key)  # fewer than ``parts`` rows
    salt = F.pmod(F.xxhash64(other), F.lit(salts)).cast("int")
    hot = pairs.join(F.broadcast(heavy), key, "left_semi").withColumn("salt", salt)
    hot_facts = facts.join(F.broadcast(heavy), key, "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    light = pairs.join(F.broadcast(heavy), key, "left_anti").join(facts, key)
    return light.unionByName(hot.join(hot_facts, [key, "salt"]).drop("salt"))


def both_ends(pairs: DataFrame, facts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """A written table on the way, and pairs (u, v) with the facts (node, ...) of u and, with a 2 in their names, of v."""
    half = scratch.keep(salted_join(pairs, facts.withColumnRenamed("node", "u"), "u", "v"), "half")
    second = facts.select(F.col("node").alias("v"), *[F.col(c).alias(f"{c}2") for c in facts.columns if c != "node"])
    return half, salted_join(half, second, "v", "u")


def _may_be_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (u, v, size, map, size2, map2) the pairs that their long bitmaps don't rule out."""
    for batch in batches:
        hit = []
        for m, x, n, y in zip(*(batch.column(c).to_pylist() for c in ("size", "map", "size2", "map2")), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            words = min(len(x), len(y))
            hit.append(bool(_near(folded(x, words), folded(y, words), m, n)))
        yield batch.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))


def similar(a: Column, b: Column, overlap: Column) -> Column:
    """Whether sets of sizes a and b with this overlap have Jaccard 0.8 or more."""
    return 9 * overlap >= 4 * (a + b)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, t in enumerate(batch.column(1).cast(pa.binary())):  # a row at a time: a set can be long
            s = shingle_set(t.as_py() or b"").view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s))], names=["node", "s"])


def similar_links(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Of a written table docs (row, id, text): nodes (node, first: the least (id is null, id, row) that has this set of shingles) and links (u, v), u > v.

    Linked nodes have Jaccard 0.8 or more, compared in full, and the links connect what all such
    pairs connect, without being all pairs. First come the links of SimHash at DISTANCE and, of
    those that meet under a shingle of their prefixes, enough to connect them; then all pairs that
    meet and are not connected by then. Bitmaps rule out only pairs that cannot be similar, so no
    size of the table and no order of the shingles changes what is connected.
    """
    kind = docs.schema["id"].dataType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in ("node", "fp", "size", *BITS))
    texts = docs.select("row", "id", F.col("text").cast("string").alias("text"))
    marked = scratch.keep(texts.mapInArrow(_marks(*frequent_shingles(docs)), f"row bigint, id {kind}, {numbers}, map binary, keys array<bigint>"), "marked")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = scratch.keep(marked.groupBy("node").agg(first, F.min("fp").alias("fp")), "nodes")
    later = scratch.keep(marked.select("row").join(nodes.select("first.row"), "row", "left_anti"), "later")
    each = marked.join(later, "row", "left_anti")  # one row a node

    # SimHash: links between fingerprints become links between the least nodes that have them
    prints = scratch.keep(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    visits = scratch.keep(prints.select("fp").mapInArrow(_visits(segments(prints.count(), DISTANCE)), "key bigint, fp bigint"), "visits")
    near = scratch.keep(by_key(dealt_once(visits, hot, scratch, "fp")).mapInArrow(_meetings(DISTANCE), PAIRS).distinct(), "near")
    scratch.drop(visits)
    of = lambda end: prints.select(F.col("fp").alias(end), F.col("least").alias(f"n{end}"))
    hashed = near.join(of("u"), "u").join(of("v"), "v").select(F.greatest("nu", "nv").alias("u"), F.least("nu", "nv").alias("v"))
    equal = join_facts(nodes.select("node", "fp"), prints, "fp").where("node != least").select(F.col("node").alias("u"), F.col("least").alias("v"))

    maps = scratch.keep(each.select("node", "size", "map"), "maps")
    # the prefixes: of each node the keys that it shares
    shared = by_key(each.select(F.posexplode("keys").alias("place", "key"), "node").select("key", "node", F.col("place").cast("bigint"))).mapInArrow(whole_keys(_several), "key bigint, node bigint, place bigint")
    keys = scratch.keep(shared.groupBy("node").agg(F.collect_list(F.struct("key", "place")).alias("keys")), "keys")
    shared = scratch.keep(keys.join(each.select("node", "size", *BITS), "node"), "shared")
    scratch.drop(keys)
    scratch.drop(marked)

    def meeting(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(F.explode("keys").alias("k"), "node", "size", *more, *BITS).select("k.key", "node", "size", "k.place", *more, *BITS)

    def verified(pairs: DataFrame) -> DataFrame:
        half, both = both_ends(pairs, maps, scratch)
        near = scratch.keep(both.mapInArrow(_may_be_similar, PAIRS), "near")
        scratch.drop(half)
        ends = near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))).distinct()
        wanted = scratch.keep(nodes.join(ends, "node").select("node", F.col("first.row").alias("row")), "wanted")
        # texts of no slot of a wanted row stay out of the join
        slot = F.pmod(F.xxhash64("row"), F.lit(SLOTS)).cast("int").alias("slot")
        some = docs.select("row", F.col("text").cast("string").alias("text"), slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi")
        sets = scratch.keep(some.join(wanted, "row").select("node", "text").mapInArrow(_sets, "node bigint, s array<bigint>"), "sets")
        half, both = both_ends(near, sets, scratch)
        links = scratch.keep(both.where(similar(F.size("s"), F.size("s2"), F.size(F.array_intersect("s", "s2")))).select("u", "v"), "links")
        for done in (half, sets, wanted, near):
            scratch.drop(done)
        return links

    met = by_key(dealt_once(meeting(shared), hot, scratch)).mapInArrow(whole_keys(_first_round), PAIRS)
    pairs = scratch.keep(hashed.unionByName(equal).unionByName(met).distinct(), "pairs")
    links = verified(pairs)
    # only what is not yet connected is looked at again
    roots = scratch.keep(components(links, scratch), "roots")
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = by_key(dealt_by_root(meeting(rooted, "root"), hot, scratch)).mapInArrow(whole_keys(_second_round), PAIRS).distinct()
    more = scratch.keep(more.join(pairs, ["u", "v"], "left_anti"), "more")
    if not more.isEmpty():
        links = links.unionByName(verified(more))
    return nodes.select("node", "first"), links


def one_of_each_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs with one row of each component of similar texts: that with the smallest id.

    Texts are similar if their sets of five-word shingles (words and case as in
    ``simhash_groups``) have Jaccard 0.8 or more; no such pair is missed (``similar_links``).

    Columns and texts are those of docs. Texts of fewer than five words are one shingle. Null,
    empty and all-space texts have no shingles and are one component. Texts of any length are
    compared whole. Null ids come last, then row order decides; of repeated rows one stays.
    An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    kept = scratch.keep(without(docs).withColumn(ROW, F.monotonically_increasing_id()), "rows")
    slim = kept.select(F.col(ROW).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    nodes, links = similar_links(slim, scratch, hot)
    roots = components(links, scratch)
    grouped = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("b"))
    stay = grouped.select(F.col("b.row").alias(ROW))
    gone = scratch.keep(kept.select(ROW).join(stay, ROW, "left_anti"), "gone")  # its size is known, so Spark broadcasts it only if small
    return kept.join(gone, ROW, "left_anti").drop(ROW)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", *OUT)
