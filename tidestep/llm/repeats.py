"""Removal of repeated byte strings across documents, exactly, by suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document of
smaller id. Sorting every suffix of the corpus in one order would move it many times over, so
what can be equal is brought together first, by anchors: of the GRAM-byte grams in a window of
``length`` bytes, the one of least hash, the leftmost if tied. Equal windows have equal anchors
at equal places, and neighbouring windows share theirs: about one position in eighteen is an
anchor.

1. Documents are packed into blocks, written once with the places of their anchors (two bytes each).
2. Each block tells each part of the hash space which anchor hashes it has (four bytes each);
   the part answers with a bit for each that occurs in more than one document.
3. For those anchors, a block sends the context (all windows that the anchor stands for, at
   most 2 * length bytes) with the least and greatest id that has it, once however often it occurs.
4. A part sorts the suffixes of all its distinct contexts by the two-stage method
   (suffixes.py), as far as ``length`` bytes and only those that windows need; neighbours in that
   order with a common prefix of ``length`` bytes are equal windows, whose least id is what counts.
5. The block gets back, for each context, the runs of windows and the least id, marks the
   bytes of documents with a greater id, and cuts them.

Messages go from each block to each part and back; with their number, which grows with the square
of the text, only their fixed cost grows, so blocks are large and a message costs little.

No decision is made on hashes: windows are equal if the sorted order's common prefixes say so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.llm.common import Scratch, table
from tidestep.llm.suffixes import shares, suffix_array

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 1 << 24
PART_BYTES = 1 << 22
#: Grams hashed at once, so that the arrays stay in the cache, and context rows compared at once.
GRAMS, ROWS = 1 << 15, 1 << 17
#: Bytes of text for each task at most.
TASK_BYTES = 1 << 26
OUT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
NONE = np.iinfo(np.int64).min  # the id of a document without id

BLOCKS = "block bigint, ids binary, sizes binary, anchors binary, text binary"
ANCHORS = "part bigint, block bigint, hashes binary, twice binary"
REPEATED = "block bigint, part bigint, bits binary"
CONTEXTS = "part bigint, block bigint, n bigint, body binary"
MARKS = "block bigint, n bigint, body binary"


_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeeze(*arrays: np.ndarray) -> bytes:
    return _zip.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _arrays(body: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    raw, out, at = _unzip.decompress(body), [], 0
    for kind, n in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def pack_block(held: list[tuple[int, bytes]], length: int) -> tuple[bytes, bytes, bytes, bytes]:
    """ids, sizes, anchors and text of a block of documents."""
    ids, sizes = np.array([i for i, _ in held], "<i8"), np.array([len(t) for _, t in held], "<i8")
    text = b"".join(t for _, t in held)
    return ids.tobytes(), sizes.tobytes(), _squeeze(*find_anchors(ids, sizes, text, length)), _zip.compress(text)


def _pack(most: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size = number = part = 0

        def out() -> pa.RecordBatch:
            return _batch(BLOCKS, [((part << 32) + number, *pack_block(held, length))])

        for b in batches:
            texts = b.column(2).cast(pa.binary())
            for p, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
                t, part = t.as_py() or b"", p
                if held and size + len(t) > most:
                    yield out()
                    held, size, number = [], 0, number + 1
                held.append((NONE if i is None else i, t))
                size += len(t)
        if held:
            yield out()

    return run


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the GRAM bytes at each position, by doubling; 32 bits are multiplied and compared many at once."""
    h, width = buf.astype(np.uint32) + np.uint32(1), 1
    factor = 0x9E3779B1
    while width < GRAM:
        more = h[:-width] * np.uint32(factor)
        more += h[width:]
        h, width, factor = more, 2 * width, factor * factor & 0xFFFFFFFF
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h


def _spans(ids: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each document begins and how many windows it has."""
    return np.cumsum(sizes) - sizes, np.where(ids == NONE, 0, np.maximum(sizes - length + 1, 0))


def find_anchors(ids: np.ndarray, sizes: np.ndarray, text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor in turn, the number of windows that it stands for and its distance from the first of them."""
    buf, grams = np.frombuffer(text, np.uint8), length - GRAM + 1
    if len(buf) < length:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    ahead = np.zeros(len(buf) - length + 1, np.uint8)
    for k in range(0, len(ahead), GRAMS):
        h = gram_hashes(buf[k : k + GRAMS + length - 1])
        # 13 bits of the hash, then the place: of equal ones the leftmost is least
        least = (h >> np.uint32(19) << np.uint32(16)) | np.arange(len(h), dtype=np.uint32)
        width = 1
        while width < grams:
            step = min(width, grams - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        place = (least & np.uint32(0xFFFF)).astype(np.int32)
        ahead[k : k + GRAMS] = place - np.arange(len(place), dtype=np.int32)
    begin, windows = _spans(ids, sizes, length)
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[begin[windows > 0]] = 1
    edge[(begin + windows)[windows > 0]] = -1
    inside = np.cumsum(edge[: len(ahead)], dtype=np.int8).astype(bool)
    # neighbours in one document whose anchor is the same are one run; between documents there are no windows
    on = np.zeros(len(ahead) + 1, bool)
    on[1:-1] = inside[1:] & inside[:-1] & (ahead[1:] + np.uint8(1) == ahead[:-1])
    first, last = np.flatnonzero(inside & ~on[:-1]), np.flatnonzero(inside & ~on[1:])
    return (last - first + 1).astype(np.uint8), ahead[first]


class Block:
    """A block's documents and anchors: for each anchor its hash, document id, first window and number of windows."""

    def __init__(self, ids: bytes, sizes: bytes, anchors: bytes, text: bytes, length: int):
        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        self.text = _unzip.decompress(text)
        self.buf = np.frombuffer(self.text, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.count, ahead = np.frombuffer(_unzip.decompress(anchors), np.uint8).reshape(2, -1)
        begin, windows = _spans(self.ids, self.sizes, length)
        before = np.cumsum(windows)
        window = np.cumsum(self.count, dtype=np.int64) - self.count
        doc = np.searchsorted(before, window, side="right")
        self.doc = self.ids[doc]
        self.first = window + (begin - before + windows)[doc]
        self.anchor = self.first + ahead
        self.hash = self._hash() if len(self.first) else np.zeros(0, np.uint64)

    def _hash(self) -> np.ndarray:
        """A hash of the GRAM bytes of each anchor, whose high bits choose the part."""
        views = np.ndarray((len(self.buf) - 7,), "<u8", self.text, strides=(1,))
        h = np.zeros(len(self.anchor), np.uint64)
        for k in range(0, GRAM, 8):
            h ^= views[self.anchor + k]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return h

    def by_hash(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors in the order of their hashes, where each distinct hash begins there, and which distinct hash is the first of each part."""
        by = np.argsort(self.hash)
        h = self.hash[by]
        cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        part = (h[cut] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        return by, cut, np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))

    def contexts(self, some: np.ndarray, length: int) -> np.ndarray:
        """Fixed-width rows of the contexts of some anchors: two lengths, then the bytes, zero after the end."""
        wide = 2 * length
        rows = np.zeros((len(some), wide + 2), np.uint8)
        rows[:, 0], rows[:, 1] = self.count[some], self.anchor[some] - self.first[some]
        first, edge = self.first[some], max(0, len(self.buf) - wide)
        for own, text, at in ((first < edge, self.text, 0), (first >= edge, self.text[edge:] + bytes(wide), edge)):  # the last rows may reach beyond the text
            views = np.ndarray((max(0, len(text) - wide + 1),), f"V{wide}", text, strides=(1,))
            rows[own, 2:] = views[first[own] - at].view(np.uint8).reshape(-1, wide)
        rows[:, 2:] *= np.arange(wide, dtype=np.uint8) < rows[:, :1] + np.uint8(length - 1)
        return rows


def _equal_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index of each distinct row, and the number of each row's class.

    Rows are ordered by a hash and neighbours of one hash compared in full; if such differ, the rows themselves are sorted.
    """
    words = np.zeros((len(rows), -(-rows.shape[1] // 8)), np.uint64)
    words.view(np.uint8)[:, : rows.shape[1]] = rows
    h = row_hashes(words)
    by = np.argsort(h)
    h = h[by]
    same = np.flatnonzero(h[1:] == h[:-1])
    if not all(np.array_equal(words[by[k]], words[by[k + 1]]) for k in np.array_split(same, len(same) // ROWS + 1)):
        view = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
        _, first, number = np.unique(view, return_index=True, return_inverse=True)
        return first, number.ravel()
    new = np.ones(len(rows), bool)
    new[same + 1] = False
    number = np.empty(len(rows), np.int64)
    number[by] = np.cumsum(new) - 1
    return by[new], number


def row_hashes(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of numbers."""
    h = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        h ^= words[:, k]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _equal_contexts(x: Block, some: np.ndarray, length: int, rows: np.ndarray | None = None) -> np.ndarray:
    """The number of each context's class, for anchors in the order of their hashes: only those of one hash can be equal."""
    h = x.hash[some]
    same = h[1:] == h[:-1]
    twin = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))
    number = np.arange(len(some))
    if len(twin):
        first, own = _equal_rows(x.contexts(some[twin], length) if rows is None else rows[twin])
        number[twin] = twin[first][own]
    return number


def _anchors(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = Block(*held, length)
                if not len(x.hash):
                    continue
                by, cut, edge = x.by_hash(parts)
                h, d = x.hash[by[cut]].astype("<u4"), x.doc[by]
                twice = np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut)
                rows = [(p, block, h[a:z].tobytes(), np.packbits(twice[a:z]).tobytes()) for p, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if z > a]
                yield _batch(ANCHORS, rows)

    return run


def _repeated(group: pa.Table) -> pa.Table:
    part, block, hashes, twice = (group.column(n).to_pylist() for n in ("part", "block", "hashes", "twice"))
    size = [len(h) // 4 for h in hashes]
    values = np.frombuffer(b"".join(hashes), "<u4")
    flags = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(twice, size, strict=True)]).astype(bool)
    by = np.argsort(values)
    value = values[by]
    start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    times = np.diff(np.append(start, len(value)))
    hit = np.zeros(len(values), bool)
    hit[by] = np.repeat((times > 1) | np.logical_or.reduceat(flags[by], start), times)
    rows, at = [], 0
    for k, n in enumerate(size):
        if (own := hit[at : at + n]).any():
            rows.append((block[k], part[k], np.packbits(own).tobytes()))
        at += n
    return pa.Table.from_batches([_batch(REPEATED, rows)])


def _contexts(parts: int, length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            block, *held = (c[0].as_py() for c in left.columns)
            x = Block(*held, length)
            by, cut, edge = x.by_hash(parts)
            hit = np.zeros(len(cut), bool)
            for p, bits in zip(right.column("part").to_pylist(), right.column("bits").to_pylist(), strict=True):
                hit[edge[p] : edge[p + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(edge[p + 1] - edge[p]))
            times = np.diff(np.append(cut, len(by)))
            some = by[np.repeat(hit, times)]
            ends = np.concatenate(([0], np.cumsum(np.where(hit, times, 0))))[edge]  # where each part's contexts begin among them
            p = 0
            while p < parts:  # some parts at once
                q = max(p + 1, int(np.searchsorted(ends, ends[p] + ROWS, side="right")) - 1)
                own = some[ends[p] : ends[q]]
                if len(own):
                    wide = x.contexts(own, length)
                    number = _equal_contexts(x, own, length, wide)
                    first, number = np.unique(number, return_inverse=True)
                    low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
                    np.minimum.at(low, number, x.doc[own])
                    np.maximum.at(high, number, x.doc[own])
                    anchor, wide = own[first].astype("<u4"), wide[first]
                    at = np.searchsorted(first, ends[p : q + 1] - ends[p]).tolist()
                    rows += [(p + k, block, z - a, _squeeze(anchor[a:z], low[a:z], high[a:z], wide[a:z])) for k, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)) if z > a]
                p = q
        return pa.Table.from_batches([_batch(CONTEXTS, rows)])

    return run


def least_ids(rows: np.ndarray, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For distinct contexts, runs (context, first window, end window, least id that has these windows)."""
    windows = rows[:, 0].astype(np.int64)
    size = windows + length - 1
    buf = rows[:, 2:][np.arange(rows.shape[1] - 2, dtype=np.uint8) < size.astype(np.uint8)[:, None]]
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(rows)), windows)  # of each window
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    number = np.full(len(buf), -1, np.int32)  # of the window that starts at each byte
    number[begin[owner] + place] = np.arange(len(owner), dtype=np.int32)
    sa = suffix_array(buf, size, windows, length)
    window = number[sa]
    starts = window >= 0
    sa, window = sa[starts], window[starts]
    group = np.flatnonzero(np.concatenate(([True], ~shares(buf, sa[:-1], sa[1:], length))))
    best = np.minimum.reduceat(low[owner[window]], group)
    b = np.empty(len(owner), np.int64)
    b[window] = np.repeat(best, np.diff(np.append(group, len(sa))))
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (b[1:] != b[:-1]))))
    stop = np.diff(np.append(new, len(owner)))
    return owner[new], place[new], place[new] + stop, b[new]


def _resolve(length: int):
    wide = 2 * length + 2

    def run(group: pa.Table) -> pa.Table:
        block, count, body = (group.column(n).to_pylist() for n in ("block", "n", "body"))
        order = sorted(range(len(block)), key=block.__getitem__)
        got = [_arrays(body[k], ("<u4", count[k]), ("<i8", count[k]), ("<i8", count[k]), ("u1", count[k] * wide)) for k in order]
        rows = np.concatenate([g[3] for g in got]).reshape(-1, wide)
        anchor, low, high = (np.concatenate([g[k] for g in got]) for k in (0, 1, 2))
        origin = np.repeat(np.arange(len(order)), [count[k] for k in order])
        first, number = _equal_rows(rows)
        best = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(best, number, low)
        who, start, end, least = least_ids(rows[first], best, length)
        # each run back to every block that has the context in a document of greater id
        by = np.argsort(number, kind="stable")
        edge = np.concatenate(([0], np.cumsum(np.bincount(number))))
        times = edge[who + 1] - edge[who]
        run_of = np.repeat(np.arange(len(who)), times)
        sent = by[np.repeat(edge[who], times) + np.arange(len(run_of)) - np.repeat(np.cumsum(times) - times, times)]
        useful = high[sent] > least[run_of]
        run_of, sent = run_of[useful], sent[useful]
        by = np.argsort(origin[sent], kind="stable")
        run_of, sent = run_of[by], sent[by]
        edge = np.searchsorted(origin[sent], np.arange(len(order) + 1))
        out = []
        for k, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            if z > a:
                r = run_of[a:z]
                out.append((block[order[k]], z - a, _squeeze(anchor[sent[a:z]].astype("<u4"), start[r].astype("u1"), end[r].astype("u1"), least[r].astype("<i8"))))
        return pa.Table.from_batches([_batch(MARKS, out)])

    return run


def covered(x: Block, marks: list[tuple[int, bytes]], length: int) -> np.ndarray:
    """Which bytes of a block go."""
    change = np.zeros(len(x.buf) + 1, np.int32)
    if marks:
        parts = [_arrays(body, ("<u4", n), ("u1", n), ("u1", n), ("<i8", n)) for n, body in marks]
        anchor, start, end, least = (np.concatenate([p[k] for p in parts]) for k in range(4))
        # all anchors with the same context as one that is named: its hash begins alike
        named = np.zeros(1 << 22, bool)
        named[x.hash[anchor] >> np.uint64(42)] = True
        some = np.flatnonzero(named[x.hash >> np.uint64(42)])
        some = some[np.argsort(x.hash[some])]
        number = np.empty(len(some), np.int64)
        cut = np.flatnonzero(np.concatenate(([True], x.hash[some[1:]] != x.hash[some[:-1]])))
        a = 0
        while a < len(some):  # some hashes at once
            z = int(np.append(cut, len(some))[max(np.searchsorted(cut, a) + 1, np.searchsorted(cut, a + ROWS))])
            number[a:z] = a + _equal_contexts(x, some[a:z], length)
            a = z
        klass = np.full(len(x.hash), -1, np.int64)
        klass[some] = number
        by = np.argsort(number, kind="stable")
        edge = np.concatenate(([0], np.cumsum(np.bincount(number))))
        own = klass[anchor]
        times = edge[own + 1] - edge[own]
        mark = np.repeat(np.arange(len(anchor)), times)
        hit = some[by[np.repeat(edge[own], times) + np.arange(len(mark)) - np.repeat(np.cumsum(times) - times, times)]]
        later = x.doc[hit] > least[mark]
        mark, hit = mark[later], hit[later]
        np.add.at(change, x.first[hit] + start[mark], 1)
        np.add.at(change, x.first[hit] + end[mark] - 1 + length, -1)
    return np.cumsum(change, out=change)[:-1] > 0


def _cut(length: int, id_col: str, with_kept: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for _, *held in zip(*(c.to_pylist() for c in left.columns), strict=True):
            x = Block(*held, length)
            gone = covered(x, list(zip(right.column("n").to_pylist(), right.column("body").to_pylist(), strict=True)), length)
            for i, a, z in zip(x.ids.tolist(), (x.ends - x.sizes).tolist(), x.ends.tolist(), strict=True):
                own = gone[a:z]
                kept = x.text[a:z] if not own.any() else x.buf[a:z][~own].tobytes()
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                out.append((None if i == NONE else i, z - a, int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_kept else [])))
        return pa.Table.from_batches([_batch(_result(id_col, with_kept).replace("`", ""), out)])

    return run


def _result(id_col: str, with_kept: bool) -> str:
    return f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_kept else "")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = True, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of df: id, ``n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (the bytes that stay).

    A byte is removed if a string of ``length`` bytes that covers it, inside one document,
    also starts in a document of smaller id; strings are judged on the input.

    Null and empty texts have no bytes. Texts shorter than ``length`` lose nothing; of a longer
    one every window counts, however long it is, and a block holds it whole. Rows of equal id
    never take from each other; rows without id neither take nor lose. Ids are read as 64-bit
    numbers, and the least such number stands for no id. An empty table gives an empty result.
    Other columns are not read.
    """
    assert GRAM < length <= 100
    spark = df.sparkSession
    scratch = Scratch(spark, "repeats")
    slim = df.select(F.spark_partition_id().cast("bigint").alias("part"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = scratch.keep(slim.mapInArrow(_pack(block_bytes, length), BLOCKS), "blocks")
    total = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    # as many tasks as the data need, so that none reads more when there are more data
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    dealt = lambda d, key: d.repartition(tasks, key).groupBy(key)
    repeated = scratch.keep(dealt(blocks.mapInArrow(_anchors(parts, length), ANCHORS), "part").applyInArrow(_repeated, REPEATED), "repeated")
    contexts = dealt(blocks, "block").cogroup(dealt(repeated, "block")).applyInArrow(_contexts(parts, length), CONTEXTS)
    marks = scratch.keep(dealt(contexts, "part").applyInArrow(_resolve(length), MARKS), "marks")
    scratch.drop(repeated)
    return dealt(blocks, "block").cogroup(dealt(marks, "block")).applyInArrow(_cut(length, id_col, with_kept), _result(id_col, with_kept))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_kept=False)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, 500 * c AS a, substr(h, 1000 * c + 1, 1098) AS t FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 450) // 500)) AS c FROM d)),
w AS (SELECT doc_id, a + j AS i, substr(t, 2 * j + 1, 100) AS s FROM (SELECT doc_id, a, t, unnest(range(0, len(t) // 2 - 49)) AS j FROM x)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
r AS (SELECT doc_id, i, coalesce((i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50)::INT, 1) AS new FROM w JOIN m USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
c AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
