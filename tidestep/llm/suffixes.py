"""Two-stage suffix sorting of many short byte strings at once, vectorised by buckets.

A suffix is of type S if it is smaller than its successor, else of type L; the end of a
string is smaller than everything. Only S suffixes are sorted directly. In the bucket of a
first byte, L suffixes come before S suffixes, and the L suffixes arise in order from a scan
of all smaller suffixes: if suffix j is scanned and j - 1 is of type L, then j - 1 is next in
the bucket of its first byte.
"""

from __future__ import annotations

import numpy as np


def _views(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; buf must end in seven bytes that don't matter."""
    return np.ndarray((len(buf) - 7,), ">u8", np.ascontiguousarray(buf).data, strides=(1,))


def _padded(buf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The eight-byte views of the strings with eight zero bytes after each."""
    out = np.zeros(len(buf) + 8 * len(lengths) + 8, np.uint8)
    inside = np.repeat(np.tile([True, False], len(lengths)), np.stack([lengths, np.full(len(lengths), 8)], axis=1).ravel())
    out[: len(inside)][inside] = buf
    return _views(out)


def _bytes(views: np.ndarray, at: np.ndarray, left: np.ndarray, begin: int) -> np.ndarray:
    """Bytes begin to begin + 7 of each suffix as a number, zero after its end."""
    inside = left > begin
    out = views[np.where(inside, at + begin, 0)].astype(np.uint64)
    out[~inside] = 0
    return out


def direct_sort(views: np.ndarray, at: np.ndarray, left: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Order of suffixes of padded strings, only among those still equal; left: their lengths.

    After the first eight bytes a sort key is the number of the group of equals and as many of
    the next bytes as a 64-bit number has room for. With a depth, suffixes that share so many
    bytes come in any order.
    """
    first = _bytes(views, at, left, 0)
    order = np.argsort(first)
    first = first[order]
    group = np.cumsum(np.concatenate(([False], first[1:] != first[:-1]))) if len(at) else np.zeros(0, np.int64)
    some, done, most = np.arange(len(at)), 8, int(left.max(initial=0)) if depth is None else depth
    while len(some):
        # places of some, in order, and the groups there: only those of two or more go on
        same = group[1:] == group[:-1]
        tied = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        some, group = some[tied], group[tied]
        if done >= most or not len(some):
            break
        group = np.cumsum(np.concatenate(([False], group[1:] != group[:-1])))
        room = (64 - int(group[-1]).bit_length()) // 8
        who = order[some]
        key = _bytes(views, at[who], left[who], done)
        if room < 8:
            key >>= np.uint64(64 - 8 * room)
            key |= group.astype(np.uint64) << np.uint64(8 * room)
        by = np.argsort(key)
        order[some], key = who[by], key[by]
        group, done = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))), done + room
    if depth is None and len(some):  # equal but for zero bytes at the end
        who = order[some]
        order[some] = who[np.lexsort((left[who], group))]
    return order


def suffix_array(buf: np.ndarray, lengths: np.ndarray, heads: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
    """Positions of suffixes in order; buf: the strings' bytes back to back, none empty.

    Of all suffixes; or with heads, of at least those that start at the first heads[k] positions of string k
    (one or more), and the few after them that these arise from. With a depth, suffixes that share so
    many bytes are neighbours in any order: a scan of suffixes ordered by their first bytes gives
    the L suffixes ordered by one byte more.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    lasts = ends - 1
    # type L: greater than the successor; equal bytes take the type of the next position
    is_l = np.empty(n, bool)
    is_l[:-1] = buf[:-1] > buf[1:]
    is_l[lasts] = True
    equal = buf[:-1] == buf[1:]
    equal[lasts[:-1]] = False
    even = np.flatnonzero(equal)
    if len(even):  # the type of the position after the run of equal bytes
        after = np.flatnonzero(np.concatenate((np.diff(even) != 1, [True])))
        is_l[even] = is_l[even[after[np.searchsorted(after, np.arange(len(even)))]] + 1]
    begins = np.zeros(n, bool)
    begins[0] = True
    begins[ends[:-1]] = True
    s_at = np.flatnonzero(~is_l)
    if heads is not None:  # up to the first S suffix that is not before the last head
        first = ends - lengths
        wanted = np.minimum(np.append(s_at, n)[np.searchsorted(s_at, first + heads - 1)], lasts)
        edge = np.zeros(n + 1, np.int32)
        edge[first] += 1
        edge[wanted + 1] -= 1
        s_at = s_at[np.cumsum(edge[:-1])[s_at] > 0]
        lasts = lasts[wanted == lasts]
    views = _padded(buf, lengths)
    owner = np.searchsorted(ends, s_at, side="right")
    s_at = s_at[direct_sort(views, s_at + 8 * owner, ends[owner] - s_at, depth)]
    s_first = buf[s_at]
    s_cut = np.searchsorted(s_first, np.arange(257))
    # whether the position before is of type L in the same string
    leads = np.zeros(n, bool)
    leads[1:] = is_l[:-1]
    leads &= ~begins

    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(scanned: np.ndarray) -> None:
        before = scanned[leads[scanned]] - 1
        if not len(before):
            return
        first = buf[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cut = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        for a, b in zip(cut, [*cut[1:], len(first)], strict=True):
            buckets[first[a]].append(before[a:b])

    # what the ends of the strings, smaller than all, induce
    by = np.argsort(buf[lasts], kind="stable")
    for byte in np.unique(buf[lasts]):
        buckets[byte].append(lasts[by][buf[lasts][by] == byte])
    out = []
    for byte in range(256):
        done = 0
        while done < len(buckets[byte]):  # scanning may add to this very bucket, behind what it has
            now = buckets[byte][done:]
            done = len(buckets[byte])
            scanned = np.concatenate(now)
            out.append(scanned)
            induce(scanned)
        own = s_at[s_cut[byte] : s_cut[byte + 1]]
        if len(own):
            out.append(own)
            induce(own)
    return np.concatenate(out)


def shares(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a and b, at least so long each, share a prefix of the length."""
    views = _views(np.concatenate([buf, np.zeros(8, np.uint8)]))
    out = np.ones(len(a), bool)
    for k in range(0, length, 8):
        step = min(8, length - k)
        some = np.flatnonzero(out)
        out[some] = (views[a[some] + k] ^ views[b[some] + k]) >> np.uint64(64 - 8 * step) == 0
    return out
