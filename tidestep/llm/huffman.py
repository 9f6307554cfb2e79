"""Canonical length-limited Huffman codes with vectorised coding in independent blocks."""

from __future__ import annotations

import numpy as np

#: Ids of a block; the bit offset of each block's start is a checkpoint.
BLOCK = 256
#: Ids coded at once, which bounds memory.
CHUNK = 1 << 19


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the symbols with a count, by package-merge; 0 for the others."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    row, is_leaf = leaf, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        by = np.argsort(both, kind="stable")
        row = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


class Code:
    """The canonical code of given lengths: shorter codes first, then smaller symbols."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.limit = max(1, int(self.lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        size = 1 << (self.limit - self.lengths[order].astype(np.int64))
        first = np.cumsum(size) - size  # codes, left-aligned to the limit
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (self.limit - self.lengths[order].astype(np.int64))).astype(np.uint64)
        self.symbol, self.step = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.int64)
        end = int(size.sum())
        self.symbol[:end], self.step[:end] = np.repeat(order, size), np.repeat(self.lengths[order], size)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload and the bit offset of every block."""
        payload, starts, done = [], [], 0
        for at in range(0, len(ids), CHUNK):
            part = ids[at : at + CHUNK]
            n = self.lengths[part].astype(np.int64)
            if not n.all():
                raise ValueError("an id has no code")
            pos = np.cumsum(n) - n
            starts.append(pos[::BLOCK] + done * 8)
            word, shift = pos >> 5, (64 - (pos & 31) - n).astype(np.uint64)
            value = self.codes[part] << shift
            words = np.zeros(int(word[-1]) + 2, np.uint32)
            cut = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            words[word[cut]] = np.bitwise_or.reduceat(value >> np.uint64(32), cut).astype(np.uint32)
            words[word[cut] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), cut).astype(np.uint32)
            bits = int(pos[-1] + n[-1])
            payload.append(words.astype(">u4").tobytes()[: -(-bits // 8)])
            done += len(payload[-1])
        return b"".join(payload), np.concatenate(starts) if starts else np.zeros(0, np.int64)

    def decode(self, payload: bytes, starts: np.ndarray, count: int) -> np.ndarray:
        """The ids; all blocks of a chunk are decoded side by side by table look-ups."""
        out = np.zeros(len(starts) * BLOCK, np.uint32)
        lanes = CHUNK // BLOCK
        raw = np.frombuffer(payload + bytes(8), np.uint8)
        mask = np.int64((1 << self.limit) - 1)
        for at in range(0, len(starts), lanes):
            pos = starts[at : at + lanes].astype(np.int64)
            low = int(pos[0] >> 3)
            high = int(starts[at + lanes] >> 3) + 8 if at + lanes < len(starts) else len(raw)
            part = raw[low:high].astype(np.int64)
            window = np.zeros(len(part), np.int64)
            for k in range(4):
                window[: len(part) - k] |= part[k:] << (24 - 8 * k)
            pos = pos - low * 8
            ids = np.zeros((BLOCK, len(pos)), np.uint32)
            last = len(window) - 1
            for k in range(BLOCK):
                code = (window[np.minimum(pos >> 3, last)] >> (32 - self.limit - (pos & 7))) & mask
                ids[k] = self.symbol[code]
                pos = pos + self.step[code]
            out[at * BLOCK : at * BLOCK + ids.size] = ids.T.ravel()
        return out[:count]
