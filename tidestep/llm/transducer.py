"""A byte-level BPE tokenizer compiled to a deterministic transducer that emits token counts.

Pair merging as a finite-state machine. A sequence of tokens is the encoding of its bytes if
and only if every two neighbours are the encoding of theirs, so each prefix of a piece has
exactly one last token, found among the vocabulary words that end there. What the future can
depend on is the last token, and the difference in tokens, at the positions from which a
vocabulary word could still be running: a bounded window. That window is the state. A
transition on a character moves the window and emits by how many tokens the encoding grew (a
merge can emit a negative number). States are made on demand and kept.

The splitter in front is a machine over character kinds with the states below; it is composed
with the merging machine, so one transition table serves a whole text.

The map of a chunk takes the state in which the chunk is entered to the state in which it is
left and the tokens emitted between. It is computed for every state that the characters in
front of the chunk allow: those in which the machine arrives when it is started at any of the
last LOOK of them. Of a long piece the true state is among them, because what a window holds
is decided by few bytes; if it is not, composing says so, and the text is counted in one run.
At white space after anything else a piece always ends, and all states meet in START.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import xxhash

from tidestep.llm.tokens import WHITE, byte_encoder

#: States and remembered segments of one worker; both are emptied when there are more.
MOST_STATES = 600_000
MOST_SEGMENTS = 200_000
#: Segments longer than this are not remembered.
LONG = 64

_UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_SYNC = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
_WHITE = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))

LETTER, NUMBER, SPACE, OTHER = "L", "N", "W", "P"
#: Endings after an apostrophe that starts a piece: complete ones, and those that need one more letter.
ONE, TWO = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}


@functools.lru_cache(maxsize=65_536)
def kind(ch: str) -> str:
    if ch in _WHITE:
        return SPACE
    c = unicodedata.category(ch)[0]
    return c if c in (LETTER, NUMBER) else OTHER


class Merger:
    """The pair-merging machine. Its states are windows; ``start`` is the empty piece."""

    def __init__(self, encoder):
        self.one = encoder._core_bpe.encode_single_piece
        self.word = {w: encoder._mergeable_ranks[w] for w in encoder._mergeable_ranks}
        self.bytes_of = {i: w for w, i in self.word.items()}
        self.heads = {w[:k] for w in self.word for k in range(len(w))}  # proper prefixes of words
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, Window] = {}
        self.start = self.state(b"", ((-1, 0),), True)

    def state(self, tail: bytes, past: tuple, whole: bool) -> Window:
        key = (tail, past, whole)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = Window(self, tail, past, whole)
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: the start of a piece)."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.one(self.bytes_of[b]) == [b] if a < 0 else self.one(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self.pairs[a, b] = known
        return known


class Window:
    """tail: the longest suffix that begins a word; past[k]: last token, and tokens since, k bytes ago; whole: the tail is the whole piece."""

    __slots__ = ("merger", "tail", "past", "whole", "next")

    def __init__(self, merger: Merger, tail: bytes, past: tuple, whole: bool):
        self.merger, self.tail, self.past, self.whole, self.next = merger, tail, past, whole, {}

    def step(self, byte: int) -> tuple[Window, int]:
        found = self.next.get(byte)
        if found is None:
            found = self.next[byte] = self._make(byte)
        return found

    def _make(self, byte: int) -> tuple[Window, int]:
        m, text = self.merger, self.tail + bytes([byte])
        for at in range(len(text)):  # longest word first
            word = m.word.get(text[at:])
            if word is not None:
                last, since = self.past[len(self.tail) - at]
                if m.fits(last, word):
                    break
        else:
            raise ValueError("a byte is not in the vocabulary")
        grew = 1 - since
        at = 0
        while text[at:] not in m.heads:
            at += 1
        past = ((word, 0), *((t, s + grew) for t, s in self.past[: len(text) - at]))
        return m.state(text[at:], past, self.whole and at == 0), grew


class State(dict):
    """A state of the composed machine: character -> (next state, tokens emitted)."""

    __slots__ = ("machine", "mode", "window", "last")

    def __init__(self, machine: Transducer, mode: str, window: Window, last: str = ""):
        self.machine, self.mode, self.window, self.last = machine, mode, window, last

    def __missing__(self, ch: str) -> tuple[State, int]:
        found = self[ch] = self.machine.move(self, ch)
        return found


class Transducer:
    """Modes: "" start; L, N, P inside letters, numbers, others; "_" one space; W white space of which
    ``last`` is not yet placed; "'" an apostrophe at the start of a piece, or one and a letter."""

    def __init__(self, name: str = "byte_bpe_50k"):
        encoder = byte_encoder(name)
        self.special = sorted(encoder.special_tokens_set, key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, self.special))).split if self.special else None
        self.merger = Merger(encoder)
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.merger.states.clear()
        self.merger.pairs.clear()
        self.merger.start = self.merger.state(b"", ((-1, 0),), True)
        self.start = self.state("", self.merger.start)
        self.memo: dict[str, int] = {}

    def state(self, mode: str, window: Window, last: str = "") -> State:
        key = (mode, id(window), last)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, mode, window, last)
        return found

    def feed(self, window: Window, text: str) -> tuple[Window, int]:
        total = 0
        for byte in text.encode("utf-8", "surrogatepass"):
            window, grew = window.step(byte)
            total += grew
        return window, total

    def move(self, s: State, ch: str) -> tuple[State, int]:
        k, empty = kind(ch), self.merger.start

        def begin(prefix: str = "", emitted: int = 0) -> tuple[State, int]:
            """ch at the start of a piece, or after the piece's leading space."""
            if not prefix:
                if k == SPACE:
                    return (self.state("_", empty), emitted) if ch == " " else (self.state(SPACE, empty, ch), emitted)
                if ch == "'":
                    return self.state("'", empty), emitted
            w, grew = self.feed(empty, prefix + ch)
            return self.state(k, w), emitted + grew

        if s.mode == "":
            return begin()
        if s.mode in (LETTER, NUMBER, OTHER):
            if k == s.mode:
                w, grew = self.feed(s.window, ch)
                return self.state(k, w), grew
            return begin()
        if s.mode == "_":
            return (self.state(SPACE, self.feed(empty, " ")[0], ch), self.feed(empty, " ")[1]) if k == SPACE else begin(" ")
        if s.mode == SPACE:
            if k == SPACE:
                w, grew = self.feed(s.window, s.last)
                return self.state(SPACE, w, ch), grew
            if s.last == " ":
                return begin(" ")
            return begin(emitted=self.feed(empty, s.last)[1])
        # an apostrophe that began a piece, and perhaps a letter after it
        if not s.last:
            if ch in ONE:
                return self.start, self.feed(empty, "'" + ch)[1]
            if ch in TWO:
                return self.state("'", empty, ch), 0
            w, grew = self.feed(empty, "'")
            if k == OTHER:
                w, more = self.feed(w, ch)
                return self.state(OTHER, w), grew + more
            return begin(emitted=grew)
        if ch == TWO[s.last]:
            return self.start, self.feed(empty, "'" + s.last + ch)[1]
        alone, (w, grew) = self.feed(empty, "'")[1], self.feed(empty, s.last)
        then, more = self.state(LETTER, w)[ch]
        return then, alone + grew + more

    def end(self, s: State) -> int:
        """Tokens that the end of a text emits."""
        if s.mode == "_":
            return self.feed(self.merger.start, " ")[1]
        if s.mode == SPACE:
            return self.feed(s.window, s.last)[1]
        if s.mode == "'":
            return self.feed(self.merger.start, "'")[1] + (self.feed(self.merger.start, s.last)[1] if s.last else 0)
        return 0

    def trim(self) -> None:
        if len(self.states) + len(self.merger.states) > MOST_STATES:
            self.clear()

    def run(self, text: str) -> int:
        """Tokens of a text without special strings, from START to its end."""
        s, total = self.start, 0
        for ch in text:
            s, grew = s[ch]
            total += grew
        total += self.end(s)
        self.trim()
        return total

    def unit(self, text: str) -> int:
        """Tokens of a segment that runs from START to START."""
        if any(x in text for x in self.special):
            parts = self.split(text)
            return len(parts) - 1 + sum(map(self.run, parts))
        return self.run(text)

    def count(self, text: str) -> int:
        """Tokens of a whole text: the maps of its segments, all from START to START, composed."""
        total, memo = 0, self.memo
        for u in _UNITS.findall(text):
            n = memo.get(u)
            if n is None:
                n = self.unit(u)
                if len(u) <= LONG:
                    memo = self.memo  # it may be a new one
                    if len(memo) >= MOST_SEGMENTS:
                        memo.clear()
                    memo[u] = n
            total += n
        return total


@functools.cache
def transducer(name: str = "byte_bpe_50k") -> Transducer:
    return Transducer(name)


#: The map of a chunk: entry state -> (state after it, tokens emitted, tokens that the text's end
#: would emit there). States go by a 128-bit digest of what they hold, so a map holds no text.
Map = dict[bytes, tuple[bytes, int, int]]

#: Characters in front of a chunk at which starts are tried: more than any vocabulary word has.
LOOK = 160
#: Characters after which states that have met are recognised.
STEP = 16


def name_of(s: State) -> bytes:
    """The name of a state, the same in every worker."""
    return xxhash.xxh3_128_digest(repr((s.mode, s.last, s.window.tail, s.window.past, s.window.whole)))


def entries(t: Transducer, before: str, at_start: bool) -> list[State]:
    """The states in which a chunk can be entered; before: what is in front of it; at_start: whether nothing is in front of that."""
    live = {name_of(t.start): t.start}
    for ch in before:
        moved = [s[ch][0] for s in live.values()]
        live = {name_of(s): s for s in (moved if at_start else [*moved, t.start])}
    return list(live.values())


def _last_sync(text: str, at: int) -> int:
    """The last point after ``at`` where white space follows something else; ``at`` if there is none."""
    end = len(text)
    while end > at and text[end - 1] not in _WHITE:
        end -= 1
    while end > at and text[end - 1] in _WHITE:
        end -= 1
    return end


def chunk_map(text: str, before: str = "", at_start: bool = True, name: str = "byte_bpe_50k") -> Map:
    """The map of a chunk whose edges are not inside a special string (``cut_points``); before and at_start as for ``entries``."""
    t = transducer(name)
    special = max((before.rfind(x) + len(x) for x in t.special if x in before), default=0)
    first = entries(t, before[special:], at_start or special > 0)
    names = [name_of(s) for s in first]
    now, of, total = list(first), list(range(len(first))), [0] * len(first)  # states of groups; of each entry its group and count

    def add(got: list[int]) -> None:
        for e, g in enumerate(of):
            total[e] += got[g]

    def gather(state: State) -> None:
        """All entries are in one state."""
        now[:], of[:] = [state], [0] * len(of)

    for k, part in enumerate(t.split(text) if t.split else [text]):
        if k:  # a special string: what is open ends, and it is one token
            add([t.end(s) + 1 for s in now])
            gather(t.start)
        at = 0
        while at < len(part):
            if len(now) == 1 and now[0] is t.start:
                end = _last_sync(part, at)
                if end > at:
                    add([t.count(part[at:end])])
                    gather(t.start)
                    at = end
                    continue
            sync = _SYNC.search(part, at + 1)
            stop = sync.start() if sync else len(part)
            while at < stop:
                step, got = stop if len(now) == 1 else min(stop, at + STEP), []
                for g, s in enumerate(now):
                    n = 0
                    for ch in part[at:step]:
                        s, grew = s[ch]
                        n += grew
                    now[g] = s
                    got.append(n)
                add(got)
                at = step
                if len(now) > 1:
                    met: dict[bytes, State] = {}
                    where = [name_of(s) for s in now]
                    for w, s in zip(where, now, strict=True):
                        met.setdefault(w, s)
                    number = {w: g for g, w in enumerate(met)}
                    now[:], of[:] = list(met.values()), [number[where[g]] for g in of]
            if sync:  # white space after something else: the piece ends
                add([t.end(s) for s in now])
                gather(t.start)
    ends = [(name_of(s), t.end(s)) for s in now]
    t.trim()
    return {names[e]: (ends[g][0], total[e], ends[g][1]) for e, g in enumerate(of)}


def compose(a: Map, b: Map) -> Map:
    """The map of two neighbouring chunks; associative. Entries that lead to a state which b does not know are left out."""
    return {e: (b[x][0], n + b[x][1], b[x][2]) for e, (x, n, _) in a.items() if x in b}


def total(m: Map, name: str = "byte_bpe_50k") -> int | None:
    """Tokens of a whole text by its map; None if composing has lost its way."""
    found = m.get(name_of(transducer(name).start))
    return None if found is None else found[1] + found[2]


def cut_points(text: str, chunk: int, name: str = "byte_bpe_50k") -> list[int]:
    """Where chunks of about ``chunk`` characters begin; never inside a special string."""
    special, out = transducer(name).special, [0]
    for at in range(chunk, len(text), chunk):
        for x in special:
            near = text.find(x, max(0, at - len(x) + 1), at + len(x) - 1)
            if 0 <= near < at:
                at = near
        if at > out[-1]:
            out.append(at)
    return out
