"""Tokenizers of public vocabulary files: fast encoders that give the library's ids.

Encoders live once per Python worker. ``byte_ids`` gives the ids of a byte-level vocabulary;
``word_ids`` those of a vocabulary with word ends, a word at a time with a bounded memo.
"""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np

#: Code points with the Unicode property White_Space (fixed values), as the inside of a regex class.
WHITE = "\t-\r \x85\xa0  -     　"
#: Words that a memo holds at most; it is emptied when full.
MEMO = 500_000
#: Runs from this length on are not remembered, and go to the library.
LONG_WORD = 200


def place(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def library(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(place(name))


@functools.cache
def byte_encoder(name: str = "byte_bpe_50k"):
    """The vocabulary as ranks; special strings in a text are special tokens, as by the library's default."""
    import public_tokenizers
    import tiktoken

    with open(place(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(place(f"{name}.json")) as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: Characters of one piece that go to the byte encoder at once; longer runs go to the library.
LONG_RUN = 2_000
_RUN = re.compile(f"[^{WHITE}]{{{LONG_RUN},}}|[{WHITE}]{{{LONG_RUN},}}")


def byte_ids(text: str, name: str = "byte_bpe_50k") -> np.ndarray:
    """The ids of a text as uint32."""
    if len(text) >= LONG_RUN and _RUN.search(text):  # the fast encoder is slow on very long pieces
        return np.array(library(f"{name}.json").encode(text, add_special_tokens=False).ids, np.uint32)
    return byte_encoder(name).encode_to_numpy(text, allowed_special="all")


@functools.cache
def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, to the byte.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for U+0100 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordMemo(dict):
    """ids, as little-endian bytes, of each run between ASCII white space, with the library's normaliser and splitter.

    Plain words go to a byte-pair encoder over the same merges, in which a byte that UTF-8
    never uses marks the word's end; all other runs go to the library itself.
    """

    END = b"\xff"
    PLAIN = re.compile("(?:[a-zà-öø-ÿ]+|[.,;:!?|*#$%&]+)*")
    PARTS = re.compile("[a-zà-öø-ÿ]+|[.,;:!?|*#$%&]+")

    def __init__(self, name: str, kind: str):
        self.library, self.kind = library(name), np.dtype(kind)
        with open(place(name)) as f:
            model = json.load(f)["model"]
        byte, end = byte_symbols(), model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            body, mark = (token[: -len(end)], self.END) if token.endswith(end) else (token, b"")
            return bytes(byte[c] for c in body) + mark

        single = [t for t in model["vocab"] if len(raw(t).removesuffix(self.END)) == 1]
        order = sorted(single, key=lambda t: (len(raw(t)), raw(t)))  # bytes, then bytes with an end, before all merges
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = [a + b for a, b in pairs]
        ranks: dict[bytes, int] = {}
        for t in [*order, *merged]:
            ranks.setdefault(raw(t), len(ranks))
        for b in range(256):
            ranks.setdefault(bytes([b]), len(ranks))
        to_id = {ranks[raw(t)]: i for t, i in model["vocab"].items() if raw(t) in ranks}
        self.ids = [np.array([to_id.get(r, 0)], kind).tobytes() for r in range(max(to_id) + 1)]
        import tiktoken

        self.core = tiktoken.Encoding("word-ends", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode()
        low = word.lower()
        if len(word) >= LONG_WORD or len(low) != len(word) or not self.PLAIN.fullmatch(low):
            out = np.array(self.library.encode(word, add_special_tokens=False).ids, self.kind).tobytes()
        elif low != word:
            out = self[low.encode()]
        elif self.PARTS.fullmatch(word):
            out = b"".join([self.ids[r] for r in self.core.encode_single_piece(raw + self.END)])
        else:
            out = b"".join([self[part.encode()] for part in self.PARTS.findall(word)])
        if len(self) >= MEMO:
            self.clear()
        if len(word) < LONG_WORD:
            self[raw] = out
        return out


@functools.cache
def word_memo(name: str = "word_bpe_49k.json", kind: str = "<u2") -> WordMemo:
    return WordMemo(name, kind)


def word_ids(text: bytes | str, name: str = "word_bpe_49k.json", kind: str = "<u2") -> bytes:
    """The ids of a text (in UTF-8) as little-endian bytes; ids never depend on the other side of white space."""
    raw = text.encode() if isinstance(text, str) else text
    return b"".join(map(word_memo(name, kind).__getitem__, raw.split()))  # bytes split at ASCII white space only
