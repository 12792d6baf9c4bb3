"""Byte-level BPE vocabularies: loading, units that can be encoded alone, memoised per-unit work."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Sequence

import numpy as np
import public_tokenizers

DEFAULT_VOCABULARY = "byte_bpe_50k.json"

#: Between two characters that aren't white space, a single space always begins a pre-token.
#: Python's \s holds all that the vocabularies' patterns take as white space, and a little more.
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def library_tokenizer(path: str):
    """The tokenizers library's object for a .json file, without truncation or padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[tuple[str, int], ...]:
    """Strings that the library takes out of a text before it looks for pre-tokens, with their ids."""
    with open(path, encoding="utf-8") as file:
        return tuple((t["content"], t["id"]) for t in json.load(file).get("added_tokens", []))


def _byte_alphabet() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for: printable Latin-1 bytes for
    themselves, the others, in order, for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def vocabulary_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id of a byte-level .json file; of special ones, their strings'."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    special = {i: s.encode() for s, i in special_strings(path)}
    to_byte = _byte_alphabet()
    return {i: bytes(map(to_byte.__getitem__, t)) for t, i in vocabulary.items() if i not in special} | special


@functools.lru_cache(maxsize=4)
def core(path: str):
    """tiktoken's encoder over the vocabulary of a byte-level .json file, without special strings.

    It gives the ids that the tokenizers library gives (tests hold one against the other over all code
    points) in a quarter of the time.
    """
    import tiktoken

    special = {i for _, i in special_strings(path)}
    ranks = {b: i for i, b in vocabulary_bytes(path).items() if i not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters of white space in a row from which on a text's stretch around them goes to the tokenizers
#: library: the other encoder's matcher keeps a place on its stack for each and breaks off below a million.
LONG_SPACE = 50_000
_SPACES = re.compile(r"\s++")


def stretches(text: str) -> list[tuple[str, bool]]:
    """``text`` in stretches between safe spaces, and whether each holds a long run of white space."""
    if len(text) < LONG_SPACE:
        return [(text, False)]
    out, at, end = [], 0, 0
    for run in _SPACES.finditer(text):
        if run.end() - run.start() < LONG_SPACE or run.end() <= end:
            continue
        begin, width = None, 256
        while begin is None:  # the last safe space before the run, else where the last stretch ended
            low = max(end, run.start() - width)
            found = [m.start() for m in _SAFE_SPACE.finditer(text, low, run.start())]
            begin = found[-1] if found else at if low == end else None
            width *= 4
        after = _SAFE_SPACE.search(text, run.end())
        stop = after.start() if after else len(text)
        if out and begin == at and out[-1][1]:
            out[-1] = (out[-1][0] + text[at:stop], True)
        else:
            if begin > at:
                out.append((text[at:begin], False))
            out.append((text[begin:stop], True))
        at = end = stop
    if at < len(text):
        out.append((text[at:], False))
    return out


@functools.lru_cache(maxsize=4)
def _plain_tokenizer(path: str):
    """The library's object for texts in which special strings are plain."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return tokenizer


def _long_ids(path: str, text: str) -> list[int]:
    ids: list[int] = []
    for stretch, long_space in stretches(text):
        if long_space:
            ids += _plain_tokenizer(path).encode(stretch, add_special_tokens=False).ids
        else:
            ids += core(path).encode_ordinary(stretch)
    return ids


def encode_ordinary(path: str, text: str) -> list[int]:
    """Ids of a text in which special strings are plain, whatever its white space."""
    return core(path).encode_ordinary(text) if len(text) < LONG_SPACE else _long_ids(path, text)


def ids_of(path: str, text: str) -> np.ndarray:
    """As ``encode_ordinary``, as an array."""
    return core(path).encode_to_numpy(text, disallowed_special=()) if len(text) < LONG_SPACE else np.array(_long_ids(path, text), np.uint32)


class UnitMemo:
    """Values of a text's units, each computed once while it is in a bounded memo.

    A unit is a stretch of text that begins at a *safe* space (see ``_SAFE_SPACE``) or at the text's
    start, so the units of a text can be tokenised alone and their results be joined.  ``compute``
    gets the units that the memo lacks.  When the memo is full it starts afresh, so that memory stays
    bounded for any vocabulary.
    """

    def __init__(self, compute: Callable[[Sequence[str]], Sequence], limit: int = 400_000, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.inner: dict[str, object] = {}  # by the unit without its space

    def values(self, text: str) -> list:
        """One value for each unit of ``text``, in order.  An empty text has none."""
        if not text:
            return []
        parts = text.split(" ")
        first = self.compute([parts[0]])[0] if len(parts) == 1 else None
        if first is not None:
            return [first]
        found = list(map(self.inner.get, parts))
        found[0] = None
        missing = [i for i, v in enumerate(found) if v is None]
        if any(not parts[i] or parts[i][0].isspace() or parts[i][-1].isspace() for i in missing):
            return list(self.compute(_split_safe(text)))
        values = self.compute([parts[i] if i == 0 else f" {parts[i]}" for i in missing])
        if len(self.inner) + len(missing) > self.limit:
            self.inner.clear()
        for i, value in zip(missing, values, strict=True):
            found[i] = value
            if i and len(parts[i]) <= self.longest:
                self.inner[parts[i]] = value
        return found


def _split_safe(text: str) -> list[str]:
    cuts = [0, *(m.start() for m in _SAFE_SPACE.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def split_special(text: str, specials: Sequence[tuple[str, int]]) -> list[str | int]:
    """The text between special strings, and the ids of those; the leftmost, then the longest, wins."""
    if not any(s in text for s, _ in specials):
        return [text]
    ids = dict(specials)
    pattern = "|".join(map(re.escape, sorted(ids, key=len, reverse=True)))
    return [ids[p] if i % 2 else p for i, p in enumerate(re.split(f"({pattern})", text)) if p]
