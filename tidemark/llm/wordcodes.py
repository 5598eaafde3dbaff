"""Token ids of texts from a public tokenizer, encoding each different piece of a text once.

Both tokenizers used here always end a token where a space follows other text, so a text is the
sequence of its space-separated pieces. A task keeps the ids of pieces it has seen lately; the rest of
a batch goes through the library in one call. Texts whose spaces do not separate pieces go through the
library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence

import numpy as np
from tokenizers import Tokenizer

#: Pieces kept per generation, two generations per cache: bounds a task's memory, not its result.
KEPT = 500_000
#: Longest piece that is kept.
LONGEST = 64

_LOADED: dict = {}


def load(path: str, literal_specials: bool):
    """The tokenizer of a file, read once per Python worker. One thread: Spark runs the tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, literal_specials)
    if key not in _LOADED:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = literal_specials
        _LOADED[key] = tokenizer
    return _LOADED[key]


class PieceCache:
    """piece (text or its UTF-8 bytes) -> bytes of its ids (little-endian unsigned 32-bit)."""

    def __init__(self, tokenizer, lead: str = "", kept: int = KEPT):
        self.tokenizer, self.lead, self.kept = tokenizer, lead, kept
        # the same tokenizer, which sees special tokens in a text; all of theirs begin with "<|"
        self.marking = Tokenizer.from_str(tokenizer.to_str())
        self.marking.encode_special_tokens = False
        self.special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items() if t.content.startswith("<|")}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text. Many short texts go as one, with a special token between them."""
        mark = next(iter(self.special.values()), None)
        if mark is None:
            got = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
            return [np.asarray(e.ids, dtype="<u4").tobytes() for e in got]
        number = next(iter(self.special))
        out: list[bytes] = [b""] * len(texts)
        alone = [k for k, t in enumerate(texts) if "<|" in t]  # may hold a special token's own text
        for k in alone:
            out[k] = np.asarray(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype="<u4").tobytes()
        rest = [k for k, t in enumerate(texts) if "<|" not in t]
        for first in range(0, len(rest), 256):
            part = rest[first : first + 256]
            ids = np.asarray(self.marking.encode(mark.join([texts[k] for k in part]), add_special_tokens=False).ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == number), len(ids)).tolist()
            raw, at = ids.tobytes(), 0
            for k, end in zip(part, ends, strict=True):
                out[k] = raw[4 * at : 4 * end]
                at = end + 1
        return out

    def fill(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of all `pieces`; the kept ones are renewed."""
        new, old = self.new, self.old
        out, missing = {}, []
        for p in pieces:
            ids = new.get(p)
            if ids is None:
                ids = old.get(p)
                if ids is None:
                    missing.append(p)
                    continue
                new[p] = ids
            out[p] = ids
        lead = self.lead
        texts = [lead + (p if isinstance(p, str) else p.decode()) for p in missing]
        for p, ids in zip(missing, self.encode(texts), strict=True):
            out[p] = ids
            if len(p) <= LONGEST:
                new[p] = ids
        if len(new) > self.kept:
            self.old, self.new = new, {}
        return out


#: A full stop or comma on its own after a letter, which is a token by itself.
_MARK = re.compile(rb"(?<=[a-z0-9])([.,])(?= )")


def loose(texts: Sequence[str], tokenizer, kept: int = KEPT) -> list[bytes]:
    """Ids for a tokenizer that drops white space and case: a text is the sequence of its words.

    ASCII letters are made small here already, and full stops and commas set apart, so that fewer
    different pieces are left.
    """
    key = ("loose", id(tokenizer), kept)
    if key not in _LOADED:
        _LOADED[key] = PieceCache(tokenizer, kept=kept)
    cache = _LOADED[key]
    split = [_MARK.sub(rb" \1", t.encode().lower().replace(b"\n", b" ") + b" ").split(b" ") for t in texts]
    ids = cache.fill({p for parts in split for p in parts})
    return [b"".join(map(ids.__getitem__, parts)) for parts in split]


#: A space between white space, where a piece could not tell how the white space is split.
_TIED = re.compile(r"\s (?:\s|\Z)")


def spaced(texts: Sequence[str], tokenizer) -> list[bytes]:
    """Ids for a tokenizer whose tokens take the space before them."""
    first = _LOADED.setdefault(("first", id(tokenizer)), PieceCache(tokenizer))
    rest = _LOADED.setdefault(("rest", id(tokenizer)), PieceCache(tokenizer, " "))
    split = [None if _TIED.search(t) else t.split(" ") for t in texts]
    head = first.fill({parts[0] for parts in split if parts})
    tail: set[str] = set()
    for parts in split:
        if parts:
            tail.update(parts[1:])
    ids = rest.fill(tail)
    whole = iter(first.encode([t for t, parts in zip(texts, split, strict=True) if parts is None]))
    return [next(whole) if parts is None else head[parts[0]] + b"".join(map(ids.__getitem__, parts[1:])) for parts in split]


Coder = Callable[[Sequence[str], object], list[bytes]]
