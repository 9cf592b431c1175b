"""Word-memoised encoding with the tokenizers library.

Both public BPE tokenizers cut a text into pretokens and encode each on its own,
so a worker encodes every distinct pretoken once, with the library, and joins
the remembered ids. The cut is made here by a regular expression only for texts
of characters whose classes are beyond doubt (`UNPLAIN`); every other text, and
any text with a special token's spelling, goes whole to the library. For byte-level
tokenizers the same cut is made on the bytes of many plain texts at once, and only
the distinct words of those are looked up one by one.
"""

from __future__ import annotations

import codecs
import gc
import os
import re
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Printable ASCII, line feed, tab, and the Latin letters of U+00C0 to U+017F
#: without U+0130 and U+0149 (their lower case or class is disputed).
UNPLAIN = re.compile("[^\n\t -~À-ÖØ-öø-įı-ňŊ-ſ]")
_L = "A-Za-zÀ-ÖØ-öø-ſ"
#: The tokenizers' own split patterns, with the classes of plain
#: characters spelled out.
CUTS = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+"),
}
#: GPT-2's characters for bytes, as byte-level tokenizers have them.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTE_CHARS = "".join(chr(b if b in _SHOWN else 256 + _HIDDEN.index(b)) for b in range(256))
#: Classes of a plain text's bytes. All from 128 on belong to letters.
_WHITE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 32]] = _WHITE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
#: A worker keeps its words in two generations of about this many (some 200
#: bytes each); words of the older that come up again move to the newer.
MEMORY = 350_000


def byte_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pretokens of ``CUTS["byte"]`` start in plain texts, which stand in
    ``data`` (UTF-8 bytes) one after another at ``offsets``; the last is its end."""
    n = len(data)
    whole = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][whole], offsets[1:][whole] - 1
    kind = _CLASS[data]
    white = kind == _WHITE
    start = np.zeros(n, bool)
    # A run of a class; a space before it goes with it, and apart from white ones before that.
    start[1:] = (kind[1:] != kind[:-1]) & (white[1:] | (data[:-1] != 32))
    start[1:-1] |= white[1:-1] & white[:-2] & ~white[2:]
    # White characters at a text's end stay together.
    start[last[(last > first) & white[last] & white[last - 1]]] = False
    start[first] = True
    # A contraction ends before the run of letters that it begins.
    at = np.flatnonzero((data == ord("'")) & start)
    left = offsets[np.searchsorted(offsets, at, side="right")] - at
    one, two = data[np.minimum(at + 1, n - 1)], data[np.minimum(at + 2, n - 1)]
    short = (left > 1) & np.isin(one, list(b"stmd"))
    long = (left > 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    start[at[short | long] + 1] = False
    after = np.concatenate([at[short] + 2, at[long] + 3])
    start[after[after < n]] = True
    return np.flatnonzero(start)


class MemoEncoder:
    """ids(texts) -> list of id arrays (numpy uint32), equal to the library's
    encode(text, add_special_tokens=False). ``kind``: byte or word."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = CUTS[kind].findall
        self.lower = kind == "word"
        # A pretoken needs no cutting: its bytes' characters go to the library's model.
        self.model = self.library.model if kind == "byte" and self.library.normalizer is None else None
        self.known: dict[str | bytes, bytes] = {}
        self.older: dict[str | bytes, bytes] = {}

    def plain(self, text: str) -> bool:
        return UNPLAIN.search(text) is None and not any(s in text for s in self.specials)

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct pretokens, remembered or by the library's model."""
        known, older = self.known, self.older
        out = list(map(known.get, words))
        fresh = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            if (ids := older.get(words[i])) is None:
                fresh.append(i)
            else:
                out[i] = known[words[i]] = ids
        if fresh:
            one = self.model.tokenize
            # No plain text has the byte 0, which parts the words here.
            shown = codecs.charmap_decode(b"\0".join([words[i] for i in fresh]), "strict", BYTE_CHARS)[0].split(BYTE_CHARS[0])
            for i, word in zip(fresh, shown, strict=True):
                out[i] = known[words[i]] = array("I", [t.id for t in one(word)]).tobytes()
        return out

    def byte_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of plain texts, gathered from those of their distinct words."""
        encoded = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, encoded)])
        data = np.frombuffer(b"".join(encoded), np.uint8)
        if not len(data):
            return [np.zeros(0, "<u4")] * len(texts)
        starts = byte_starts(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        ids = self.word_ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        which = words.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(counts)
        away = (np.cumsum(sizes) - sizes)[which] - (ends - counts)
        out = flat[np.repeat(away, counts) + np.arange(ends[-1])]
        before = np.append(0, ends)[np.searchsorted(starts, offsets)]
        return [out[a:b] for a, b in pairwise(before.tolist())]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        pieces: list = [None] * len(texts)
        missing: set[str] = set()
        odd = []
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        whole = []
        for i, text in enumerate(texts):
            text = text or ""
            if not self.plain(text):
                odd.append(i)
            elif self.model is not None:
                whole.append(i)
            else:
                cut = pieces[i] = self.cut(text.lower() if self.lower else text)
                missing.update(cut)
        if whole:
            for i, one in zip(whole, self.byte_ids([texts[i] or "" for i in whole]), strict=True):
                out[i] = one
        missing.difference_update(known)
        if missing:
            again = missing & older.keys()
            known.update((w, older[w]) for w in again)
            fresh = list(missing - again)
            for start in range(0, len(fresh), 20_000):
                part = fresh[start : start + 20_000]
                for word, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    known[word] = array("I", e.ids).tobytes()
        get = known.__getitem__
        for i, cut in enumerate(pieces):
            if cut is not None:
                out[i] = np.frombuffer(b"".join(map(get, cut)), dtype="<u4")
        for i in odd:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype="<u4")
        return out


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> MemoEncoder:
    """One encoder in each Python worker. Its words hold no reference cycles, so
    the collector may look at them less often."""
    gc.set_threshold(200_000, 20, 100)
    return MemoEncoder(path, kind)


def forget() -> None:
    """Give a reused worker's remembered words back before other memory-heavy work."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
