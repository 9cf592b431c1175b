"""BPE encoding and decoding by prefix-sharing trie traversal.

The last token of a BPE encoding of a prefix is a state: token t ends prefix p
exactly if t is a suffix of p and no merge crosses the border between t and the
last token of what precedes it. So the distinct words of a batch go into a trie,
one depth-first walk gives each node its last token from its ancestors' states,
and a word's ids are read back along its own path. Prefixes that words share are
computed once. Words already known to the worker are not inserted again.

Text is cut into words as the tokenizer's file says (see `pretokens`): by one
regular expression for plain texts, by the library's own normaliser and
pre-tokeniser for all others; spellings of special tokens are cut out first.

Defined cases: null or empty text has no ids; a word of any length costs time
and memory in proportion to it; repeated rows are encoded again, from memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pretokens import CUTS, UNPLAIN

OPEN = 1 << 60
#: Known words are kept in two generations of about this many.
MEMORY = 120_000
#: Words inserted into one trie (neighbours in sorted order).
TRIE_WORDS = 20_000
BASE_SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: itself if printable
    Latin-1, else the next code point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class PrefixBPE:
    """Encoder for a tokenizers file with a word-end suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        get = self.vocab
        self.rank = {(get[a], get[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts = {get[a + b]: (get[a], get[b], r) for r, (a, b) in enumerate(pairs)}
        self.strings = {i: s for s, i in self.vocab.items()}
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.strings |= {i: s for s, i in self.specials.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        #: In letters, without the word-end mark.
        self.length = {i: len(s) - (len(self.end) if self.end and s.endswith(self.end) else 0) for s, i in self.vocab.items()}
        self.longest = max(self.length.values())
        self.letters = {b: c for b, c in enumerate(byte_alphabet())}
        self.to_letters = str.maketrans({chr(b): c for b, c in self.letters.items()})
        self.apart: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """What stands at one side of the token while it is built: (piece, rank at
        which it arises, rank at which it is merged away)."""
        if (token, side) not in self.spines:
            out, piece, dies = [], token, OPEN
            while True:
                split = self.parts.get(piece)
                out.append((piece, split[2] if split else -1, dies))
                if split is None:
                    break
                piece, dies = split[side], split[2]
            self.spines[token, side] = out
        return self.spines[token, side]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two neighbours as they are: no merge of a piece
        at left's end with one at right's start comes while both are there. Of
        equal merges the leftmost goes first."""
        if (known := self.apart.get((left, right))) is not None:
            return known
        ok = True
        for a, born_a, dies_a in self.spine(left, 1):
            for b, born_b, dies_b in self.spine(right, 0):
                if (rank := self.rank.get((a, b))) is not None and (when := max(rank, born_a, born_b)) < dies_a and when <= dies_b:
                    ok = False
        self.apart[left, right] = ok
        return ok

    def last_token(self, tail: str, mark: str, depth: int, last: list[int]) -> int:
        """The state of a prefix of ``depth`` letters that ends in ``tail``."""
        vocab = self.vocab
        for size in range(min(depth, len(tail)), 0, -1):
            token = vocab.get(tail[-size:] + mark)
            if token is not None and (size == depth or self.stay_apart(last[depth - size], token)):
                return token
        raise ValueError(f"no token ends {tail!r}")

    def learn(self, words: list[str]) -> None:
        """Trie of the words in letters, then one depth-first walk."""
        root: dict = {}
        for word in words:
            letters = word.encode().decode("latin-1").translate(self.to_letters)
            node = root
            for c in letters[:-1]:
                node = node.setdefault(c, {})
            node[letters[-1] + "\n"] = word
        last: list[int] = [0]
        stack = [(root, 0, "")]
        longest, length, strings = self.longest, self.length, self.strings
        while stack:
            node, depth, tail = stack.pop()
            if depth:
                if depth == len(last):
                    last.append(0)
                last[depth] = self.last_token(tail, "", depth, last)
            for c, below in node.items():
                if c[-1] != "\n":
                    stack.append((below, depth + 1, (tail + c)[-longest:]))
                    continue
                token, at = self.last_token((tail + c[0])[-longest:], self.end, depth + 1, last), depth + 1
                ids = [token]
                while (at := at - length[token]) > 0:
                    ids.append(token := last[at])
                ids.reverse()
                self.known[below] = (len(ids), " ".join(map(str, ids)), " ".join(strings[i] for i in ids))

    def words(self, text: str) -> list[str]:
        """The text's words; special tokens' spellings stand as they are."""
        if UNPLAIN.search(text) is None and "<|" not in text:
            return CUTS["word"].findall(text.lower())
        out: list[str] = []
        for i, piece in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if i % 2:
                out.append(piece)
            elif piece:
                back = {c: b for b, c in self.letters.items()}
                normal = self.library.normalizer.normalize_str(piece)
                out += [bytes(back[c] for c in w).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def encode(self, texts: list[str | None]) -> list[list[tuple[int, str, str]]]:
        """Each text's words as (number of ids, ids in decimal, decoded)."""
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        if len(self.apart) > 4 * MEMORY:
            self.apart.clear()
        cut = [self.words(t or "") for t in texts]
        for s, i in self.specials.items():
            self.known[s] = (1, str(i), s)
        missing = set().union(*cut) - self.known.keys()
        again = missing & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        fresh = sorted(missing - again)
        for i in range(0, len(fresh), TRIE_WORDS):
            self.learn(fresh[i : i + TRIE_WORDS])
        get = self.known.__getitem__
        return [list(map(get, words)) for words in cut]


@lru_cache(maxsize=2)
def bpe(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def encode_decode(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", outputs: bool = False) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256; with ``outputs`` also
    ids (array) and decoded. Narrow: no shuffle."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(tokenizer_path)
        for batch in slices(batches, "text", 4 << 20):
            counts, ids, decoded = [], [], []
            for words in own.encode(batch.column("text").to_pylist()):
                counts.append(sum(w[0] for w in words))
                ids.append(" ".join([w[1] for w in words]))
                decoded.append(" ".join([w[2] for w in words]))
            columns = [batch.column("key"), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            if outputs:
                columns += [pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    schema = f"key {kind}, {BASE_SCHEMA}" + ", ids array<int>, decoded string" * outputs
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
