"""Operators 1, 5 and 8 against the tokenizers library and brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.fixtures import awkward_documents, empty_documents
from veinworks.llm import packing, prefix_bpe, pretokens, token_store
from veinworks.llm.entries import op1_token_store, op5_prefix_bpe, op8_best_fit_packing

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4"))


def expect_store(rows, tok):
    at, out = 0, []
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_token_store_query(spark, sf_dir, library):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, op1_token_store(spark, sf_dir).collect())) == expect_store(rows, library[BYTE])


def test_token_store_awkward(spark, library):
    df = awkward_documents(spark)
    shards = token_store.write_tokens(df, BYTE, shard_ids=500)
    got = token_store.read_tokens(shards).collect()
    assert Counter((r.key, r.n_tokens, r.ids_crc32) for r in got) == Counter((k, n, c) for k, _, n, c in expect_store([(r.doc_id, r.text) for r in df.collect()], library[BYTE]))
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    keys = [r.key for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert token_store.read_tokens(token_store.write_tokens(empty_documents(spark), BYTE)).count() == 0


def test_byte_words_go_to_the_model(library):
    """Every plain byte as the library encodes it, without an Encoding for each word."""
    plain = "".join(c for c in map(chr, range(0x180)) if pretokens.UNPLAIN.search(c) is None)
    texts = [plain, " ".join(plain), "Ünïcode wörds don't  mix\n\n x\t1234 ?!", " a", "", "  \n"]
    own = pretokens.MemoEncoder(BYTE, "byte")

    class Whole:
        encode = own.library.encode

    own.library = Whole()
    assert [x.tolist() for x in own.ids(texts)] == [library[BYTE].encode(t, add_special_tokens=False).ids for t in texts]


PLAIN_TEXTS = st.lists(st.text(alphabet="'strevlmdxSé ſ1! \n\t", max_size=30), max_size=6)


@settings(max_examples=400, deadline=None)
@given(PLAIN_TEXTS)
def test_byte_starts(texts):
    encoded = [t.encode() for t in texts]
    starts = pretokens.byte_starts(np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)]))
    words = [w for t in texts for w in pretokens.CUTS["byte"].findall(t)]
    assert starts.tolist() == list(np.cumsum([0] + [len(w.encode()) for w in words])[:-1])


def test_byte_words_are_looked_up_once_a_batch(library, monkeypatch):
    """Plain texts are not cut one by one, and a word that many share is one look-up,
    also where remembered words change their generation."""
    monkeypatch.setattr(pretokens, "MEMORY", 8)
    own, asked = pretokens.MemoEncoder(BYTE, "byte"), []
    monkeypatch.setattr(own, "cut", None)
    look = own.word_ids
    monkeypatch.setattr(own, "word_ids", lambda words: asked.append(len(words)) or look(words))
    shared = "the the don't  the\n"
    for texts in ([shared] * 50, [shared + str(i) for i in range(20)], [None, "", "naïve \u0130 <|endoftext|>", shared], [None]):
        assert [x.tolist() for x in own.ids(texts)] == [library[BYTE].encode(t or "", add_special_tokens=False).ids for t in texts]
    assert asked == [6, 26, 6]


@settings(max_examples=200, deadline=None)
@given(PLAIN_TEXTS, st.lists(st.text(max_size=20), max_size=3))
def test_byte_ids_any_text(plain, others):
    tok, texts = pretokens.encoder(BYTE, "byte"), [*plain, *others, *plain]
    assert [x.tolist() for x in tok.ids(texts)] == [tok.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_shard_select(spark):
    ids = [np.arange(n, dtype="<u4") % 9 for n in (3, 0, 500, 1, 1, 70)]
    shard = token_store.Shard(token_store.pack_shard([None, -7, -7, 0, 12, 2**40], ids, 2))
    assert [shard.key(i) for i in range(6)] == [None, -7, -7, 0, 12, 2**40]
    assert all((shard.document(i) == ids[i]).all() for i in range(6))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**50), max_size=300))
def test_elias_fano(values):
    values.sort()
    ef, _ = token_store.EliasFano.from_bytes(memoryview(token_store.EliasFano.of(np.array(values, np.uint64)).to_bytes()), 0)
    assert ef.all().tolist() == values and [ef.select(i) for i in range(len(values))] == values


def expect_bpe(text, tok):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))


def test_prefix_bpe_query(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op5_prefix_bpe(spark, sf_dir).collect())) == sorted((r.doc_id, *expect_bpe(r.text, library[WORD])) for r in rows)


def test_prefix_bpe_awkward(spark, library):
    df = awkward_documents(spark, long_words=3000)
    got = prefix_bpe.encode_decode(df, WORD, outputs=True).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter((r.doc_id, *expect_bpe(r.text, library[WORD])) for r in df.collect())
    assert prefix_bpe.encode_decode(empty_documents(spark), WORD).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aabeinorst'<|é \n"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_prefix_bpe_any_text(text):
    own = prefix_bpe.bpe(WORD)
    assert " ".join(w[1] for w in own.encode([text])[0]) == " ".join(map(str, own.library.encode(text, add_special_tokens=False).ids))


def check_packed(got, rows, tok, capacity):
    pieces = Counter()
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            pieces[doc_id, p, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in got) // capacity)


def test_packing_query(spark, sf_dir, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check_packed(op8_best_fit_packing(spark, sf_dir).collect(), rows, library[WORD], 4096)
    assert used <= least + 1


def test_packing_awkward(spark, library):
    df = awkward_documents(spark, long_words=3000)
    got = packing.pack(df, WORD, capacity=100, outputs=True).collect()
    check_packed(got, [(r.doc_id, r.text) for r in df.collect()], library[WORD], 100)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert packing.pack(empty_documents(spark), WORD).count() == 0


def first_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + x <= capacity]
        max(fits, key=sum).append(x) if fits else bins.append([x])
    return len(bins)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=150))
def test_plan(lengths):
    plan = packing.make_plan(Counter(lengths), 60)
    used = Counter()
    for count, gap, slots in plan.groups:
        assert count > 0 and sum(n * c for n, c, _ in slots) + gap == 60 and gap >= 0
        for n, c, _ in slots:
            used[n] += count * c
    assert used == Counter(lengths)
    assert plan.sequences <= first_fit(lengths, 60) + max(1, len(lengths) // 25)


def test_plan_uses_every_exact_combination():
    """A hot pair of lengths whose complements are many and rare: all are taken."""
    rare = [y for y in range(101, 150) if y != 125]
    plan = packing.make_plan({450: 24, 300: 24} | dict.fromkeys(rare, 1), 1000)
    assert sum(count for count, gap, _ in plan.groups if gap == 0) == plan.sequences == 24
