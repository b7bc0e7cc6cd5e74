"""Packing, token files and byte-level BPE against the tokenizers run text by text."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from qaspark.llm import byte_bpe, common, packing, token_files
from qaspark.session import checkpoint_path

WORDS, BYTES, RANKS = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
TEXTS = [None, "", "a  b", "don't  they'll \r\n\t z\x85 q", "<|endoftext|> a", "日本語 テスト 😀", "trail   ", "a\n b\n\n  c", "İΣ ΑΣ é ́x", "word. " * 700, "12345 6789a b1",
         "Same text.", "Same text.", "it''s 's 're  'll", "a.b,c ., x..y", "\n", " ", "Ends here.\nNext line, again."]


def table(spark, texts=TEXTS):
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, place int")


def library_ids(path, text, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_has_each_id_once(spark):
    want = {i if i != 3 else None: library_ids(WORDS, t, 1) for i, t in enumerate(TEXTS)}
    rows = packing.pack(table(spark).repartition(3), WORDS, seq_len=64).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and len(got.setdefault(r.doc_id, [])) == r.start and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id] += ids
    assert got == want
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    last = max(sequences)
    assert sorted(sequences) == list(range(last + 1)) and all(n == 64 for s, n in sequences.items() if s < last)
    whole = packing.sequences(spark.createDataFrame(rows, packing.PIECES)).collect()
    assert sum(r.length for r in whole) == sum(map(len, want.values())) and all(len(r.ids) == 4 * r.length for r in whole)


def test_packing_of_documents_without_ids(spark):
    """A table, a partition and a slice of empty documents alone: each is its end id."""
    rows = [(i, t) for i, t in enumerate(["", None, " ", "\n\t "] * 300)]
    for d in (spark.createDataFrame(rows[:3], "doc_id long, text string").coalesce(1), spark.createDataFrame(rows, "doc_id long, text string").repartition(2)):
        got = packing.piece_digests(d, WORDS).collect()
        assert {(r.start, r.length, r.doc_tokens, r.ids_crc32) for r in got} == {(0, 1, 1, crc([1]))} and len(got) == d.count()
        assert sorted(r.offset for r in got) == list(range(len(got)))
    mixed = spark.createDataFrame([*rows, (5000, "some words")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.doc_tokens for r in packing.piece_digests(mixed, WORDS).collect()}[5000] == len(library_ids(WORDS, "some words", 1))


@pytest.mark.parametrize("text", ["\"'sİ.", "İ", "aİ,b İstanbul.", "<|startoftext|> x <|endoftext|>", "long " * 60_000 + "İ", "x" * 150_000])
def test_odd_and_long_texts_have_the_librarys_ids(spark, text):
    d = spark.createDataFrame([(1, text), (2, "plain words, here.")], "doc_id long, text string")
    ids = {}
    for r in sorted(packing.pack(d, WORDS).collect(), key=lambda r: r.start):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert ids == {1: library_ids(WORDS, text, 1), 2: library_ids(WORDS, "plain words, here.", 1)}


def test_packing_of_nothing(spark):
    assert packing.pack(table(spark).where("false"), WORDS).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours_are_one_step_apart(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_like_documents_are_neighbours():
    a, b = np.arange(100, 400), np.arange(5000, 5300)
    key = packing.document_key([a, b, np.append(a, 7), np.append(b, 7), np.zeros(0, int)], 49408)
    assert abs(key[0] - key[2]) < abs(key[0] - key[1]) and abs(key[1] - key[3]) < abs(key[0] - key[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1))))
def test_variable_length_code_round_trip(ranks):
    a = np.array(ranks, np.uint32)
    control, data = token_files.pack_ranks(a)
    assert len(control) == -(-len(a) // 4) and len(data) == sum(max(1, (x.bit_length() + 7) // 8) for x in ranks)
    assert token_files.unpack_ranks(control, data, len(a)).tolist() == ranks


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 300)
    folder = checkpoint_path(spark, "test-files")
    token_files.write_token_files(table(spark).repartition(3), folder, BYTES)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *[i for i in range(len(TEXTS)) if i != 3]]
    start = 0
    for r in got:
        want = library_ids(BYTES, TEXTS[3 if r.doc_id is None else r.doc_id], 2)
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (start, len(want), want)
        start += len(want)
    digest = token_files.token_file_digests(spark, table(spark), BYTES).where("doc_id = 5").first()
    assert digest.ids_crc32 == crc(library_ids(BYTES, TEXTS[5], 2))


def test_token_files_of_nothing(spark):
    assert token_files.token_file_digests(spark, table(spark).where("false"), BYTES).count() == 0


def reference(text):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})
    return enc.encode_ordinary(text or "")


def test_byte_bpe_matches_tiktoken(spark):
    docs = table(spark)
    both = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    for r in both.collect():
        text = TEXTS[3 if r.doc_id is None else r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == reference(text) and bytes(r.decoded) == (text or "").encode()


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_any_text(text):
    import pyarrow as pa

    codec = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    (ids,) = codec.encode(pa.array([text]))
    assert np.frombuffer(ids, "<u4").tolist() == reference(text) and codec.decode(ids) == text.encode()


@pytest.mark.parametrize(("path", "cut", "separator"), [(WORDS, common.WORDS, " \x01 "), (BYTES, common.BYTE_LEVEL, "\n")])
def test_words_of_letters_do_not_pass_the_pre_tokenizer(monkeypatch, path, cut, separator):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    passed = []

    class Watched:
        normalizer, pre_tokenizer, model, encode = t.normalizer, t.pre_tokenizer, t.model, staticmethod(t.encode)
        get_vocab_size = staticmethod(t.get_vocab_size)

        @staticmethod
        def encode_batch_fast(texts, **kw):
            passed.extend(texts)
            return t.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(common, "tokenizer", lambda _: Watched)
    common.forget_chunks()
    letters = "".join(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha())
    texts = ["Words of letters únd ßœ only", letters, f"x {letters.lower()} X", "it's 5 o'clock Ÿ ĳ ×÷ tabs\there ﬁ", ""]
    try:
        got = common.library_encoder(path, cut, separator)(pa.array(texts, pa.string()))
    finally:
        common.forget_chunks()
    encoder_type = common.id_type(path)
    assert [np.frombuffer(x, encoder_type).tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert "clock" in "".join(passed) and "only" not in "".join(passed)
