import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logsift.llm import packing, tokenizing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizing.tokenizer_path("word_bpe_49k.json"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def column(texts):
    import pyarrow as pa
    return pa.array(texts, pa.string())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .,'|<>-\n\té́  İΣsSt$" , max_size=40), max_size=6))
def test_parts_give_the_library_tokens(texts):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizing.tokenizer_path("word_bpe_49k.json"))
    enc = tokenizing.encoder("word_bpe_49k.json")
    ids, off = tokenizing.encode_column(enc, column(texts))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [ids_of(lib, t) for t in texts]


def test_special_strings_keep_their_case(library):
    enc = tokenizing.encoder("word_bpe_49k.json")
    texts = ["a<|endoftext|>b", "A<|ENDOFTEXT|>B", "x <|startoftext|>"]
    ids, off = tokenizing.encode_column(enc, column(texts))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [ids_of(library, t) for t in texts]


def test_long_texts_in_parts_count_the_same(library):
    text = "some words, here " * 3000
    enc = tokenizing.encoder("word_bpe_49k.json")
    assert tokenizing.encode_column(enc, column([text]), 1000, counts_only=True)[0] == len(ids_of(library, text))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(messy, name):
    assert tokenizing.count_tokens(messy, name).count() == messy.count()


def test_counts(messy, library):
    got = sorted(tuple(r) for r in tokenizing.count_tokens(messy).where("doc_id is not null").collect())
    want = sorted((r.doc_id, len((r.text or "").encode()), n := len(ids_of(library, r.text)), n > 2048)
                  for r in messy.where("doc_id is not null").collect())
    assert got == want


def test_pack_holds_every_id_once(messy, library):
    docs = messy.where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = packing.pack(docs, seq_len=64).collect()
    want = {r.doc_id: ids_of(library, r.text) + [2] for r in docs.collect()}
    held = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(held.setdefault(p.doc_id, []))
        assert p.length == len(p.ids) // 4 and p.offset + p.length <= 64
        held[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert held == want
    stream = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    at = 0
    for s, o, n in stream:
        assert s * 64 + o == at
        at += n


def test_pack_digest_and_empty(messy, nothing):
    pieces = packing.pack(messy)
    digest = packing.piece_digest(pieces).columns
    assert digest == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.selectExpr("count(distinct doc_id)").first()[0] == messy.selectExpr("count(distinct doc_id)").first()[0]
    one = pieces.where("doc_id = 3").first()
    assert one.length == 1 and zlib.crc32(one.ids) == zlib.crc32((2).to_bytes(4, "little"))
    assert packing.pack(nothing).count() == 0 and tokenizing.count_tokens(nothing).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()
