import hashlib
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taskloom.llm import pieces
from tests.llm import corpus

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
if not os.path.exists(PATH):
    pytest.skip("no vocabulary", allow_module_level=True)
with open(PATH, "rb") as f:
    PROTO = f.read()


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return pieces.PieceModel(PROTO), sentencepiece.SentencePieceProcessor(model_proto=PROTO)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tabcdehilnorst▁<0x>é€中文的\x00�😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_is_encoded_as_the_library_does(both, text):
    own, library = both
    ids = library.encode(text)
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(300, 31_999), max_size=40))
def test_pieces_put_together(both, ids):
    own, library = both
    text = "".join(library.id_to_piece(i).replace("▁", " ") for i in ids)
    assert own.encode(text) == library.encode(text)


def test_long_words_and_small_groups(both, monkeypatch):
    own, library = both
    texts = ["ab" * 5000 + "a" * 3000, "the" * 4000, " " * 900, "▁ ▁", "x" + " y" * 3000, "word中" * 500]
    for group in (64, 1 << 20):
        monkeypatch.setattr(pieces, "GROUP_BYTES", group)
        for t in texts:
            assert own.encode(t) == library.encode(t)


@pytest.mark.parametrize("group", [200, 3 << 20])
def test_tables(spark, both, monkeypatch, group):
    monkeypatch.setattr(pieces, "GROUP_BYTES", group)
    _, library = both
    data = [*corpus.rows(), (None, None, None, None, None), (0, "again", None, None, 5)]
    df = corpus.frame(spark, data).withColumnRenamed("lang", "ids")
    got = pieces.encode(df, PROTO, decoded="decoded").collect()
    assert len(got) == len(data)
    for r in got:
        ids = library.encode(r.text or "")
        assert list(r.ids) == ids and r.decoded == library.decode(ids)
    for r in pieces.encode(df, PROTO, digests=True).collect():
        ids = library.encode(r.text or "")
        want = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *want]
    assert pieces.encode(df.limit(0), PROTO).count() == 0


def test_stretches_are_told_by_their_bytes(both, monkeypatch):
    """Also where all hashes are one."""
    from taskloom.llm import _words

    own, library = both
    monkeypatch.setattr(_words, "_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    for t in ("the cat and the hat", "a bb ccc " * 20, "longer words than eight letters longer words than eight numbers"):
        assert own.encode(t) == library.encode(t)


def test_tables_are_built_once():
    assert pieces.loaded(PROTO) is pieces.loaded(bytes(bytearray(PROTO)))
