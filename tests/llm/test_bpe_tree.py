import random
import string

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillwork.llm.bpe_tree import VOCABULARY, TreeCodec, digests, read_ranks, tokenize

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def single(reference, data):
    """Token ids of one piece, not cut by the pattern."""
    return reference._encode_single_piece(data)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.text(alphabet="abet hin", max_size=200).map(str.encode)))
def test_pieces(ranks, reference, data):
    codec = TreeCodec(ranks)
    ids = codec.encode(data)
    assert ids == (single(reference, data) if data else [])
    assert codec.decode(ids) == data


@pytest.mark.parametrize("piece", ["a" * 5000, "ab" * 3000, " " * 4097, "=" * 2047, "the" * 1500, "äö" * 900])
def test_long_pieces(ranks, reference, piece):
    codec = TreeCodec(ranks)
    data = piece.encode()
    assert codec.encode(data) == single(reference, data)
    assert codec.decode(codec.encode(data)) == data


def test_join_is_associative(ranks):
    codec, rng = TreeCodec(ranks), random.Random(1)
    for _ in range(200):
        a, b, c = ("".join(rng.choice(string.ascii_lowercase[:6]) for _ in range(rng.randint(0, 20))).encode() for _ in range(3))
        x, y, z = codec.encode(a), codec.encode(b), codec.encode(c)
        assert codec.join(codec.join(x, y), z) == codec.join(x, codec.join(y, z)) == codec.encode(a + b + c)


def test_texts(make_docs, odd_rows, reference):
    rows = [*odd_rows, (8, "<|endoftext|> it's  \n\n x"), (9, "don't\tstop\r\n" * 50)]
    out = tokenize(make_docs(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_digests_of_an_empty_table(make_docs):
    out = digests(make_docs([]))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0
