import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm.tokens import Encoder, encode_documents, read_ranks, serialise_model
from quarrymill.session import tokenizer_folder

pytestmark = pytest.mark.skipif(not os.path.isdir(tokenizer_folder()), reason="no vocabulary")
HARD = ["", " \n\n x  ", "<|endoftext|> <unk> ▁▁", "日本語テキスト𠀀😀", "\x00\x01퟿", "a" * 5000, "中" * 3000, "I'll we've 123 4.5\t\r\n", "Ünïcödé\xa0 한국어"]


@pytest.fixture(scope="module")
def both():
    import base64

    import tiktoken

    from quarrymill.llm.tokens import PRE_TOKENS

    with open(os.path.join(tokenizer_folder(), "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(serialise_model(read_ranks())), tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


def test_same_as_library(both):
    own, other = both
    for text in HARD:
        ids = own.encode_batch([text])[0].tolist()
        assert ids == other.encode_ordinary(text) and own.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(both, text):
    own, other = both
    ids = own.encode_batch([text])[0].tolist()
    assert ids == other.encode_ordinary(text) and own.decode(ids) == text


def test_table(spark, both):
    rows = [(i, t, "tokens", "ids") for i, t in enumerate([*HARD, None, None])]
    got = {r.doc_id: r.ids for r in encode_documents(spark.createDataFrame(rows, "doc_id long, text string, tokens string, ids string")).collect()}
    assert [got[i] for i in range(len(rows))] == [both[1].encode_ordinary(t or "") for _, t, _, _ in rows]
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
