"""Byte-level BPE against the tokenizer library, and the round trip."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import ODD

from pagegrain.llm import bpe
from pagegrain.llm.queries import byte_bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def want(key, text):
    ids = LIBRARY.encode_ordinary(text or "")
    return key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_texts(docs_of):
    got = [tuple(r) for r in byte_bpe(docs_of(ODD)).collect()]
    assert sorted(got, key=repr) == sorted((want(*r) for r in ODD), key=repr)


def test_whole_table(spark, sf, texts):
    got = {tuple(r) for r in byte_bpe(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == {want(k, t) for k, t in texts.items()}


def test_empty_table(docs_of):
    assert byte_bpe(docs_of([]).where("false")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=120) | st.text(alphabet="ab'slt \n ", max_size=80))
def test_merges_and_pieces(text):
    import regex
    pieces = [w.encode() for p in bpe.PIECES.findall(text) for w in regex.findall(public_tokenizers.PATTERN, p)]
    assert [i for w in pieces for i in bpe.merged(w, RANKS)] == LIBRARY.encode_ordinary(text)


def test_unknown_id_fails(spark):
    with pytest.raises(Exception, match="not in the token table"):
        bpe.decode(spark.createDataFrame([([60_000],)], "ids array<int>"), RANKS).collect()
    assert bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), RANKS).select("decoded").collect() == [(None,), (bytearray(b""),)]
