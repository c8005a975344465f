import hashlib

import numpy as np
import public_tokenizers
import pytest

from docloom.llm import bpe

from .helpers import ODD, documents


def expected(text):
    ids = np.array(bpe.encoder(bpe.RANKS, public_tokenizers.PATTERN).encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (1_000, 100), (16_384, 1_024)])
def test_matches_the_library(spark, chunk, overlap):
    docs = documents(spark, ODD).union(documents(spark, ODD[:6] + [ODD[6]] * 1))
    got = sorted(map(tuple, bpe.encode_decode(docs, chunk=chunk, overlap=overlap, digest=True).collect()))
    assert got == sorted((i, *expected(t)) for x in (ODD, ODD[:7]) for i, t in enumerate(x))


def test_round_trip_and_empty_table(spark):
    docs = documents(spark, ODD)
    for r in bpe.encode_decode(docs, chunk=500, overlap=50).collect():
        assert r.decoded == (ODD[r.doc_id] or "").encode() and bpe.decode(np.frombuffer(r.ids, "<u4")) == r.decoded
    assert bpe.encode_decode(docs.limit(0)).count() == 0


def test_copies_of_a_long_text_are_encoded_once(spark):
    text = "many words, again and again. " * 40
    rows = [(5, text)] * 300 + [(6, text)] * 2 + [(None, text)] * 3 + [(5, text + "!")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, copies int").repartition(4)
    found = bpe.encode_decode(docs, chunk=100, overlap=30, digest=True)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((i, *expected(t)) for i, t in rows), key=str)
