import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docloom.llm import records
from docloom.llm.common import new_path, table

from .helpers import ODD, documents

SF = "/root/testdata/sf0.001"
#: Texts in which a word's ids depend on composing, folding, special tokens or neighbouring marks.
HARD = [
    "5 m²) of ½! ½", "café å Ȧ, é́", "<|ENDOFTEXT|> <|StartOfText|> a<|endoftext|>b <|startoftext|>", "İ, İ. ΣΑΣ. ΟΔΟΣ ǅ ß ẞ ſt",
    "it's IT'S 'LL don't o'clock ''s 's't 'd'm, (), .,. a,.b !?, )... «mot», l’été — naïve", "a b c\x1cd\x85e\tf\r\ng\x0bh ﻿i", "1234 ١٢ Ⅷ x1y2_z _a_ 3.14 1,000",
    "日本語テキスト、 한국어 हिन्दी 👩‍👩‍👧 🇩🇪", "× ÷ ª º µ Å Å Ω ﬁ", "\x00 \x7f \x80", "...,, a., '", "aaaa" * 9_000,
]


def whole(texts):
    t = Tokenizer.from_file(records.TOKENIZER)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def parted(words, texts):
    flat, n = words.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


def expected(rows):
    start, out = 0, []
    for i, own in sorted(zip([i for i, _ in rows], whole([x for _, x in rows])), key=lambda r: r[0]):
        ids = np.array(own + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_ids_of_hard_texts(monkeypatch):
    words = records.Words(records.TOKENIZER)
    assert words.plain and parted(words, HARD + ODD) == whole(HARD + ODD)
    monkeypatch.setattr(records, "PIECES_KEPT", 3)  # the store starts anew all the time
    assert parted(words, HARD + ODD) == whole(HARD + ODD)
    words.plain = False
    assert parted(words, HARD) == whole(HARD)


def test_ids_of_random_texts():
    rng, words = random.Random(3), records.Words(records.TOKENIZER)
    parts = [*"abzAZéÀÿß'’.,;!?()<|>-_09²½ \n\t́̇İΣ× ", "'s", "'LL", "<|endoftext|>", "<|EndOfText|>", "word", "WORD,", " the "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4_000)]
    assert parted(words, texts) == whole(texts)


def test_slices_cover_all_rows():
    assert records._slices(pa.array(["ab", None, "c" * 9, "", "d", "ef"]), 4) == [(0, 2), (2, 3), (3, 6)]
    assert records._slices(pa.array([], pa.string())) == []


def test_round_trip(spark):
    texts, folder = ODD + HARD, new_path(spark, "t")
    back = records.read_records(records.write_records(documents(spark, texts), folder, files=3), folder)
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in back.collect())
    assert got == expected(list(enumerate(texts)))


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (3, "x"), (3, "x"), (3, None), (1, "c"), (None, "")]
    folder = new_path(spark, "t")
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, ids int, `check` string")
    back = records.read_records(records.write_records(docs, folder, files=3), folder).collect()
    assert sorted(str(r.doc_id) for r in back) == ["1", "3", "3", "3", "None", "None"]
    back.sort(key=lambda r: r.start)
    assert [r.doc_id for r in back] == [None, None, 1, 3, 3, 3]
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back)])[:-1].tolist()


def test_query_matches_the_library(spark):
    got = sorted(map(tuple, records.query(spark, SF).collect()))
    assert got == expected([(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()])


def test_empty_table(spark):
    folder = new_path(spark, "t")
    assert records.read_records(records.write_records(documents(spark, ODD).limit(0), folder), folder).count() == 0


def test_damage_is_found():
    data = bytearray(records.frame(b"abcd"))
    assert records.unframe(bytes(data)) == (b"abcd", 20)
    data[14] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(data))
