import random
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanery.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "   ", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "İstanbul ǅ ß ẞ Σας ΌΔΟΣ", "é ́x áb", "don't it's 'tis I'LL",
    "  x y\x85z w ", "١٢٣ 12345 a1b2", "日本語テスト。混在text", "🙂👍🏽 ok", "\x00\x01 a", "ÀÉÎ ñÑ ÿŸ ×÷ªº", "x" * 700, "ab'cd ''s 's",
    "ﬁ Å K Ω", "-- ... !!! ?! #tag @me a-b a.b,c", "|<|endoftext| >", "각", "a‍b ﻿x ­q", "the cat, sat. ON (the) mat;",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(3))
def test_chunks_agree_with_the_whole_text(library, seed):
    draw = random.Random(seed)
    encoder = bpe.ChunkEncoder(PATH)
    texts = ODD + ["".join(draw.choice([*ODD, " ", "\n", "the ", "Of", "é", "'s", " <|"]) for _ in range(draw.randint(1, 40)))
                   for _ in range(300)]
    for text in texts + texts[:50]:
        ids, decoded = encoder.encode(text.encode())
        assert (np.frombuffer(ids, "<u4").tolist(), decoded) == expected(library, text)
    assert len(encoder.chunks) > 10


def test_little_room_for_chunks_changes_nothing(library, monkeypatch):
    for name in ("KEPT_CHUNKS", "KEPT_WORDS", "KEPT_PIECES"):
        monkeypatch.setattr(bpe, name, 2)
    encoder = bpe.ChunkEncoder(PATH)
    for text in [*ODD, " ".join(ODD)] * 2:
        ids, decoded = encoder.encode(text.encode())
        assert (np.frombuffer(ids, "<u4").tolist(), decoded) == expected(library, text)


def test_rows_of_a_table(documents, library):
    texts = [None, *ODD, "word " * 60_000, "w" * 20_000, ODD[-1], ODD[-1]]
    rows = documents(*texts).withColumn("ids", F.lit("mine"))
    got = bpe.encode_documents(rows, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = expected(library, texts[r.doc_id])
        assert (np.frombuffer(r.ids, "<u4").tolist(), r.decoded, r.n_tokens) == (ids, decoded, len(ids))
    assert bpe.encode_documents(rows.where("false"), PATH).count() == 0


def test_another_kind_of_tokenizer_is_left_to_its_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, encoder = Tokenizer.from_file(path), bpe.ChunkEncoder(path)
    assert not encoder.plain
    for text in ODD[5:]:
        ids, decoded = encoder.encode(text.encode())
        assert np.frombuffer(ids, "<u4").tolist() == other.encode(text, add_special_tokens=False).ids
        assert decoded == other.decode(other.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_known_words_take_no_call_each():
    encoder, calls = bpe.ChunkEncoder(PATH), []
    draw = random.Random(1)
    words = [f"{a}{b}," for a in ("the", "cat", "Over") for b in "abcdefghij"]
    first, second = (" ".join(draw.choice(words) for _ in range(4_000)).encode() for _ in range(2))
    encoder.encode(first)
    sys.setprofile(lambda frame, event, arg: event == "call" and calls.append(frame.f_code.co_name))
    try:
        encoder.encode(second)
    finally:
        sys.setprofile(None)
    assert len(encoder.chunks) > 100 and len(calls) < 2_000
