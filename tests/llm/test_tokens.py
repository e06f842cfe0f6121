import os
import random

import pytest

from weftgraph.llm.tokens import DEFAULT_VOCABULARY, PATTERN, Encoder, read_vocabulary, token_ids

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(*read_vocabulary(DEFAULT_VOCABULARY))


def texts():
    r = random.Random(7)
    odd = ["", " ", "\n\n \t", "<|endoftext|>", "a" * 2500, "ab" * 900, "'ll'VE's it's", "\x00\x01", "é" * 300, "日本語のテキスト" * 60, "1234567890" * 90, "=-" * 500, "👩‍🔧🇪🇺 é", "Ｆｕｌｌ width"]
    odd += ["".join(r.choice("abetinsor ") for _ in range(300)) for _ in range(60)]
    odd += ["".join(chr(r.choice([*range(32, 127), *range(160, 800), *range(0x4E00, 0x4E60), *range(0x1F600, 0x1F640)])) for _ in range(150)) for _ in range(60)]
    return odd


def test_same_ids_as_the_public_tokenizer(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    for text, want in zip(texts(), t.encode_batch(texts(), add_special_tokens=False)):
        assert encoder.encode(text) == want.ids, ascii(text[:60])


def test_round_trip(encoder):
    token = {i: t for t, i in encoder.ids.items()}
    for text in texts():
        assert b"".join(token[i].encode("latin-1") for i in encoder.encode(text)).decode() == text


def test_pattern_covers_every_character():
    import regex

    for text in texts():
        assert "".join(regex.findall(PATTERN, text)) == text


def test_rows(make, spark):
    d = make([(1, "Hello world", "x"), (2, "", "y"), (3, None, "z"), (3, None, "z")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in token_ids(spark, d).orderBy("doc_id").collect()]
    assert got == [(1, [15496, 995]), (2, []), (3, []), (3, [])]
    assert token_ids(spark, d.limit(0)).count() == 0
