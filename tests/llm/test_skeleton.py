import unicodedata

import pytest

from weftgraph.llm.skeleton import LOOK_ALIKES, folding, listed, skeleton, visually_equal_pairs, with_skeleton

SAME = [
    ("Ｏｆｆｅｒ　１２！", "Offer 12!"), ("café", "café"), ("o­ff​⁠er﻿", "offer"),
    ("a b c d", "a b c d"), ("Dеаr frіеnd", "Dear friend"), ("ﬁne ﬂow", "fine flow"), ("ΑΒΕ νow", "ABE vow"),
    ("각", "각"), ("ｶﾞ", "ガ"), ("≠", "≠"), ("K", "K"), ("\U0001d41a\U0001d44f", "ab"), ("Ⅷ", "VIII"), ("ɡo", "go"),
    ("ệ", "ệ"), ("ệ", "ệ"),
    ("\u0455elf \u0430nd \u03bdow", "self and vow"), ("\u1ec7", "e\u0323\u0302"), ("\u00e9", "e\u0301"),
]
DIFFERENT = [("a", "A"), ("e", "\u00e9"), ("O", "0"), ("l", "1"), ("I", "l"), ("a.", "a!"), ("a b", "a  b"), ("a\nb", "a b"), ("ß", "ss"), ("ı", "i"), ("x²", "x2"), ("№", "No"), ("½", "1/2"), ("đ", "d"), ("’", "'"), ("…", "...")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(spark, a, b):
    assert a != b and skeleton(a) == skeleton(b) and folding(spark).skeleton(a) == folding(spark).skeleton(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(spark, a, b):
    assert skeleton(a) != skeleton(b) and folding(spark).skeleton(a) != folding(spark).skeleton(b)


def test_each_look_alike_has_one_prototype():
    alike = [c for line in LOOK_ALIKES.splitlines() for c in line.split(" ")[1]]
    assert len(alike) == len(set(alike)) and all(len(c) == 1 and unicodedata.category(c)[0] == "L" for c in alike)
    assert not set(alike) & {line[0] for line in LOOK_ALIKES.splitlines()}


def test_skeleton_is_a_fixed_point(spark):
    for f in (listed(), folding(spark)):
        for code in list(f.table):
            s = f.skeleton(chr(code))
            assert f.skeleton(s) == s and unicodedata.normalize("NFD", s) == s, hex(code)
    assert skeleton(None) is None and skeleton("") == "" and skeleton("plain text\r\n\t") == "plain text\r\n\t"


@pytest.mark.parametrize("task_rows", [0, 1_000_000])
def test_pairs(make, task_rows):
    rows = [(3, "Dear"), (1, "Dеаr"), (2, "Dear"), (2, "Dear"), (4, "dear"), (5, None), (6, ""), (7, "​"), (8, " "), (9, " "), (10, "Ｄｅａｒ"), (None, "Dеar")]
    got = sorted(tuple(r) for r in visually_equal_pairs(make(rows, "doc_id long, text string"), task_rows=task_rows).collect())
    assert got == [(1, 2), (1, 3), (1, 10), (2, 10), (3, 10)]
    assert visually_equal_pairs(make([], "doc_id long, text string")).count() == 0


def test_long_texts(make):
    a = "wоrd " * 100_000
    got = visually_equal_pairs(make([(1, a, 1), (2, "word " * 100_000, 2)], "doc_id long, text string, id long")).collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_column(make):
    d = make([(1, "ａ", "x"), (2, None, "y")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in with_skeleton(d).orderBy("doc_id").collect()] == [(1, "ａ", "x", "a"), (2, None, "y", None)]
    with pytest.raises(ValueError, match="there already"):
        with_skeleton(d, to="lang")


def test_many_copies_and_one_variant(make):
    rows = [(i, "Dear friend") for i in range(30_000)] + [(30_000, "De\u0430r friend")]
    got = visually_equal_pairs(make(rows, "doc_id long, text string"))
    assert got.count() == 30_000 and got.filter("id_b <> 30000").count() == 0


def test_more_alphabets_drawn_like_latin():
    assert skeleton("ꓐꓰꓢꓔ ⲤⲞⲢⲨ 𐐄𐐠 ᴄᴏᴢʏ ιγ") == "BEST COPY OS cozy iy"


def test_derived_letters(spark):
    f = folding(spark)
    alike = [("\u0585", "o"), ("\u03b9", "i"), ("\ua4ee", "A"), ("\u2c9f", "o"), ("\U0001042c", "o"), ("\uabaf", "c"), ("\u1d04", "c"), ("\u1d0f", "o"), ("\ua731", "s"), ("\u044c", "b")]
    assert all(f.skeleton(a) == f.skeleton(b) for a, b in alike)
    assert len(f.letters) > 2 * len(listed().letters)


def test_no_two_letters_of_one_alphabet_and_case_are_folded_by_rule(spark):
    """ASCII letters, and the two cases of a letter, stay apart; a derived letter never joins another of its alphabet."""
    f, by_hand, seen = folding(spark), listed().letters, {}
    assert [f.skeleton(c) for c in map(chr, range(33, 127))] == list(map(chr, range(33, 127)))
    for c, to in f.letters.items():
        if c not in by_hand:
            key = to, unicodedata.name(c).split()[0], c.isupper()
            assert key not in seen or key[1] == "LATIN", (c, seen[key])
            seen[key] = c
    for i in range(0x250):
        c = chr(i)
        if c.isupper() and len(c.lower()) == 1:
            assert f.skeleton(c) != f.skeleton(c.lower())


def test_case_is_folded_over_look_alikes(spark):
    f = folding(spark)
    low = lambda t: f.uncased(f.skeleton(t))
    for t in ("город вода мягкий ключь знать", "γάμμα λόγος ήτα θήτα", "բարև օր", "ꭰꮃꮅ"):
        assert low(t) == low(t.upper()), t
    assert low("Веst") == "best"
