import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm.leaks import FMIndex, leak_spans, leaked_items, removal_spans, shard_indexes, suffix_array, words

PASSAGE = "Near Velbeck the old archive holds 886 cogs while the painted brewery holds 544 planks in 774 rows"


@given(st.lists(st.integers(0, 4), min_size=1, max_size=120))
@settings(max_examples=60, deadline=None)
def test_index_finds_every_phrase(body):
    s = np.array([0, *body, 0], np.int32)
    sa = suffix_array(s)
    assert sorted(sa.tolist()) == list(range(len(s)))
    index = FMIndex.of(s, 4, sample=4)
    phrases = sorted({tuple(body[i : i + 3]) for i in range(len(body) - 2) if 0 not in body[i : i + 3]} | {(1, 2, 3), (4, 4, 4)})
    which, low, high = index.search(np.array(phrases, np.int32).reshape(-1), np.arange(len(phrases)) * 3, 3)
    found = {phrases[p // 3]: sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(which, low, high)}
    text = s.tolist()
    want = {p: [i for i in range(len(text)) if tuple(text[i : i + 3]) == p] for p in phrases}
    assert found == {p: at for p, at in want.items() if at}


def test_words():
    assert words("<p class='a b'>It&#39;s&nbsp;ＦＩＮＥ [quote=x]café[/quote] n­ow</p>") == ["it", "s", "fine", "café", "now"]
    assert words("Веst оf") == ["best", "of"] and words("Straße") == words("STRASSE")
    assert words("ВОДА в НИКУ") == words("вода В нику")
    assert words(None) == words("") == words("... --") == []


@pytest.fixture(scope="module")
def items(make):
    rows = [(1, PASSAGE + ". First question?", "a"), (2, PASSAGE + ". Second one here?", "b"), (3, "only a few words", "c"), (4, None, "d"), (5, "", "e"), (None, PASSAGE, "f")]
    return make(rows, "item_id long, text string, doc_id string")


@pytest.fixture(scope="module")
def docs(make):
    w = PASSAGE.split()
    rows = [
        (1, "Look: " + PASSAGE.upper() + "!"),
        (2, "just eleven: " + " ".join(w[:11])),
        (3, "twelve: " + " ".join(w[:12]) + " and more"),
        (4, "broken " + " ".join(w[:8]) + " X " + " ".join(w[8:])),
        (5, "<b>" + "</b>\n> <b>".join(w) + "</b>"),
        (6, PASSAGE.replace("a", "а").replace("e", "е") + ". Second one here"),
        (7, None), (8, ""), (9, " ".join(["x"] * 5000) + " " + PASSAGE), (1, "Look: " + PASSAGE.upper() + "!"), (None, PASSAGE),
    ]
    return make(rows, "doc_id long, text string")


@pytest.mark.parametrize("options", [{}, {"shard_words": 10}, {"shard_words": 13}, {"shard_words": 30}, {"block_bytes": 50}])
def test_leaks(spark, docs, items, options):
    got = {(r.doc_id, r.item_id) for r in leaked_items(spark, docs, items, **options).collect()}
    assert got == {(d, i) for d in (1, 3, 5, 6, 9) for i in (1, 2)}


@pytest.mark.parametrize("options", [{}, {"shard_words": 14, "block_bytes": 200}])
def test_spans(spark, docs, items, options):
    rows = leak_spans(spark, docs, items, **options).collect()
    spans = {(r.doc_id, r.item_id): (r.start_word, r.end_word) for r in rows}
    assert len(rows) == len(spans) == 10
    assert spans[1, 1] == spans[1, 2] == (1, 19) and spans[3, 1] == (1, 13)
    assert spans[6, 1] == (0, 18) and spans[6, 2] == (0, 21) and spans[9, 1] == (5000, 5018)
    merged = {r.doc_id: (r.start_word, r.end_word, r.n_items) for r in removal_spans(spark, docs, items).collect()}
    assert merged[6] == (0, 21, 2) and merged[1] == (1, 19, 2)


def test_nothing(spark, docs, items):
    assert leaked_items(spark, docs, items.limit(0)).count() == 0
    assert leaked_items(spark, docs.limit(0), items).count() == 0


def test_one_index_serves_many_sets(spark, docs, items):
    shards = shard_indexes(spark, docs, shard_words=200)
    assert shards.count() > 1
    for chosen in ("item_id = 1", "item_id = 2", "item_id = 3"):
        part = items.filter(chosen)
        assert sorted(leaked_items(spark, docs, part, shards=shards).collect()) == sorted(leaked_items(spark, docs, part).collect())


@pytest.mark.parametrize(
    "before, after",
    [
        ('<a href="http://ferolm.example/409\n\n', "\n--\nquilbrun82 > everything"),
        ('<a href="http://ferolm.example/409 ', ' he said "so">'),
        ('[quote]<a href="http://korvane.example/685[/quote]\n', "\n> quoted"),
        ("[I wrote: ", "]"),
        ("[url=http://ferolm.example/409\n\n", "\n[1]"),
        ("x <y and ", " > z"),
        ("<!see ", ">"),
    ],
)
def test_text_behind_broken_tags_is_searched(before, after):
    w = words(before + PASSAGE + after)
    assert " ".join(words(PASSAGE)) in " ".join(w)


def test_tags_with_their_attributes_are_no_words():
    assert words('<img src=a.png alt="a > b" hidden/>x<td nowrap>y</td ><br/>[img width=5 alt="a b"]z<!DOCTYPE html>') == ["x", "y", "z"]
    assert words('one <a href="http://ferolm.example/409\ntwo <a href="x" title="a b">three</a> [url=http://ferolm.example/409\nfour') == ["one", "two", "three", "four"]


@pytest.mark.parametrize("c", ["\x00", "\x08", "\x0b", "\x0c", "\x0e", "\x1f", "\x7f"])
def test_invisible_controls_do_not_split_words_of_ascii_texts(c):
    assert words(f"arc{c}hive") == words(f"arc{c}hive é")[:1] == ["archive"]


def test_case_of_letters_whose_capital_has_another_prototype():
    assert words("ГОРОД Γάμμα") == words("город γάμμα") and words("ꓐꓰꓢꓔ ᴄᴏᴢʏ") == ["best", "cozy"]
