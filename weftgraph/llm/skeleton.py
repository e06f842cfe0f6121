"""One visible form for texts that look the same (problem 8).

``skeleton`` follows the confusables idea: decompose, replace every character by its
prototype from the look-alike table, decompose again.  Two texts with equal skeletons read
the same.  What makes no visible difference is folded: width of characters and spaces, the
way accents and ligatures are encoded, invisible characters, and letters of other scripts
that are drawn like another letter.  Letter case, accents, digits, punctuation, line breaks
and the number of spaces stay different.

Look-alike letters come from two sources.  A short list in this module holds the pairs that
matter most and those that need a decision.  The rest is derived from the public confusables
data of Unicode, which Spark's ICU library carries: letters of one class are folded where they
belong to different alphabets, have the same case, and are the only letter of their alphabet
in the class, so no two letters of one alphabet become equal (``derived_letters``).

``visually_equal_pairs`` never moves texts: each text becomes two 128-bit digests in one
Arrow pass, and only digests are shuffled.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators.hot import TASK_ROWS, spread_join
from weftgraph.session import Workspace

# Each line holds a prototype and the letters of other scripts drawn like it.
LOOK_ALIKES = """
A ΑАᎪꓮ
B ΒВᏴꓐ
C СϹᏟꓚⲤ𐐕
D Ꭰꓓ
E ΕЕᎬꓰ
F Ϝꓝ
G ԌᏀꓖ
H ΗНᎻꓧⲎ
I ΙІӀꓲⲒ
J ЈᎫͿꓙ
K ΚКᏦꓗⲔ
L Ꮮꓡ𐐛
M ΜМᎷϺꓟⲘ
N ΝꓠⲚ
O ΟОՕꓳⲞ𐐄
P ΡРᏢꓑⲢ
Q Ԛ
R Ꭱꓣ
S ЅᏚՏꓢ𐐠
T ΤТᎢꓔⲦ
U Սꓴ
V ᏙѴꓦ
W ԜᎳꓪ
X ΧХꓫⲬ
Y ΥҮꓬⲨ
Z ΖᏃꓜ
a аɑα
b ь
c сϲᴄⲥ𐐽
d ԁ
e е
g ɡց
h һհ
i іιɪ
j јϳ
l ӏ
n ո
o οоᴏⲟ𐐬
p рρⲣ
q ԛ
s ѕꜱ𐑈
u υսᴜ
v νѵᴠ
w ԝᴡ
x хχ
y уγʏ
z ᴢ
ĸ κк
æ ӕ
ə ә
ɛ ε
Γ Г
Λ Л
Π П
Φ Ф
π п
φ ф
""".strip()

INVISIBLE_CATEGORIES = ("Cf", "Cc")
KEPT_CONTROLS = "\t\n\r"
# Characters without a glyph that are not of category Cf or Cc.
OTHER_INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
FOLDED_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


def _compatible(ch: str) -> str | None:
    """The full decomposition of a character whose compatibility form looks the same, else None."""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if not tag.startswith("<"):
        return None
    to = "".join(chr(int(x, 16)) for x in rest.split())
    if unicodedata.category(ch) == "Zs":
        return " "
    if tag in FOLDED_TAGS:
        return to
    if tag == "<compat>":
        name = unicodedata.name(ch, "")
        letter = unicodedata.category(ch)[0] == "L"
        joined = any(w in name for w in ("LIGATURE", "DIGRAPH", "ROMAN NUMERAL")) or (letter and len(to) > 1 and to.isalpha())
        alike = letter and len(to) == 1 and to.isalpha() and ch != "ſ"
        if joined or alike or "RADICAL" in name:
            return to
    return None


def listed_letters() -> dict[str, str]:
    """Letter -> prototype, as listed above."""
    lines = [line.split(" ") for line in LOOK_ALIKES.splitlines()]
    return {c: to for to, alike in lines for c in alike if unicodedata.category(c)[0] == "L"}


def prototypes(letters: dict[str, str]) -> dict[int, str]:
    """Code point -> prototype, for every character that has another one.

    The compatibility part comes from the rules above over the whole code space, the rest
    from ``letters``.  Every prototype is fully decomposed and maps to itself.
    """
    table = {}
    for i in range(sys.maxunicode + 1):
        ch = chr(i)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if (kind in INVISIBLE_CATEGORIES and ch not in KEPT_CONTROLS) or ch in OTHER_INVISIBLE:
            table[i] = ""
        elif 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF:  # variation selectors
            table[i] = ""
        elif kind == "Zs":
            if ch != " ":
                table[i] = " "
        elif ch in letters:
            table[i] = letters[ch]
        elif (to := _compatible(ch)) is not None:
            while (more := "".join(_compatible(c) or c for c in to)) != to:
                to = more
            table[i] = "".join(letters.get(c, c) for c in unicodedata.normalize("NFD", to) if c not in OTHER_INVISIBLE)
    return table


class _Classes:
    """Letters that are equal where case doesn't count.  Two ASCII letters never become equal."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, c: str) -> str:
        while c in self.up:
            c = self.up[c]
        return c

    def join(self, a: str, b: str) -> bool:
        a, b = sorted((self.find(a), self.find(b)))  # ASCII comes first, so it stays the root
        if a != b and b.isascii():
            return False
        if a != b:
            self.up[b] = a
        return True

    def of(self, letters: dict[str, str]) -> _Classes:
        """With each letter's two cases joined as they look after folding."""
        for c in sorted({x for c in letters for x in (c, c.swapcase()) if len(x) == 1}):
            low = c.lower()
            if low != c and len(low) == 1:
                pair = [letters.get(x, x).casefold() for x in (c, low)]
                if all(len(x) == 1 for x in pair):
                    self.join(*pair)
        return self


def _alphabet(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def _rank_of_case(c: str) -> int:
    return {"Lu": 0, "Lt": 0, "Ll": 1}.get(unicodedata.category(c), 2)


def derived_letters(skeletons: Callable[[list[str]], list[str]], listed: dict[str, str]) -> dict[str, str]:
    """Letter -> prototype, from the classes that ``skeletons``, a public confusables function,
    makes of single letters, without the letters of ``listed``.

    In each class letters of the same case are folded to an ASCII letter, else to the Latin
    letter or the letter of lowest code.  Letters without case join those with one where these
    are of one case only.  A letter stays as it is if its alphabet has several in the class, if
    it is of the prototype's own alphabet (Latin phonetic letters are taken for another one than
    ASCII), or if folding it would part it from its other case or join two ASCII letters.
    """
    plain = [chr(i) for i in range(0x41, sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "L"]
    plain = [c for c in plain if not unicodedata.decomposition(c) and c not in OTHER_INVISIBLE]
    classes: dict[str, list[str]] = {}
    for c, to in zip(plain, skeletons(plain)):
        classes.setdefault(to, []).append(c)
    found: dict[str, str] = {}
    for members in classes.values():
        groups = [[c for c in members if _rank_of_case(c) == k] for k in range(3)]
        if groups[2] and bool(groups[0]) != bool(groups[1]):
            groups = [groups[0] + groups[1] + groups[2]]
        for g in groups:
            ascii_ = [c for c in g if c.isascii()]
            latin = [c for c in g if _alphabet(c) == "LATIN" and ord(c) < 0x250]
            to = min(ascii_ or latin or g, default="")
            if len(g) < 2 or len(ascii_) > 1 or len(to.casefold()) != 1:
                continue
            alphabets = Counter(map(_alphabet, g))
            for c in g:
                own = _alphabet(c)
                phonetic = own == _alphabet(to) == "LATIN" and to.isascii() and ord(c) >= 0x250
                if c != to and c not in listed and (phonetic or (own != _alphabet(to) and alphabets[own] == 1)):
                    found[c] = to
    letters, known = dict(listed), _Classes().of(listed)
    for c in sorted(found):
        other = c.swapcase()
        if len(other) != 1 or known.join(found[c].casefold(), letters.get(other, other).casefold()):
            letters[c] = found[c]
    for c in letters:
        while letters[c] in letters:
            letters[c] = letters[letters[c]]
    return letters


class _Memo(dict):
    """A translation table that remembers characters without an entry, which str.translate
    would look up by a raised KeyError each time.  It can't outgrow the code space."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


_ASCII_INVISIBLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


class Folding:
    """The tables of one set of look-alike letters; made in the driver and sent to tasks, about 200 KB."""

    def __init__(self, letters: dict[str, str]) -> None:
        self.letters, self.table = letters, _Memo(prototypes(letters))
        classes = _Classes().of(letters)
        self.cases = _Memo({ord(c): classes.find(c) for c in classes.up})

    def skeleton(self, text: str | None) -> str | None:
        """The form shared by all texts that read the same; null stays null, empty stays empty."""
        if text is None:
            return None
        if text.isascii():
            return _ASCII_INVISIBLE.sub("", text)
        return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(self.table))

    def uncased(self, seen: str) -> str:
        """A skeleton without differences of case, also of letters whose two cases look like those of different letters."""
        return unicodedata.normalize("NFC", seen.casefold().translate(self.cases))


@lru_cache(maxsize=1)
def listed() -> Folding:
    """Folding by the listed letters alone, which needs no Spark."""
    return Folding(listed_letters())


_FOLDINGS: dict[str, Folding] = {}


def folding(spark: SparkSession) -> Folding:
    """Folding by the listed and the derived letters; made once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDINGS:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()  # noqa: SLF001
        _FOLDINGS[app] = Folding(derived_letters(lambda chars: checker.getSkeleton("\n".join(chars)).split("\n"), listed_letters()))
    return _FOLDINGS[app]


def skeleton(text: str | None) -> str | None:
    """The skeleton by the listed letters alone."""
    return listed().skeleton(text)


def with_skeleton(df: DataFrame, text: str = "text", to: str = "skeleton") -> DataFrame:
    """``df`` with one more column, the skeleton of ``text`` (null for null text).

    All other columns pass through; a column named ``to`` must not exist yet.
    """
    schema = df.schema
    if to in schema.names:
        raise ValueError(f"column {to!r} is there already")

    sent = df.sparkSession.sparkContext.broadcast(folding(df.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton = sent.value.skeleton
        for b in batches:
            made = pa.array([skeleton(t) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*schema.names, to])

    return df.mapInArrow(run, T.StructType([*schema.fields, T.StructField(to, T.StringType())]))


def skeleton_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, t0, t1, s0, s1) of every document with something visible: 128-bit digests (xxh3)
    of its text and of its skeleton, as two whole numbers each, which group and join in hash
    aggregates and unboxed sorts.

    At 10^12 documents a collision is still unlikely (about 10^-15).  Texts that are null or
    have no visible character are left out: they show nothing that could read the same.
    """

    sent = docs.sparkSession.sparkContext.broadcast(folding(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, skeleton = xxhash.xxh3_128_digest, sent.value.skeleton
        for b in batches:
            ids, own, alike = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None or not (s := skeleton(t)).strip():
                    continue
                ids.append(i)
                own.append(digest(t.encode("utf-8", "surrogatepass")))
                alike.append(digest(s.encode("utf-8", "surrogatepass")))
            halves = [np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (own, alike)]
            columns = [pa.array(np.ascontiguousarray(h[:, k])) for h in halves for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *columns], names=["id", "t0", "t1", "s0", "s1"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, t0 bigint, t1 bigint, s0 bigint, s1 bigint")


def visually_equal_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, t0, t1, s0, s1) of the documents whose skeleton is shared by at least two
    different texts; null ids and rows delivered twice are gone.

    Digests are written once, so texts are read and folded once.  A group of exact copies
    alone is no case, however large: the least and largest digest of its texts decide, so
    nothing is collected per group.
    """
    return _groups(docs, id_col, text)[0]


def _groups(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int]:
    """visually_equal_groups, and the number of its rows."""
    ws = Workspace(docs.sparkSession)
    all_ = ws.keep(skeleton_digests(docs, id_col, text), "digests")
    span = [f(c).alias(f"{n}{c}") for c in ("t0", "t1") for n, f in (("a", F.min), ("b", F.max))]
    mixed = all_.groupBy("s0", "s1").agg(*span).filter("at0 <> bt0 OR at1 <> bt1").select("s0", "s1")
    return ws.counted(all_.join(mixed, ["s0", "s1"], "left_semi").filter("id IS NOT NULL").distinct(), "groups")


def visually_equal_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", task_rows: int = TASK_ROWS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: documents whose texts are different strings with equal skeletons.

    Exact copies are never paired with each other.  Rows delivered twice under one id count
    once; null ids are left out.  An empty table gives no rows.
    """
    g, n = _groups(docs, id_col, text)
    # Pairs are formed between different texts, one row each, and then given their documents:
    # a text with a third of all rows costs what it puts out, not its square.
    classes = g.select("s0", "s1", "t0", "t1").distinct()
    other = classes.toDF("s0", "s1", "u0", "u1")
    # A skeleton of very many spellings, and a text of very many copies, are spread over tasks.
    near = spread_join(classes, other, ["s0", "s1"], "t0", n, task_rows=task_rows)
    texts = near.filter("t0 < u0 OR (t0 = u0 AND t1 < u1)").select("t0", "t1", "u0", "u1")
    left = spread_join(g.select("t0", "t1", F.col("id").alias("x")), texts, ["t0", "t1"], "x", n, task_rows=task_rows)
    both = spread_join(g.select(F.col("t0").alias("u0"), F.col("t1").alias("u1"), F.col("id").alias("y")), left, ["u0", "u1"], "y", n, task_rows=task_rows)
    return both.filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
