"""Encoding a corpus with a public byte-level BPE tokenizer (problem 6).

A text is cut into pieces by the tokenizer's pattern; each distinct piece is encoded once
and remembered.  A piece that is no token itself goes through an Aho-Corasick automaton over
all tokens, bytes taken as Latin-1 characters: from the matches follow the longest token at
each place and, by the chain of its prefixes, all shorter ones.  A left-to-right walk takes
the longest token, steps back where two adjacent tokens cannot stand side by side in a
result of the merges, and never visits a position twice once it is known to fail.  Whether
two tokens can be adjacent is found by undoing their merges, and remembered.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

DEFAULT_VOCABULARY = os.environ.get("WEFTGRAPH_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
# Fixed value: the public pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES_KEPT = 200_000
PAIRS_KEPT = 1_000_000


@lru_cache(maxsize=1)
def byte_of_letter() -> dict[str, str]:
    """The printable letter that stands for each byte in vocabulary files -> that byte as Latin-1."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): chr(b) for b in printable} | {chr(256 + k): chr(b) for k, b in enumerate(others)}


def read_vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """(token as Latin-1 -> id, merges in order) of a tokenizers JSON file of kind BPE."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_of_letter()
    special = {t for t in model["vocab"] if any(c not in letters for c in t)}
    plain = {t: "".join(map(letters.__getitem__, t)) for t in model["vocab"] if t not in special}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {plain[t]: i for t, i in model["vocab"].items() if t in plain}, [(plain[a], plain[b]) for a, b in pairs]


class Encoder:
    """Exact byte-level BPE in time linear in a piece's length."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]]) -> None:
        import ahocorasick

        # A token's rank orders the merges: single bytes below all of them.
        self.rank = {t: k - len(ids) for k, t in enumerate(t for t in ids if len(t) == 1)}
        made: dict[str, tuple[str, str]] = {}
        for k, (a, b) in enumerate(merges):
            if a + b in ids and a + b not in made:
                made[a + b] = (a, b)
                self.rank[a + b] = k
        self.made, self.ids = made, {t: i for t, i in ids.items() if t in self.rank}
        self.pair_rank = {p: self.rank[t] for t, p in made.items()}
        self.find = ahocorasick.Automaton()
        for t in self.ids:
            self.find.add_word(t, t)
        self.find.make_automaton()
        self.pieces: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cut = regex.compile(PATTERN).findall

    def shorter(self, token: str) -> str:
        """The longest token that is a proper prefix; empty if there is none."""
        for n in range(len(token) - 1, 0, -1):
            if token[:n] in self.ids:
                return token[:n]
        return ""

    def adjacent(self, left: str, right: str) -> bool:
        """Whether the merges can end with these two tokens side by side.

        They can't if, at some moment while both were built, the pieces that met at their
        border formed a pair with an earlier turn than the merge that came next there.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, before = left, right, len(self.rank) + 1
        rank, made, ok = self.rank, self.made, True
        while True:
            met = self.pair_rank.get((a, b))
            if met is not None and met < before:
                ok = False
                break
            # Undo the later of the two last merges at the border; of equal turns, the right
            # one is undone first, as the left one was merged first.
            if rank[a] > rank[b]:
                if a not in made:
                    break
                before, a = rank[a], made[a][1]
            else:
                if b not in made:
                    break
                before, b = rank[b] + 1, made[b][0]
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        self.pairs[left, right] = ok
        return ok

    def piece(self, piece: str) -> list[int]:
        """The ids of one piece, given as Latin-1."""
        if piece in self.ids:
            return [self.ids[piece]]
        longest: list[str] = [""] * len(piece)
        for end, token in self.find.iter(piece):
            start = end - len(token) + 1
            if len(token) > len(longest[start]):
                longest[start] = token
        n, taken, at, token = len(piece), [], 0, longest[0]
        open_ = bytearray(b"\1" * (n + 1))  # 0: no result can have a border here
        while at < n:
            while token and not (open_[at + len(token)] and (not taken or self.adjacent(taken[-1], token))):
                token = self.shorter(token)
            if token:
                taken.append(token)
                at += len(token)
                token = longest[at] if at < n else ""
            else:
                open_[at] = 0
                token = taken.pop()
                at -= len(token)
        return [self.ids[t] for t in taken]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, special tokens' strings taken as ordinary text."""
        out: list[int] = []
        known = self.pieces
        for p in self.cut(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "replace").decode("latin-1"))
                if len(p) <= 64:
                    if len(known) >= PIECES_KEPT:
                        known.clear()
                    known[p] = ids
            out.extend(ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


def token_ids(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every text, one row for each row of ``docs``.

    Empty and null text both give an empty list.  No shuffle: each row is encoded where it is
    read.  The vocabulary file is read by the driver and sent to the tasks, at most a few MB
    whatever the corpus's size; each Python worker builds its automaton once.
    """
    sent = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    name = f"{vocabulary}:{os.path.getmtime(vocabulary)}"
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(name)
        if encoder is None:
            encoder = _ENCODERS[name] = Encoder(*sent.value)
        for b in batches:
            ids = [encoder.encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
