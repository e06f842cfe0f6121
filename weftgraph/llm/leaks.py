"""Evaluation texts that leak into a corpus (problem 7).

The corpus becomes FM-indexes, one per shard of a bounded number of words, over all words of all
documents.  Each is built inside one task and written as a row of a table, which serves any
number of evaluation sets and of blocks of one.  The evaluation side is every stretch of ``n``
consecutive words of an item; all stretches of a block are searched backward at once, through
the ranks of a wavelet matrix; occurrences are located by sampled suffix positions, and
overlapping stretches of one item are merged to spans.

Symbols are words.  A shard numbers its own words; between shards and items words meet by their
64-bit digests, so a false match needs twelve colliding words in a row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.skeleton import Folding, folding, listed
from weftgraph.session import Workspace

# Names of bracket tags of forum markup.
BRACKET_TAGS = "b i u s quote code url img size color colour list li spoiler center left right font email sub sup pre table tr td th youtube video"
# Attributes of markup that stand without a value.
BARE_ATTRIBUTES = (
    "allowfullscreen async autofocus autoplay checked clear compact controls declare default defer deleted disabled hidden inert ismap itemscope "
    "loop multiple muted nohref noresize noshade novalidate nowrap open playsinline readonly required reversed selected"
)
# A tag is its name and well-formed attributes, so one that is never closed cannot reach over
# the text behind it to some later bracket; of such a tag the name and each attribute up to
# white space are removed.
_NAME, _SET = r"[^\s<>/=\"'\[\]]++\s*+=\s*+", r"(?:\"[^\"<\r\n]*+\"|'[^'<\r\n]*+'|[^\s\"'<>]++)"
_ATTRIBUTE = rf"(?:(?:\s++|(?<=[\"'])){_NAME}{_SET}|\s++(?:{'|'.join(BARE_ATTRIBUTES.split())})(?![^\s/>]))"
# Letters of a tag's name may have invisible characters between them.
_ELEMENT = r"[A-Za-z](?:[\w:.-]|[\u00ad\u034f\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff])*+"
_TAG = re.compile(
    rf"<!--.*?-->|</?{_ELEMENT}{_ATTRIBUTE}*+\s*+/?>|<{_ELEMENT}(?:\s++{_NAME}[\"'][^\s\"'<>\[]*+[\"']?)++"
    r"|<![A-Za-z]++(?:\s++[\w:.-]++)?(?:\s++(?:PUBLIC|SYSTEM))?(?:\s++(?:\"[^\"<\r\n]*+\"|'[^'<\r\n]*+'))*+\s*+>",
    re.S | re.I,
)
_BRACKET = re.compile(
    rf"\[/?(?:{'|'.join(BRACKET_TAGS.split())})(?:(?:=[^\[\]\r\n]*+|(?:\s++[^\s\[\]=]++=(?:\"[^\"\[\]\r\n]*+\"|[^\s\[\]]++))++\s*+)?\]|=[^\s\[\]]*+)", re.I
)
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None, fold: Folding | None = None) -> list[str]:
    """The words of a text in the form in which they are compared; null and empty give none.
    ``fold`` holds the look-alike letters, without it those that are listed.

    Entities are resolved, tags with their attributes removed, characters brought to their
    skeleton and to lower case; words are runs of letters and digits.
    """
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[" in text:
        text = _BRACKET.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    fold = fold or listed()
    seen = fold.skeleton(text)
    return _WORD.findall(seen.lower() if seen.isascii() else fold.uncased(seen))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling from packed symbols.

    Zeros are separators; each counts as a symbol of its own, in order of position, so common
    prefixes end at them.
    """
    n = len(s)
    own = np.where(s == 0, np.cumsum(s == 0) - 1, s.astype(np.int64) + int((s == 0).sum()))
    width = max(1, int(own.max()).bit_length() if n else 1)
    k = max(1, 62 // (width + 1))
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= width + 1
        if j < n:
            key[: n - j] += own[j:] + 1
    while True:
        sa = np.argsort(key)  # equal keys get equal ranks, so their order is free
        in_order = key[sa]
        new = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        if n == 0 or new[-1] == n - 1:
            return sa
        rank = np.empty(n, np.int64)
        rank[sa] = new
        key = rank * (n + 1)
        if k < n:
            key[: n - k] += rank[k:] + 1
        k *= 2


class FMIndex:
    """A Burrows-Wheeler transform with ranks from a wavelet matrix and sampled suffix positions."""

    def __init__(self, last: np.ndarray, n_symbols: int, sampled: np.ndarray, positions: np.ndarray) -> None:
        """From the transform; the matrix is made of it, level by level."""
        self.n, self.bits = len(last), max(1, int(n_symbols).bit_length())
        self.last, self.sampled, self.positions = last, sampled, positions
        self.first = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=n_symbols + 1))]).astype(np.int64)
        self.zeros, self.ones_at = [], []
        level = last
        for b in range(self.bits - 1, -1, -1):
            bit = ((level >> b) & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~bit, dtype=np.int32)]).astype(np.int32))
            self.ones_at.append(int(self.zeros[-1][-1]))
            level = np.concatenate([level[~bit], level[bit]])
        self.base = self._down(np.arange(n_symbols + 1), np.zeros(n_symbols + 1, np.int64))
        self.nth = np.cumsum(self.sampled) - 1

    @classmethod
    def of(cls, s: np.ndarray, n_symbols: int, sample: int = 16) -> FMIndex:
        """Of symbols 1 to ``n_symbols`` and separators 0, one of which stands first."""
        sa = suffix_array(s)
        before = s[sa - 1]  # position 0 holds a separator, so the wrap never matters
        # The start of each run is sampled too: no walk has to pass a separator.
        sampled = (sa % sample == 0) | (before == 0)
        return cls(before, n_symbols, sampled, sa[sampled])

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            zero = self.zeros[k][at]
            at = np.where((symbol >> b) & 1, self.ones_at[k] + at - zero, zero)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first row of ``symbol`` plus how often it stands in the transform before row ``at``."""
        return self.first[symbol] + self._down(symbol, at) - self.base[symbol]

    def search(self, symbols: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, low, high) of each stretch ``symbols[start : start + n]`` that occurs: rows low to high - 1."""
        alive = starts
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for j in range(n - 1, -1, -1):
            c = symbols[alive + j]
            low, high = self.step(c, low), self.step(c, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in the text of each row."""
        found, steps = np.full(len(rows), -1, np.int64), 0
        open_, at = np.arange(len(rows)), rows
        while len(open_):
            hit = self.sampled[at]
            found[open_[hit]] = self.positions[self.nth[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            at, steps = self.step(self.last[at], at), steps + 1
        return found


class _Symbols(dict):
    """Words numbered from 1 in order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self) + 1
        return number


def digests(distinct: Iterable[str]) -> np.ndarray:
    """The 64-bit digest of each word; none is 0."""
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) or 1 for w in distinct], np.uint64)


class _Shard:
    """Documents of a shard waiting for their index; ``row`` builds it and empties the shard."""

    FIELDS = ("docs", "begins", "offsets", "vocabulary", "last", "sampled", "positions")

    def __init__(self, shard_words: int, overlap: int, fold: Folding) -> None:
        self.most, self.overlap, self.fold = shard_words, overlap, fold
        self.clear()

    def clear(self) -> None:
        self.symbols, self.flat, self.docs, self.begins, self.offsets = _Symbols(), [0], [], [], []

    def add(self, doc: int, text: str) -> Iterator[pa.RecordBatch]:
        """Take one text.  One of more words than a shard holds is cut in pieces, which overlap by ``overlap`` words."""
        w, at = words(text, self.fold), 0
        while True:
            piece = w[at : at + self.most]
            if piece:
                self.docs.append(doc)
                self.begins.append(len(self.flat))
                self.offsets.append(at)
                self.flat.extend(map(self.symbols.__getitem__, piece))
                self.flat.append(0)
            if len(self.flat) > self.most:
                yield self.row()
            if at + self.most >= len(w):
                return
            at += self.most - self.overlap

    def row(self) -> pa.RecordBatch:
        """The index as one row of byte strings."""
        known = digests(self.symbols)
        order = np.argsort(known, kind="stable")
        number = np.zeros(len(known) + 1, np.int32)
        number[order + 1] = np.arange(1, len(known) + 1)
        index = FMIndex.of(number[np.array(self.flat, np.int32)], len(known))
        columns = (
            np.array(self.docs, np.int64), np.array(self.begins, np.int32), np.array(self.offsets, np.int64), known[order],
            index.last.astype(np.int32), np.packbits(index.sampled), index.positions.astype(np.int32),
        )
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=self.FIELDS)


class _Index:
    """An index as it was written, ready to be searched."""

    def __init__(self, row: dict[str, bytes]) -> None:
        kinds = (np.int64, np.int32, np.int64, np.uint64, np.int32, np.uint8, np.int32)
        self.docs, self.begins, self.offsets, self.vocabulary, last, sampled, positions = (np.frombuffer(row[c], k) for c, k in zip(_Shard.FIELDS, kinds))
        self.index = FMIndex(last, len(self.vocabulary), np.unpackbits(sampled, count=len(last)).astype(bool), positions)

    def spans(self, known: np.ndarray, owner: np.ndarray, n: int, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, ...]]:
        """(doc, item, start, end) of merged occurrences, in words of the document, for items as
        digests with zeros between them; ``owner`` is the item of each digest."""
        at = np.minimum(np.searchsorted(self.vocabulary, known), len(self.vocabulary) - 1)
        symbols = np.where(self.vocabulary[at] == known, at + 1, 0)
        gaps = np.concatenate([[0], np.cumsum(symbols == 0)])
        starts = np.flatnonzero(gaps[n:] == gaps[:-n]) if len(symbols) >= n else np.array([], np.int64)
        found, low, high = self.index.search(symbols, starts, n)
        if not len(found):
            return
        # Equal stretches have equal rows: each is located once, whichever items hold it.
        pair = np.unique(np.stack([low, owner[found]]), axis=1)
        phrase, first, held = np.unique(pair[0], return_index=True, return_counts=True)
        by = np.argsort(low, kind="stable")
        counts = high[by[np.searchsorted(low[by], phrase)]] - phrase
        rows = np.repeat(phrase - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
        of, where = np.repeat(np.arange(len(phrase)), counts), self.index.locate(rows)
        order = np.argsort(where, kind="stable")
        of, where = of[order], where[order]
        ends = np.cumsum(held[of])
        a = 0
        while a < len(where):  # at most ``most`` pairs of an occurrence and an item at once, one occurrence at least
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            k, p = held[of[a:z]], where[a:z]
            item = pair[1][np.repeat(first[of[a:z]] - np.concatenate([[0], np.cumsum(k)])[:-1], k) + np.arange(k.sum())]
            doc = np.searchsorted(self.begins, p, "right") - 1
            yield merge_spans(np.repeat(self.docs[doc], k), item, np.repeat(self.offsets[doc] + p - self.begins[doc], k), n)
            a = z


def merge_spans(doc: np.ndarray, item: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of n words of one document and item that overlap or touch become one span."""
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    if not len(doc):
        return doc, item, start, start
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + n)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], item[new], start[new], start[last] + n


def shard_indexes(spark: SparkSession, docs: DataFrame, n: int = 12, doc_id: str = "doc_id", text: str = "text", shard_words: int = 400_000) -> DataFrame:
    """The FM-indexes of a corpus, one row for each shard of about ``shard_words`` words (about 6
    bytes each; at least 2 n), written to the shared folder; they serve stretches of up to ``n`` words.

    Documents never move: shards are built where their rows are read, and a task holds one at a
    time (about 150 bytes a word while it is built).
    """
    source = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    sent = spark.sparkContext.broadcast(folding(spark))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(max(shard_words, 2 * n), n - 1, sent.value)
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from shard.add(doc, t)
        if shard.docs:
            yield shard.row()

    made = source.mapInArrow(build, ", ".join(f"{c} binary" for c in _Shard.FIELDS))
    # A row is some MB, so the writer looks at its buffers after each.
    return Workspace(spark).keep(made, "shards", **{"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})


def _item_words(spark: SparkSession, items: DataFrame, n: int, item_id: str, text: str, most: int) -> DataFrame:
    """(item, words): the digests of each item's words, as bytes; items of very many words in
    pieces of at most ``most`` bytes, which overlap by n - 1 words."""
    sent, piece = spark.sparkContext.broadcast(folding(spark)), max(n, most // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts = [], []
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                known = digests(words(t, sent.value))
                for at in range(0, max(0, len(known) - n + 1), piece - n + 1):
                    ids.append(item)
                    parts.append(known[at : at + piece].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())], names=["item", "words"])

    rows = items.select(items[item_id].cast("bigint").alias("item"), items[text].alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "item bigint, words binary")


def _blocks(rows: Iterable, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(digests with a zero after each item, the item of each) in blocks of about ``most`` bytes."""
    parts, owners, size = [], [], 0

    def block() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(parts), np.repeat(np.array(owners, np.int64), [len(p) for p in parts])

    for item, data in rows:
        if parts and size + len(data) > most:
            yield block()
            parts, owners, size = [], [], 0
        parts.append(np.concatenate([np.frombuffer(data, np.uint64), np.zeros(1, np.uint64)]))
        owners.append(item)
        size += len(data) + 8
    if parts:
        yield block()


def _raw_spans(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int, doc_id: str, doc_text: str, item_id: str, item_text: str, shard_words: int, block_bytes: int, shards: DataFrame | None) -> DataFrame:
    """(doc_id, item_id, start_word, end_word), not merged between pieces of a document or rows delivered twice."""
    shards = shard_indexes(spark, docs, n, doc_id, doc_text, shard_words) if shards is None else shards
    ws, schema = Workspace(spark), "doc_id bigint, item_id bigint, start_word bigint, end_word bigint"

    def search(block: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, owner = sent.value
            for b in batches:
                for k in range(b.num_rows):
                    row = {c: b[c][k].as_buffer() for c in _Shard.FIELDS}
                    for found in _Index(row).spans(known, owner, n):
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["doc_id", "item_id", "start_word", "end_word"])

        return shards.mapInArrow(run, schema), sent

    blocks = _blocks(_item_words(spark, items, n, item_id, item_text, block_bytes).toLocalIterator(), block_bytes)
    last, parts = None, []
    for block in blocks:
        if last:  # there are more blocks: each is searched and written before the next one is sent
            parts.append(ws.keep(last[0], "spans"))
            last[1].destroy()
        last = search(block)
    parts += [last[0]] if last else []
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def leak_spans(
    spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = 12, doc_id: str = "doc_id", doc_text: str = "text",
    item_id: str = "item_id", item_text: str = "text", shard_words: int = 400_000, block_bytes: int = 16 << 20, shards: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, item_id, start_word, end_word): each stretch of at least ``n`` consecutive words
    that a document shares with an item; end_word is exclusive, words count from 0.

    The corpus is read once, to build its indexes, or not at all where ``shards``, made before by
    shard_indexes, are given.  Items are brought to words in tasks and sent to the indexes in
    blocks of about ``block_bytes``.  Null and empty texts, and items of fewer than n words, give
    nothing; rows with a null id are left out; rows delivered twice give their spans once.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    raw = _raw_spans(spark, docs, items, n, doc_id, doc_text, item_id, item_text, shard_words, block_bytes, shards)
    # Spans of one document and item are few; those of a cut document's pieces become one where they meet.
    found = _merged(raw, ["doc_id", "item_id"])
    return found.select(found.doc_id.cast(kind).alias("doc_id"), "item_id", "start_word", "end_word")


def _merged(spans: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Spans of equal ``by`` that overlap or touch as one."""
    w = Window.partitionBy(*by).orderBy("start_word", "end_word")
    so_far = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(F.col("start_word") <= so_far, 0).otherwise(1)).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_part").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), *more).drop("_part")


def leaked_items(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = 12, doc_id: str = "doc_id", doc_text: str = "text",
    item_id: str = "item_id", item_text: str = "text", shard_words: int = 400_000, block_bytes: int = 16 << 20, shards: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, item_id): each document and item that share at least ``n`` consecutive words."""
    kind = docs.schema[doc_id].dataType.simpleString()
    raw = _raw_spans(spark, docs, items, n, doc_id, doc_text, item_id, item_text, shard_words, block_bytes, shards)
    return raw.select(raw.doc_id.cast(kind).alias("doc_id"), "item_id").distinct()


def removal_spans(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = 12, **columns: str) -> DataFrame:
    """(doc_id, start_word, end_word, n_items): the stretches to remove from each document.

    Spans of different items that overlap or touch are merged; one document's spans are few,
    so the window stays small.
    """
    return _merged(leak_spans(spark, docs, items, n, **columns), ["doc_id"], F.countDistinct("item_id").alias("n_items"))
