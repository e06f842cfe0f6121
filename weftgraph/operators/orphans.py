"""References to indexes that do not exist, now, yet or any more (problem 3).

A parent is a row with a key, an extent and the time it holds; a reference names a key, an
index and a time.  Parents are range-partitioned by key and each range is stored as one row
of sorted arrays.  References pass by as Arrow batches and are probed by binary search, all
rows of a batch at once.  Only misses leave a task.

Where all arrays together stay under a bound they are broadcast and references do not move.
Beyond it, the range of each reference is found by binary search over the ranges' bounds (one
number each), and references are sent to (range, salt), with so many salts for a range as its
rows need, each with a copy of the range's arrays; a task streams through them, so memory is
one range's arrays and one batch.  All versions of one key stand in one range.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import Workspace

NEVER, ALWAYS = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: Bytes of parents' arrays up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
RANGE_ROWS = 200_000
ROWS_PER_SALT = 2_000_000


@dataclass
class Extents:
    """For each key, extents over time, as arrays sorted by (key, time).

    ``hold_*``: the largest extent that holds from a time on; ``late_*``: of versions that
    begin at a time or after it; ``gone_*``: of versions that ended at a time or before it.
    """

    keys: np.ndarray
    tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]  # start of each key, times, extents
    indexes: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def _index(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct times of a table, and its rows as (key number, time rank) in one number; made once."""
        if name not in self.indexes:
            starts, times, _ = self.tables[name]
            distinct = np.unique(times)
            owner = np.repeat(np.arange(len(self.keys)), np.diff(starts))
            self.indexes[name] = distinct, owner * (len(distinct) + 1) + np.searchsorted(distinct, times, "right")
        return self.indexes[name]

    @classmethod
    def of(cls, key: np.ndarray, extent: np.ndarray, begin: np.ndarray, end: np.ndarray, known: np.ndarray) -> Extents:
        """extent below 0: none; begin NEVER: unknown; end NEVER: open; key ``known`` by any row."""
        keys = np.unique(known)
        owner = np.searchsorted(keys, key)
        began, ended = begin != NEVER, end != NEVER
        parts = {
            "hold": _holding(owner, extent, begin, end),
            "late": _running_max(owner[began], begin[began], extent[began], backward=True),
            "gone": _running_max(owner[ended], end[ended], extent[ended]),
        }
        return cls(keys, {k: (np.searchsorted(o, np.arange(len(keys) + 1)).astype(np.int64), t, x) for k, (o, t, x) in parts.items()})

    def size_at(self, name: str, key: np.ndarray, time: np.ndarray, shift: int) -> np.ndarray:
        """For rows of key number ``key`` (-1: none): the extent at the last entry at or before
        ``time`` (shift -1), or at the first one after it (shift 0); -1 where there is none."""
        starts, times, sizes = self.tables[name]
        if not len(times) or not len(self.keys):
            return np.full(len(key), -1, np.int64)
        distinct, composite = self._index(name)
        width = len(distinct) + 1
        k = np.maximum(key, 0)
        i = np.searchsorted(composite, k * width + np.searchsorted(distinct, time, "right"), "right") + shift
        ok = (key >= 0) & (i >= starts[k]) & (i < starts[k + 1])
        return np.where(ok, sizes[np.clip(i, 0, len(sizes) - 1)], -1)

    def reasons(self, key: np.ndarray, index: np.ndarray, time: np.ndarray) -> np.ndarray:
        """0 where the index exists at the time, else 1 late, 2 deleted, 3 missing."""
        k = np.searchsorted(self.keys, key)
        k = np.where((k < len(self.keys)) & (self.keys[np.minimum(k, max(0, len(self.keys) - 1))] == key), k, -1) if len(self.keys) else np.full(len(key), -1)
        inside = lambda size: (index >= 0) & (index < size)
        out = np.where(inside(self.size_at("gone", k, time, -1)), 2, 3)
        out = np.where(inside(self.size_at("late", k, time, 0)), 1, out)
        return np.where(inside(self.size_at("hold", k, time, -1)), 0, out).astype(np.int8)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, keys=self.keys, **{f"{k}{i}": a for k, x in self.tables.items() for i, a in enumerate(x)})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Extents:
        with np.load(io.BytesIO(data)) as z:
            return cls(z["keys"], {k: tuple(z[f"{k}{i}"] for i in range(3)) for k in ("hold", "late", "gone")})


def _holding(owner: np.ndarray, extent: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, time, extent): times at which the largest extent that holds changes, and that
    extent from there on, -1 where none holds; sorted by owner and time.

    Versions that follow each other are their own steps; only owners with versions that
    overlap need the sweep.
    """
    some = (begin != NEVER) & (begin < end) & (extent > 0)
    owner, extent, begin, end = owner[some], extent[some], begin[some], end[some]
    order = np.lexsort((begin, owner))
    owner, extent, begin, end = owner[order], extent[order], begin[order], end[order]
    clash = (owner[1:] == owner[:-1]) & (end[:-1] > begin[1:])
    mixed = np.unique(owner[1:][clash])
    plain = ~np.isin(owner, mixed)
    closed = plain & (end != NEVER)
    o, t = np.concatenate([owner[plain], owner[closed]]), np.concatenate([begin[plain], end[closed]])
    x, starts = np.concatenate([extent[plain], np.full(int(closed.sum()), -1, np.int64)]), np.concatenate([np.ones(int(plain.sum()), np.int8), np.zeros(int(closed.sum()), np.int8)])
    order = np.lexsort((starts, t, o))
    o, t, x = o[order], t[order], x[order]
    # Where one version ends as the next begins, the beginning stands.
    last = np.concatenate([(o[1:] != o[:-1]) | (t[1:] != t[:-1]), np.ones(min(1, len(o)), bool)])
    swept = []
    for k in mixed:
        a, z = np.searchsorted(owner, k, "left"), np.searchsorted(owner, k, "right")
        times, sizes = _sweep(extent[a:z], begin[a:z], end[a:z])
        swept.append((np.full(len(times), k, np.int64), times, sizes))
    o, t, x = (np.concatenate([y, *(w[i] for w in swept)]).astype(np.int64) for i, y in enumerate((o[last], t[last], x[last])))
    order = np.argsort(o, kind="stable")
    return o[order], t[order], x[order]


def _sweep(extent: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the largest extent among overlapping versions of one owner, sorted by begin."""
    import heapq

    times = np.unique(np.concatenate([begin, end[end != NEVER]]))
    sizes, heap, i = np.full(len(times), -1, np.int64), [], 0
    for k, t in enumerate(times.tolist()):
        while i < len(begin) and begin[i] <= t:
            heapq.heappush(heap, (-int(extent[i]), int(end[i])))
            i += 1
        while heap and heap[0][1] <= t:
            heapq.heappop(heap)
        if heap:
            sizes[k] = -heap[0][0]
    return times, sizes


def _running_max(owner: np.ndarray, time: np.ndarray, extent: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, time, extent) sorted by owner and time, each extent the largest of its owner up to there, or from there on."""
    order = np.lexsort((time, owner))
    owner, time, extent = owner[order], time[order], extent[order]
    distinct, rank = np.unique(extent, return_inverse=True)
    if backward:
        owner, rank = owner[::-1], rank[::-1]
    # One accumulation for all owners: each later owner starts above all ranks of those before.
    turn = np.cumsum(np.concatenate([np.zeros(min(1, len(owner)), np.int64), (owner[1:] != owner[:-1]).astype(np.int64)]))
    largest = np.maximum.accumulate(turn * (len(distinct) + 1) + rank) - turn * (len(distinct) + 1)
    if backward:
        owner, largest = owner[::-1], largest[::-1]
    return owner, time, distinct[largest] if len(distinct) else extent


def _numbers(col: pa.Array, null: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_timestamp(col.type):
        col = col.cast(pa.timestamp("us", col.type.tz)).cast(pa.int64())
    return pc.fill_null(col.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


REASONS = ("", "late", "deleted", "missing")


def dangling_references(
    refs: DataFrame, parents: DataFrame, ref_id: str, ref_key: str, ref_time: str, indexes: dict[str, str], parent_key: str, begin: str, end: str,
    broadcast_bytes: int = BROADCAST_BYTES, range_rows: int = RANGE_ROWS, rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """(id, time, field, reason): one row for each distinct reference that does not resolve.

    ``indexes`` maps each index column of ``refs`` to the extent column of ``parents`` that
    bounds it: index x exists in a version if 0 <= x < extent.  A non-null index dangles if no
    version of its key that holds at the reference's time has it: ``late`` if a version that
    begins later has it, else ``deleted`` if one that ended by then has it, else ``missing``.

    Null indexes refer to nothing.  A null or unknown key, and a null time with any key, give
    ``missing``.  A parent without a begin never holds and is not late; without an end it is
    open; a null extent has no index.  Repeated parents and references count once.
    """
    ws, fields = Workspace(refs.sparkSession), list(indexes)
    n_fields = len(fields)
    p = parents.select(F.col(f"`{parent_key}`").cast("bigint").alias("key"), F.col(f"`{begin}`").alias("begin"), F.col(f"`{end}`").alias("end"), *(F.col(f"`{indexes[c]}`").cast("bigint").alias(f"x{i}") for i, c in enumerate(fields)))
    p = p.filter("key IS NOT NULL").distinct()
    tasks = max(1, -(-p.count() // max(range_rows, RANGE_ROWS)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, f, e = _numbers(t["key"], 0), _numbers(t["begin"], NEVER), _numbers(t["end"], NEVER)
        extents = [_numbers(t[f"x{i}"], -1) for i in range(n_fields)]
        order = np.argsort(key, kind="stable")
        # Ranges of about range_rows rows, cut where the key changes.
        in_order = key[order]
        cuts = np.unique(np.searchsorted(in_order, in_order[::range_rows], "left"))
        for a, z in zip(cuts, [*cuts[1:], len(order)]):
            at = order[a:z]
            data = [Extents.of(key[at], x[at], f[at], e[at], key[at]).pack() for x in extents]
            yield pa.RecordBatch.from_pydict({"low": pa.array([key[at[0]]], pa.int64()), "arrays": pa.array([pickle.dumps(data)], pa.binary())})

    packed = ws.keep(p.repartitionByRange(tasks, "key").mapInArrow(pack, "low bigint, arrays binary"), "parents")
    size, n = packed.agg(F.sum(F.octet_length("arrays")), F.count("*")).first()
    # Index columns are checked here: a row whose indexes are all null refers to nothing.
    r = refs.select(F.col(f"`{ref_id}`").alias("id"), F.col(f"`{ref_key}`").cast("bigint").alias("key"), F.col(f"`{ref_time}`").alias("time"), *(F.col(f"`{c}`").cast("bigint").alias(f"x{i}") for i, c in enumerate(fields)))
    id_type, time_type = r.schema["id"].dataType.simpleString(), r.schema["time"].dataType.simpleString()
    schema = f"id {id_type}, time {time_type}, field string, reason string"

    def probe(t: pa.RecordBatch, find: Callable[[np.ndarray], list[tuple[np.ndarray | slice, list[Extents]]]]) -> Iterator[pa.RecordBatch]:
        key, time = _numbers(t["key"], ALWAYS), _numbers(t["time"], 0)
        no_key, no_time = np.asarray(pc.is_null(t["key"])), np.asarray(pc.is_null(t["time"]))
        for i, name in enumerate(fields):
            index = _numbers(t[f"x{i}"], -1)
            code = np.full(len(key), 3, np.int8)
            for rows, extents in find(key):
                code[rows] = extents[i].reasons(key[rows], index[rows], time[rows])
            code[no_key | no_time] = 3
            code[np.asarray(pc.is_null(t[f"x{i}"]))] = 0
            miss = np.flatnonzero(code)
            if len(miss):
                at = pa.array(miss)
                yield pa.RecordBatch.from_arrays([t["id"].take(at), t["time"].take(at), pa.array([name] * len(miss)), pa.array([REASONS[c] for c in code[miss]])], names=["id", "time", "field", "reason"])

    if (size or 0) <= broadcast_bytes:
        rows = packed.select("low", "arrays").orderBy("low").collect()  # at most broadcast_bytes, as just measured
        sent = refs.sparkSession.sparkContext.broadcast([(x.low, pickle.loads(bytes(x.arrays))) for x in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lows = np.array([low for low, _ in sent.value], np.int64)
            extents = [[Extents.unpack(a) for a in arrays] for _, arrays in sent.value]

            def find(key: np.ndarray) -> list:
                if len(lows) <= 1:
                    return [(slice(None), e) for e in extents]
                at = np.searchsorted(lows, key, "right") - 1
                return [(np.flatnonzero(at == k), extents[k]) for k in np.unique(at[at >= 0])]

            for b in batches:
                yield from probe(b, find)

        out = r.mapInArrow(run, schema)
    else:
        spark, own = refs.sparkSession, r.columns
        lows = np.sort(np.array([x.low for x in packed.select("low").collect()], np.int64))  # one number for each range
        bounds = spark.sparkContext.broadcast(lows)

        def place(key: pa.Array) -> np.ndarray:
            return np.maximum(np.searchsorted(bounds.value, _numbers(key, ALWAYS), "right") - 1, 0)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(max(1, len(bounds.value)), np.int64)
            for b in batches:
                seen += np.bincount(place(b["key"]), minlength=len(seen))
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["range", "n"])

        counts = r.select("key").mapInArrow(tally, "range bigint, n bigint").groupBy("range").agg(F.sum("n").alias("n")).collect()  # one number for each range
        salts, total = np.ones(max(1, len(lows)), np.int64), sum(x.n for x in counts)
        for x in counts:
            salts[x["range"]] = -(-x.n // rows_per_salt)
        shares = spark.sparkContext.broadcast(salts)
        moving = F.lit(None).cast("binary").alias("arrays")
        layout = f"range bigint, salt bigint, is_ref int, arrays binary, {', '.join(f'`{c}` {t}' for c, t in r.dtypes)}"

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = place(b["key"])
                salt = _numbers(b["h"], 0) % shares.value[at]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(salt), pa.array(np.ones(len(at), np.int32)), b["arrays"], *(b[c] for c in own)], names=["range", "salt", "is_ref", "arrays", *own])

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, at in enumerate(place(b["key"])):
                    row, zero = b.slice(k, 1), pa.array([0], pa.int32())
                    for salt in range(shares.value[at]):
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([salt], pa.int64()), zero, row["arrays"], *(row[c] for c in own)], names=["range", "salt", "is_ref", "arrays", *own])

        left = r.select(F.xxhash64("id").alias("h"), moving, *r.columns).mapInArrow(send, layout)
        right = packed.select(F.col("low").alias("key"), "arrays", *(F.lit(None).cast(t).alias(c) for c, t in r.dtypes if c != "key")).mapInArrow(copy, layout)
        parts = int(min(salts.sum(), max(spark.sparkContext.defaultParallelism, -(-4 * total // rows_per_salt))))

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, extents = None, None
            for b in batches:
                pair = np.stack([np.asarray(b["range"]), np.asarray(b["salt"])])
                cuts = np.flatnonzero((np.diff(pair, axis=1) != 0).any(axis=0)) + 1
                for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
                    t = b.slice(a, z - a)
                    if (group := (pair[0, a], pair[1, a])) != now:
                        now, extents = group, None
                    while t.num_rows and not t["is_ref"][0].as_py():
                        extents = [Extents.unpack(x) for x in pickle.loads(t["arrays"][0].as_py())]
                        t = t.slice(1)
                    if t.num_rows:
                        yield from probe(t, lambda key, e=extents: [(slice(None), e)] if e else [])

        moved = left.unionByName(right).repartition(parts, "range", "salt").sortWithinPartitions("range", "salt", "is_ref")
        out = moved.mapInArrow(stream, schema)
    return out.distinct()


def dangling_report(dangling: DataFrame) -> DataFrame:
    """(field, month, reason, n): distinct dangling references by field and month of the reference."""
    month = F.date_trunc("month", "time").alias("month")
    return dangling.groupBy("field", month, "reason").agg(F.count("*").alias("n"))
