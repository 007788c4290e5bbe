"""Exchange of sorted integer columns by key range, packed.

A task sorts what it has by key, cuts it at the ranges' bounds and sends one packed message for each range that it has
rows of; one task then holds one whole range. The number of ranges follows the input, so a range has a bounded share of
it. With more than FAN ranges the exchange takes two steps: messages first go by groups of ranges, are merged there as
they stream by, and are cut again into single ranges. So no task sends more than FAN messages at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

FAN = 1024
#: Rows that a task gathers before it sends them.
FLUSH = 1_000_000


def pack(values: np.ndarray) -> bytes:
    """Integers as zstd-compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes | pa.Buffer, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).reshape(n)


def by_range(top: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of the 32-bit space begins in the sorted array `top`, and its end."""
    return np.searchsorted(top, (np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges))


class Exchange:
    """Columns that go by range: a sorted key, values beside it, and a table that the first of the values points into
    (entries that many rows share are sent once a message)."""

    def __init__(self, cut: Callable[[np.ndarray], np.ndarray], ranges: int, key: type, values: tuple[type, ...], table: tuple[type, ...] = ()):
        """cut(sorted keys) gives ranges + 1 places."""
        self.cut, self.ranges, self.kinds, self.table = cut, ranges, (key, *values), table
        #: Ranges that go together at first, and the rows a task gathers.
        self.step, self.flush = -(-ranges // FAN), FLUSH
        self.names = ["r", "n", *(f"v{i}" for i in range(len(self.kinds)))] + (["m", *(f"t{i}" for i in range(len(table)))] if table else [])
        binary = ["binary"] * len(self.kinds)
        kinds = ["int", "int", *binary] + (["int", *["binary"] * len(table)] if table else [])
        self.schema = ", ".join(f"{n} {k}" for n, k in zip(self.names, kinds, strict=True))
        self.types = [{"int": pa.int32(), "binary": pa.binary()}[k] for k in kinds]

    def messages(self, columns: list[np.ndarray], table: list[np.ndarray], step: int) -> pa.RecordBatch:
        """One row for each group of `step` ranges that has rows."""
        at = self.cut(columns[0])
        at = np.append(at[:-1][::step], at[-1])
        rows = []
        for r in np.flatnonzero(at[1:] > at[:-1]):
            a, b = at[r], at[r + 1]
            part = [x[a:b] for x in columns]
            out = [int(r), int(b - a), pack(np.diff(part[0], prepend=part[0].dtype.type(0)))]
            if self.table:
                named, part[1] = np.unique(part[1], return_inverse=True)
            out += [pack(x.astype(k)) for x, k in zip(part[1:], self.kinds[1:], strict=True)]
            if self.table:
                out += [len(named), *(pack(t[named].astype(k)) for t, k in zip(table, self.table, strict=True))]
            rows.append(out)
        columns_ = list(zip(*rows, strict=True)) or [[]] * len(self.names)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns_, self.types, strict=True)], names=self.names)

    def merged(self, parts: list[dict]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The messages' rows sorted by key, and their table."""
        columns = [np.concatenate([np.cumsum(unpack(p["v0"], p["n"], self.kinds[0]), dtype=self.kinds[0]) for p in parts])]
        columns += [np.concatenate([unpack(p[f"v{i}"], p["n"], k) for p in parts]) for i, k in enumerate(self.kinds) if i]
        if self.table:
            first = np.cumsum([0, *(p["m"] for p in parts)])[:-1]
            columns[1] = columns[1].astype(np.int64) + np.repeat(first, [p["n"] for p in parts])
        table = [np.concatenate([unpack(p[f"t{i}"], p["m"], k) for p in parts]) for i, k in enumerate(self.table)]
        order = np.argsort(columns[0], kind="stable")
        return [x[order] for x in columns], table

    def stretches(self, rows: pa.Table, most: int) -> Iterator[list[np.ndarray]]:
        """The messages' columns by rising stretches of keys, unsorted in each: about `most` rows, or one key's if it has
        more. Besides the messages, only their unpacked columns and one stretch are held."""
        ends = np.append(0, np.cumsum(rows.column("n").to_numpy(), dtype=np.int64))
        columns = [np.empty(ends[-1], k) for k in self.kinds]
        for i, (out, kind) in enumerate(zip(columns, self.kinds, strict=True)):
            for a, b, data in zip(ends[:-1], ends[1:], rows.column(f"v{i}"), strict=True):
                out[a:b] = unpack(data.as_buffer(), int(b - a), kind)
                if not i:
                    np.cumsum(out[a:b], out=out[a:b])
        parts = [columns[0][a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        step = max(1, most >> 12)  # a stretch is off by so many rows a message at most
        bounds = np.unique(np.sort(columns[0][::step])[most // step :: most // step])
        at = np.array([np.concatenate([[0], np.searchsorted(p, bounds), [len(p)]]) for p in parts]) + ends[:-1, None]
        for k in range(len(bounds) + 1):
            mine = [(a, b) for a, b in at[:, k : k + 2] if b > a]
            if mine:
                yield [np.concatenate([x[a:b] for a, b in mine]) for x in columns]

    def sender(self, gather: Callable[[pa.RecordBatch], Iterator[tuple[list[np.ndarray], list[np.ndarray]]]], condense: Callable[[list[np.ndarray]], list[np.ndarray]] | None = None, column: str = "w") -> Callable:
        """For mapInArrow: gather(batch) gives columns, and their table; they go out sorted, FLUSH rows at a time.
        condense(columns in any order) may join rows first and must return them sorted by key. Batches are joined by the
        entries of the list column."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, tables, size, entries = [], [], 0, 0

            def flush() -> pa.RecordBatch:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                table = [np.concatenate(x) for x in zip(*tables, strict=True)] if self.table else []
                if condense:
                    columns = condense(columns)
                else:
                    order = np.argsort(columns[0], kind="stable")
                    columns = [x[order] for x in columns]
                return self.messages(columns, table, self.step)

            for batch in c.larger(batches, column):
                for columns, table in gather(batch):
                    if self.table:
                        columns[1] = columns[1] + entries
                        entries += len(table[0])
                        tables.append(table)
                    held.append(columns)
                    size += len(columns[0])
                    if size >= self.flush:
                        yield flush()
                        held, tables, size, entries = [], [], 0, 0
            if size:
                yield flush()

        return c.released(send)

    def ranged(self, sent: DataFrame) -> DataFrame:
        """The messages by single range."""
        if self.step == 1:
            return sent

        def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held and (held[0]["r"] != row["r"] or sum(p["n"] for p in held) >= self.flush):
                        yield self.messages(*self.merged(held), 1)
                        held = []
                    held.append(row)
            if held:
                yield self.messages(*self.merged(held), 1)

        return sent.repartition(FAN, "r").sortWithinPartitions("r").mapInArrow(refine, self.schema)

    def apply(self, sent: DataFrame, work: Callable[[int, list[np.ndarray], list[np.ndarray]], pa.Table], schema: str) -> DataFrame:
        """work(range, columns, table) on each range."""
        return self.apply_messages(sent, lambda r, rows: work(r, *self.merged(rows.to_pylist())), schema)

    def apply_messages(self, sent: DataFrame, work: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
        """work(range, messages) on each range."""

        def one(rows: pa.Table) -> pa.Table:
            out = work(rows.column("r")[0].as_py(), rows)
            c.release()
            return out

        return self.ranged(sent).groupBy("r").applyInArrow(one, schema)


def ranges_for(docs: DataFrame) -> int:
    """Two ranges for each partition of the input: a range's share of it doesn't grow with the input."""
    return max(8, 2 * docs.select(docs.columns[0]).rdd.getNumPartitions())
