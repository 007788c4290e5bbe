"""Language-model scoring with an Elias-Fano n-gram trie in memory-mapped shards.

Training counts words, then trigrams, over all training documents: each task sorts its own and sends them packed by key
range. Word ids are places in the order of the words' hashes. A shard holds one range of (first word, second word): the
first words' pointers to their successors, the successors' ids and quantised probabilities, each successor's pointer to
its own, and so on down. Pointers are Elias-Fano sequences; ids are packed; an id is found by a search among the
successors of its context alone. Shards are files in the shared folder which scoring tasks map into memory.

The model interpolates absolutely discounted trigram, bigram and unigram estimates. What the unigrams give up is the
probability of a word never seen. Stored numbers are rounded down, so a context's probabilities never sum above one.

Null text is the empty text: one token, its end. Rows are scored one by one, so repeated rows agree, and counted one by
one in training. Texts of any length are taken whole, a chunk at a time. An empty table gives no rows; without training
rows every token has the probability of the base, 1. score() hands on the columns that the caller names, whatever their
names, and ignores others. Words are known by 64-bit hashes; a vocabulary of 2**32 words is refused. The shared folder must
be one that pyarrow can open; on a mounted path the files are mapped where they are, else a worker reads the shards that
it needs into memory and keeps a few of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import succinct as ef
from .jaccard import hashed_words
from .ranges import Exchange, by_range, ranges_for
from .language import held_out

END = np.uint64(0x9E3779B97F4A7C15)
DISCOUNT = 0.85
#: Powers of one half that stand for a probability: eight for each halving down to 2**-24, then wider ones to 2**-70, below
#: any quotient of 64-bit counts.
HALVINGS = np.concatenate([np.arange(192) / 8, 24 + 0.75 * np.arange(1, 63)])
TOKENS_PER_SHARD = 4_000_000
CHUNK = 1_000_000
#: Rows that a shard's task sorts and counts up at a time.
ROWS_AT_ONCE = 1 << 18
#: Shards that a worker keeps in memory where they can't be mapped.
HELD = 16


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write(uri: str, name: str, data: bytes) -> None:
    """The file appears whole or not at all, and a repeated task writes the same again."""
    system, folder = place(uri)
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{folder}/{name}")


def mapped(uri: str, name: str) -> tuple[dict[str, np.ndarray], bool]:
    """A file's arrays, and whether they are mapped rather than read."""
    system, folder = place(uri)
    if isinstance(system, fs.LocalFileSystem):
        return ef.load(np.memmap(f"{folder}/{name}", np.uint8, "r").view(np.ndarray)), True
    with system.open_input_stream(f"{folder}/{name}") as source:
        return ef.load(np.frombuffer(source.read(), np.uint8)), False


def quantised(p: np.ndarray) -> np.ndarray:
    """0 is none; q stands for 2 ** -HALVINGS[q - 1], never above p."""
    with np.errstate(divide="ignore"):
        q = np.searchsorted(HALVINGS, -np.log2(p) - 1e-9)
    return np.where(p > 0, np.clip(q, 0, len(HALVINGS) - 1) + 1, 0).astype(np.uint8)


VALUE = np.concatenate([[0.0], 2.0**-HALVINGS])


@dataclass
class Model:
    """What scoring needs besides the files; its size follows the number of shards."""

    uri: str
    offsets: np.ndarray  # first id of each vocabulary range, and their end
    tokens: int
    discount1: float
    docs: int
    bounds: np.ndarray  # first key of each shard, and their end
    nodes: np.ndarray  # first bigram number of each shard
    split: dict[int, int]  # successors of words that lie in more than one shard

    @property
    def words(self) -> int:
        return int(self.offsets[-1])

    @property
    def span(self) -> int:
        return self.words + 2  # the words, the start, and the mark after an end

    def unseen(self) -> float:
        return self.discount1 * self.words / self.tokens


class Reader:
    """The mapped files of a model, opened when needed."""

    def __init__(self, model: Model):
        self.m, self.open, self.read = model, {}, []

    def file(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.open:
            found, kept = mapped(self.m.uri, name)
            if not kept:
                self.read = [*self.read, name]
                if len(self.read) > HELD:
                    self.open.pop(self.read.pop(0))
            self.open[name] = found
        return self.open[name]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        out, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        ranges = len(self.m.offsets) - 1
        cut = by_range(hashes >> np.uint64(32), ranges)
        for r in range(ranges):
            a, b = cut[r], cut[r + 1]
            if b > a and self.m.offsets[r + 1] > self.m.offsets[r]:
                f = self.file(f"words-{r}")
                at = np.minimum(np.searchsorted(f["hash"], hashes[a:b]), len(f["hash"]) - 1)
                hit = f["hash"][at] == hashes[a:b]
                out[a:b] = np.where(hit, at + self.m.offsets[r], -1)
                count[a:b] = np.where(hit, f["count"][at], 0)
        return out, count

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of sorted ids; the start counts the documents."""
        out = np.full(len(ids), self.m.docs, np.int64)
        cut = np.searchsorted(ids, self.m.offsets)
        for r in range(len(cut) - 1):
            if cut[r + 1] > cut[r]:
                out[cut[r] : cut[r + 1]] = self.file(f"words-{r}")["count"][ids[cut[r] : cut[r + 1]] - self.m.offsets[r]]
        return out

    def successor(self, f: dict, level: str, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The places of the words among their contexts' successors [lo, hi), or -1."""
        bits, ids, end = int(f["bits"][0]), f[level], hi.copy()
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = ef.unpacked(ids, bits, mid) < word[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        found = np.flatnonzero(lo < end)
        out = np.full(len(lo), -1, np.int64)
        hit = found[ef.unpacked(ids, bits, lo[found]) == word[found]]
        out[hit] = lo[hit]
        return out

    @staticmethod
    def pointers(f: dict, level: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = {k: f[f"{level}.{k}"] for k in ("bits", "low", "high", "rank")}
        return ef.neighbours(parts, at)

    def bigrams(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted keys first * span + second: node number or -1, discounted probability, weight left by the node."""
        node, p, left = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.ones(len(keys))
        cut = np.searchsorted(keys, self.m.bounds)
        for s in range(len(cut) - 1):
            a, b = cut[s], cut[s + 1]
            if b > a:
                f = self.file(f"trie-{s}")
                first, second = np.divmod(keys[a:b].astype(np.int64), self.m.span)
                distinct, back = np.unique(first, return_inverse=True)
                local = distinct - int(f["first"][0])
                inside = (local >= 0) & (local < int(f["firsts"][0]))
                lo, hi = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
                if inside.any():
                    lo[inside], hi[inside] = self.pointers(f, "p2", local[inside])
                at = self.successor(f, "id2", lo[back], hi[back], second)
                hit = at >= 0
                node[a:b] = np.where(hit, at + self.m.nodes[s], -1)
                p[a:b] = np.where(hit, VALUE[f["f2"][at]], 0.0)
                left[a:b] = np.where(hit, VALUE[f["l2"][at]], 1.0)
        return node, p, left

    def degree(self, ids: np.ndarray) -> np.ndarray:
        """How many successors each of the sorted distinct words has."""
        out = np.zeros(len(ids), np.int64)
        keys = ids.astype(np.uint64) * np.uint64(self.m.span)
        of = np.searchsorted(self.m.bounds, keys, side="right") - 1
        for s in np.unique(of):
            f, rows = self.file(f"trie-{s}"), np.flatnonzero(of == s)
            local = ids[rows] - int(f["first"][0])
            inside = (local >= 0) & (local < int(f["firsts"][0]))
            if inside.any():
                lo, hi = self.pointers(f, "p2", local[inside])
                out[rows[inside]] = hi - lo
        for i in np.flatnonzero(np.isin(ids, list(self.m.split))):
            out[i] = self.m.split[int(ids[i])]
        start = ids == self.m.words
        out[start] -= self.m.docs > 0  # the node (start, start) is no successor
        return out

    def trigrams(self, nodes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Discounted probabilities of words after the bigrams of sorted node numbers."""
        p = np.zeros(len(nodes))
        cut = np.searchsorted(nodes, self.m.nodes)
        for s in range(len(cut) - 1):
            a, b = cut[s], cut[s + 1]
            if b > a:
                f = self.file(f"trie-{s}")
                lo, hi = self.pointers(f, "p3", nodes[a:b] - self.m.nodes[s])
                at = self.successor(f, "id3", lo, hi, words[a:b])
                p[a:b] = np.where(at >= 0, VALUE[f["f3"][at]] if len(f["f3"]) else 0.0, 0.0)
        return p


def padded(column: pa.ListArray, ahead: int, behind: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Chunks of rows: word hashes with room for `ahead` marks before and `behind` after each row, the places of the
    words and of the first mark behind each row, and the rows' range."""
    values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy().astype(np.int64)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK, side="right")) - 1)
        length = np.diff(ends[a : b + 1])
        head = np.cumsum(length + ahead + behind) - (length + ahead + behind)
        out = np.zeros(int((length + ahead + behind).sum()), np.uint64)
        at = np.repeat(head + ahead - (ends[a:b] - ends[a]), length) + np.arange(int(length.sum()))
        out[at] = values[ends[a] : ends[b]]
        stop = head + ahead + length
        out[stop] = END
        yield out, at, stop, a, b
        a = b


def count_words(train: DataFrame, uri: str, ranges: int) -> list:
    """Writes the vocabulary's ranges; returns for each its words, tokens, hapaxes, twos and most frequent words."""

    by = Exchange(lambda hashes: by_range(hashes >> np.uint64(32), ranges), ranges, np.uint64, (np.uint32,))

    def gather(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
        for words, *_ in padded(batch.column("w"), 0, 1):
            yield [words], []

    def count(columns: list[np.ndarray]) -> list[np.ndarray]:
        return list(np.unique(columns[0], return_counts=True))

    def add(r: int, columns: list[np.ndarray], _: list[np.ndarray]) -> pa.Table:
        hashes, times = columns
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        hashes, total = hashes[first], np.add.reduceat(times.astype(np.int64), first)
        write(uri, f"words-{r}", ef.save({"hash": hashes, "count": total}))
        top = np.argsort(-total, kind="stable")[:64]
        return pa.table({"r": [r], "n": [len(hashes)], "tokens": [int(total.sum())], "once": [int((total == 1).sum())], "twice": [int((total == 2).sum())], "top": [top.tolist()], "times": [total[top].tolist()]},
                        schema=pa.schema([("r", pa.int32()), ("n", pa.int64()), ("tokens", pa.int64()), ("once", pa.int64()), ("twice", pa.int64()), ("top", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]))

    sent = hashed_words(train).mapInArrow(by.sender(gather, count), by.schema)
    return by.apply(sent, add, "r int, n long, tokens long, once long, twice long, top array<long>, times array<long>").collect()


def shard_bounds(model: Model, heavy: list[tuple[int, int]], shards: int) -> np.ndarray:
    """First keys of shards: equal stretches of first words, with frequent ones cut further by their second word."""
    span, each = model.span, max(1, model.tokens // shards)
    keys = {0, (model.words + 1) * span} | {model.words * k // shards * span for k in range(shards)}
    for word, times in [*heavy, (model.words, 2 * model.docs)]:
        k = -(-times // each)
        if k > 1:
            keys |= {word * span + span * j // k for j in range(k)} | {(word + 1) * span}
    return np.array(sorted(keys), np.uint64)


def grouped(key: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by key and third word, and where in it each distinct pair begins."""
    order = np.argsort(key)
    number = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0, dtype=np.uint64)
    order = order[np.argsort(number << np.uint64(32) | third[order].astype(np.uint64))]
    key, third = key[order], third[order]
    return order, np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (third[1:] != third[:-1])]))


def build(model: Model, by: Exchange, s: int, rows: pa.Table) -> pa.Table:
    """Writes a shard of the trie, a stretch of keys at a time; of each stretch only what the shard keeps is held."""
    reader, span, start, parts = Reader(model), model.span, model.words, []
    for key, third, times in by.stretches(rows, ROWS_AT_ONCE):
        order, first = grouped(key, third)
        key, third, times = key[order][first], third[order][first], np.add.reduceat(times[order].astype(np.int64), first)
        at2 = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        seen = np.add.reduceat(times, at2)
        followed = third != start + 1
        context = np.add.reduceat(np.where(followed, times, 0), at2)
        kinds = np.add.reduceat(followed.astype(np.int64), at2)
        one, two = np.divmod(key[at2].astype(np.int64), span)
        ones, back = np.unique(one, return_inverse=True)
        f2 = np.where(two == start, 0.0, (seen - DISCOUNT) / np.maximum(1, reader.counts(ones)[back]))
        l2 = np.where(context > 0, DISCOUNT * kinds / np.maximum(1, context), 1.0)
        owner = np.repeat(np.arange(len(at2)), np.diff(np.append(at2, len(key))))[followed]
        f3 = (times[followed] - DISCOUNT) / context[owner]
        parts.append((one.astype(np.uint32), two.astype(np.uint32), quantised(f2), quantised(l2), kinds, third[followed], quantised(f3)))
    one, two, f2, l2, kinds, third, f3 = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    ones, degree = np.unique(one, return_counts=True)
    ones, bits = ones.astype(np.int64), int(span).bit_length()
    every = np.zeros(int(ones[-1] - ones[0]) + 2, np.int64)
    every[ones - ones[0] + 1] = degree
    arrays = {"bits": np.array([bits], np.uint64), "first": ones[:1].astype(np.uint64), "firsts": np.array([len(every) - 1], np.uint64), "id2": ef.packed(two, bits), "f2": f2, "l2": l2, "id3": ef.packed(third, bits), "f3": f3}
    for level, pointers in (("p2", np.cumsum(every)), ("p3", np.concatenate([[0], np.cumsum(kinds)]))):
        arrays |= {f"{level}.{k}": v for k, v in ef.monotone(pointers).items()}
    write(model.uri, f"trie-{s}", ef.save(arrays))
    edge = sorted({0, len(ones) - 1})
    return pa.table({"s": [s], "nodes": [len(two)], "trigrams": [len(third)], "edge": [ones[edge].tolist()], "degree": [degree[edge].tolist()]},
                    schema=pa.schema([("s", pa.int32()), ("nodes", pa.int64()), ("trigrams", pa.int64()), ("edge", pa.list_(pa.int64())), ("degree", pa.list_(pa.int64()))]))


def count_trigrams(train: DataFrame, model: Model) -> list:
    """Writes the trie's shards; returns for each its bigrams and the successors of its first and last words."""
    reader_of, bounds, span, start = Model(**vars(model)), model.bounds, model.span, model.words
    by = Exchange(lambda key: np.searchsorted(key, bounds), len(bounds) - 1, np.uint64, (np.uint32, np.uint32))
    readers: list[Reader] = []

    def gather(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
        if not readers:
            readers.append(Reader(reader_of))
        for words, at, stop, _, _ in padded(batch.column("w"), 2, 2):
            ids = np.full(len(words), start, np.int64)
            real = np.concatenate([at, stop])
            distinct, back = np.unique(words[real], return_inverse=True)
            ids[real] = readers[0].ids(distinct)[0][back]
            ids[stop + 1] = start + 1
            begins = np.ones(len(words), bool)
            begins[stop + 1] = begins[stop] = False  # no trigram begins at a row's end or the mark behind it
            at3 = np.flatnonzero(begins)
            at3 = at3[at3 + 2 < len(words)]
            yield [ids[at3].astype(np.uint64) * np.uint64(span) + ids[at3 + 1].astype(np.uint64), ids[at3 + 2].astype(np.uint32)], []

    def count(columns: list[np.ndarray]) -> list[np.ndarray]:
        order, first = grouped(*columns)
        return [columns[0][order][first], columns[1][order][first], np.diff(np.append(first, len(order)))]

    sent = hashed_words(train).mapInArrow(by.sender(gather, count), by.schema)
    return by.apply_messages(sent, lambda s, rows: build(reader_of, by, s, rows), "s int, nodes long, trigrams long, edge array<long>, degree array<long>").collect()


def train(docs: DataFrame) -> Model | None:
    """The model of all rows of docs; None if there are none."""
    spark = docs.sparkSession
    uri = c.scratch(spark, "ngrams")
    ranges = ranges_for(docs.select("text"))
    found = {r.r: r for r in count_words(docs, uri, ranges)}
    if not found:
        return None
    offsets = np.concatenate([[0], np.cumsum([found[r].n if r in found else 0 for r in range(ranges)])]).astype(np.int64)
    once, twice = sum(r.once for r in found.values()), sum(r.twice for r in found.values())
    model = Model(uri, offsets, sum(r.tokens for r in found.values()), once / (once + 2 * twice) if once else 0.5, docs.count(), np.zeros(0), np.zeros(0), {})
    if model.span >= 1 << 32:
        raise ValueError(f"{model.words} distinct words: word ids have 32 bits")
    shards = max(4, -(-model.tokens // TOKENS_PER_SHARD))
    heavy = [(int(offsets[r.r] + i), k) for r in found.values() for i, k in zip(r.top, r.times, strict=True)]
    model.bounds = shard_bounds(model, heavy, shards)
    made = {r.s: r for r in count_trigrams(docs, model)}
    keep = sorted(made)
    for s in set(range(len(model.bounds) - 1)) - set(keep):  # a range without bigrams is an empty shard
        arrays = {"bits": np.array([1], np.uint64), "first": np.array([0], np.uint64), "firsts": np.array([0], np.uint64), "id2": np.zeros(2, np.uint64), "f2": np.zeros(0, np.uint8), "l2": np.zeros(0, np.uint8), "id3": np.zeros(2, np.uint64), "f3": np.zeros(0, np.uint8)}
        write(uri, f"trie-{s}", ef.save(arrays))
    model.nodes = np.concatenate([[0], np.cumsum([made[s].nodes if s in made else 0 for s in range(len(model.bounds) - 1)])]).astype(np.int64)
    shared: dict[int, list[int]] = {}
    for r in made.values():
        for word, k in zip(r.edge, r.degree, strict=True):
            shared.setdefault(word, []).append(k)
    model.split = {w: sum(k) for w, k in shared.items() if len(k) > 1}
    return model


def score(docs: DataFrame, model: Model | None, *columns) -> DataFrame:
    """The columns with n_tokens, n_known, base_score and score."""

    def after(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
        """What stands before each token; `first` before a row's first one."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[starts] = first
        return out

    def rows(reader: Reader, column: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
        m = reader.m
        span, start = np.uint64(m.span), np.array([m.words])
        opening = min(1.0, DISCOUNT * int(reader.degree(start)[0]) / max(1, m.docs))
        start_node, _, start_left = (x[0] for x in reader.bigrams(start.astype(np.uint64) * span + start.astype(np.uint64)))
        for words, _, stop, a, b in padded(column, 0, 1):
            starts = np.append(0, stop[:-1] + 1)
            distinct, back = np.unique(words, return_inverse=True)
            ids, times = reader.ids(distinct)
            known = np.flatnonzero(ids >= 0)
            # unigrams, and the weight that each known word leaves to them as a context
            p1 = np.where(ids >= 0, (times - m.discount1) / m.tokens, m.unseen())
            weight = np.ones(len(distinct))
            weight[known] = np.minimum(1.0, DISCOUNT * reader.degree(ids[known]) / np.maximum(1, times[known]))
            base = np.log10((times + 1) / (m.tokens + m.words + 1))
            id_ = ids[back]
            before = after(id_, starts, m.words)
            # bigrams: one search for each distinct pair
            pair = np.flatnonzero((id_ >= 0) & (before >= 0))
            keys, of = np.unique(before[pair].astype(np.uint64) * span + id_[pair].astype(np.uint64), return_inverse=True)
            found, f2, l2 = reader.bigrams(keys)
            node, p, left = np.full(len(id_), -1, np.int64), after(weight[back], starts, opening) * p1[back], np.ones(len(id_))
            node[pair], left[pair] = found[of], l2[of]
            p[pair] += f2[of]
            # trigrams below the bigrams found at the place before
            context, rest = after(node, starts, start_node), after(left, starts, start_left)
            deep = np.flatnonzero(context >= 0)
            low = rest[deep] * p[deep]
            ask = np.flatnonzero(node[deep] >= 0)
            under, word = context[deep[ask]], id_[deep[ask]]
            order = np.argsort(under)
            got = np.zeros(len(deep))
            got[ask[order]] = reader.trigrams(under[order], word[order])
            p[deep] = got + low
            known_ = np.add.reduceat((times > 0)[back].astype(np.int64), starts)
            yield stop - starts + 1, known_, np.add.reduceat(base[back], starts), np.add.reduceat(np.log10(np.maximum(p, 1e-300)), starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model) if model else None
        for batch in c.larger(batches, "w"):
            column = batch.column("w")
            if reader:
                parts = [np.concatenate(x) for x in zip(*rows(reader, column), strict=True)] if len(column) else [np.zeros(0)] * 4
            else:
                n = np.diff(column.offsets.to_numpy()).astype(np.int64) + 1
                parts = [n, n * 0, n * 0.0, n * 0.0]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *(pa.array(x, t) for x, t in zip(parts, kinds, strict=True))], names=[*names, "n_tokens", "n_known", "base_score", "score"])

    kept = hashed_words(docs, *columns)
    schema = kept.drop("w").withColumns({"n_tokens": F.lit(0).cast("long"), "n_known": F.lit(0).cast("long"), "base_score": F.lit(0.0), "score": F.lit(0.0)}).schema
    return kept.mapInArrow(c.released(run), schema)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(7, 2)))
    out = score(docs, model, "doc_id", held_out(7, 2).alias("held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens if model else 0).cast("long").alias("train_tokens"), "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("token_score"), ((F.col("score") - F.col("base_score")) / F.col("n_tokens")).alias("token_gain"))


def lm_scoring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can express, its base score in thousandths."""
    out = op1_lm_scoring(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.floor(F.col("base_score") * 1000.0 + 0.5).cast("long").alias("base_milli"))


#: The CRC's table is made by rule; a text's CRC runs over the digits of its id.
COUNTS_SQL = r"""
WITH RECURSIVE step(n, k, c) AS (SELECT i, 0, CAST(i AS UBIGINT) FROM range(256) t(i) UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT n, c FROM step WHERE k = 8), ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS t FROM documents WHERE doc_id IS NOT NULL),
run(doc_id, t, i, c) AS (SELECT doc_id, t, 0, 4294967295::UBIGINT FROM ids UNION ALL SELECT doc_id, t, i + 1, xor(crc.c, run.c >> 8) FROM run JOIN crc ON crc.n = CAST(xor(run.c & 255, ascii(t[i + 1])::UBIGINT) AS BIGINT) WHERE i < length(t)),
h AS (SELECT doc_id, xor(c, 4294967295::UBIGINT) % 7 = 2 AS held_out FROM run WHERE i = length(t)),
d AS (SELECT d.doc_id, coalesce(held_out, false) AS held_out, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), chr(10)) AS w FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id),
x AS (SELECT doc_id, held_out, unnest(w) AS t FROM d), v AS (SELECT t, count(*) AS c FROM x WHERE NOT held_out GROUP BY t), z AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM v)
SELECT doc_id, held_out, count(*) AS n_tokens, count(v.c) AS n_known, any_value(n) AS train_tokens, CAST(floor(sum(log10((coalesce(v.c, 0) + 1) / (n + z.v + 1)::DOUBLE)) * 1000 + 0.5::DOUBLE) AS BIGINT) AS base_milli
FROM x LEFT JOIN v ON v.t = x.t, z GROUP BY doc_id, held_out
"""
