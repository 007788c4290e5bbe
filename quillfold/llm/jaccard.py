"""Near-duplicate components by a grouped prefix join on word shingles.

A text's set is its distinct shingles of five words, as 64-bit hashes. Tokens are ordered by corpus frequency class and
hash: a bounded table of the most frequent shingles puts those last, so prefixes hold rare ones. Two sets that reach the
similarity share a prefix token and have sizes within the ratio. Rows with equal sets are one class; classes with equal
prefix and size are one group. Groups that share a prefix token form a run; equal runs are kept once.

Links are only needed between classes that are not yet connected. A first round verifies, in each run and each group,
pairs with the smallest member (and all pairs of short runs) and joins up components; further rounds do so from a few
members of a run's largest component; the last verifies every remaining pair of a run or group whose ends lie in
different components. So a large family of near copies costs a star,
no link between components is lost, and no run of a frequent token is held in one task: those are plain joins.

Null, empty and wordless texts have empty sets and link with nothing. Rows are told apart by (doc_id, text), and a
component's name is the smallest doc_id in it (null only if all its ids are null). Repeated rows are one class and each
get a row of the result; an empty table gives none. Texts of any length are taken whole. Extra columns are ignored.
Sets are 64-bit hashes, of which the last comparison uses 48.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .ranges import Exchange, by_range, pack, ranges_for, unpack

SHINGLE, PERCENT = 5, 75
#: Shingles with more documents than LIGHT may enter the frequency table, which keeps the HEAVIEST of them.
LIGHT, HEAVIEST = 24, 500_000
SHORT_RUN, CENTRES, STARS = 8, 4, (4, 16)
_STEPS = np.random.default_rng(20).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(docs: DataFrame, *columns) -> DataFrame:
    """The columns and `w`, the words' hashes in order."""
    return docs.select(*columns, F.transform(c.tokens(c.lower_ascii(F.col("text"))), lambda x: F.xxhash64(x)).alias("w"))


def sets_of(column: pa.ListArray) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes."""
    words = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    ends = column.offsets.to_numpy()
    total = sum((words[j : len(words) - SHINGLE + 1 + j] * _STEPS[j] for j in range(SHINGLE)), np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64))
    shingles = mix(total)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= SHINGLE:
            s = np.sort(shingles[a : b - SHINGLE + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield mix((words[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def frequency_table(docs: DataFrame, ranges: int, light: int = LIGHT, heaviest: int = HEAVIEST) -> tuple[np.ndarray, np.ndarray]:
    """The upper halves of the most frequent shingles, sorted, and their class (1 + log2 of their documents).

    Each task counts its own shingles and sends them by range, packed; a range is counted up in one task. Only ranges'
    heavy entries remain, and of them at most `heaviest` reach the driver.
    """
    by = Exchange(lambda top: by_range(top, ranges), ranges, np.uint32, (np.uint32,))

    def gather(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
        top = np.concatenate([(s >> np.uint64(32)).astype(np.uint32) for s in sets_of(batch.column("w"))] or [np.zeros(0, np.uint32)])
        yield [top], []

    def count(columns: list[np.ndarray]) -> list[np.ndarray]:
        return list(np.unique(columns[0], return_counts=True))

    def add(_: int, columns: list[np.ndarray], table: list[np.ndarray]) -> pa.Table:
        top, times = columns
        first = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        total = np.add.reduceat(times.astype(np.int64), first)
        heavy = total > light
        return pa.table({"top": pa.array(top[first][heavy].astype(np.int64)), "docs": pa.array(total[heavy])})

    sent = hashed_words(docs).mapInArrow(by.sender(gather, count), by.schema)
    rows = by.apply(sent, add, "top long, docs long").orderBy(F.desc("docs"), "top").limit(heaviest).toArrow()
    top, times = rows.column("top").to_numpy().astype(np.uint32), rows.column("docs").to_numpy()
    order = np.argsort(top)
    return top[order], (1 + np.log2(np.maximum(times[order], 1))).astype(np.uint8)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set's hashes over a power of two of places, at least as many as the set has members."""
    m = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1).tobytes()


def fewest_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the size of two sets' symmetric difference: the places in which their sketches differ, the longer
    one folded to the length of the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        half = folded(y)
        y = half
    return int(np.bitwise_count(x ^ y).sum())


def folded(y: np.ndarray) -> np.ndarray:
    return y[: len(y) // 2] ^ y[len(y) // 2 :]


def prefixes(docs: DataFrame, table: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> DataFrame:
    """doc_id, rk (text hash), n, cid (class), gid (group), bits (sketch) and the prefix: light tokens, then heavy ones."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, rank = shared.value
        for batch in batches:
            out = ([], [], [], [], [], [])
            for s in sets_of(batch.column("w")):
                n = len(s)
                if not n:
                    for column, x in zip(out, (0, None, None, None, [], []), strict=True):
                        column.append(x)
                    continue
                half = (s >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(top, half), max(0, len(top) - 1))
                level = np.where(top[at] == half, rank[at], 0) if len(top) else np.zeros(n, np.uint8)
                order = np.argsort(level, kind="stable")[: prefix_length(n, percent)]
                light = s[order][level[order] == 0].view(np.int64)
                heavy = s[order][level[order] > 0].view(np.int64)
                key = np.concatenate([light, heavy]).tobytes()
                for column, x in zip(out, (n, hash64(s.tobytes()), hash64(key + n.to_bytes(8, "little")), sketch(s), light, heavy), strict=True):
                    column.append(x)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), longs, longs), strict=True))], names=["doc_id", "rk", "n", "cid", "gid", "bits", "light", "heavy"])

    rows = hashed_words(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"))
    return rows.mapInArrow(c.released(heads), "doc_id long, rk long, n long, cid long, gid long, bits binary, light array<long>, heavy array<long>")


def hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def light_runs(heads: DataFrame, ranges: int) -> DataFrame:
    """run, gid, n, pos: distinct sets of two or more groups that share a light prefix token, with the token's place in
    each prefix. Of several tokens with equal sets the first in order counts: it has the least places.

    Tokens go by their upper 48 bits: two that agree there make a run with a few more candidates, and lose none. A task
    sends a group once, however many of its rows have it; a range keeps one entry for each group and token.
    """
    by = Exchange(lambda token: by_range(token >> np.uint64(16), ranges), ranges, np.uint64, (np.uint32, np.uint32), (np.int64, np.uint32))

    def gather(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
        column = batch.column("light")
        ends = column.offsets.to_numpy()
        group, n = batch.column("gid").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
        rows = np.unique(group, return_index=True)[1]
        times = np.diff(ends)[rows]
        at = np.repeat(ends[:-1][rows] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
        token = column.values.to_numpy(zero_copy_only=False).view(np.uint64)[at] >> np.uint64(16)
        yield [token, np.repeat(np.arange(len(rows)), times), (at - np.repeat(ends[:-1][rows], times)).astype(np.uint32)], [group[rows], n[rows].astype(np.uint32)]

    def meet(_: int, columns: list[np.ndarray], table: list[np.ndarray]) -> pa.Table:
        token, entry, pos = columns
        gid = table[0][entry]
        order = np.lexsort((gid, token))
        token, gid, n, pos = token[order], gid[order], table[1][entry][order], pos[order]
        once = np.concatenate([[True], (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])])
        token, gid, n, pos = token[once], gid[once], n[once], pos[once]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(starts, len(token)))
        # a run is named by the sum of its members' mixed hashes, so equal runs of other tokens bear the same name
        name = np.add.reduceat(mix(gid.view(np.uint64)), starts)
        several = np.flatnonzero(length > 1)
        several = several[np.unique(name[several], return_index=True)[1]]
        at = np.repeat(starts[several] - np.concatenate([[0], np.cumsum(length[several])[:-1]]), length[several]) + np.arange(length[several].sum())
        return pa.table({"run": pa.array(np.repeat(name[several], length[several]).view(np.int64)), "gid": pa.array(gid[at]), "n": pa.array(n[at].astype(np.int64)), "pos": pa.array(pos[at].astype(np.int64))})

    sent = heads.where("n > 0").select("gid", "n", "light").mapInArrow(by.sender(gather, column="light"), by.schema)
    met = by.apply(sent, meet, "run long, gid long, n long, pos long")
    return met.groupBy("run", "gid").agg(F.first("n").alias("n"), F.min("pos").alias("pos"))


def may_link(n: str, m: str, i: str, j: str, percent: int) -> str:
    """Whether sets of sizes n and m whose first common token has places i and j can still reach the similarity."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) AND {100 + percent} * (1 + least({n} - 1 - {i}, {m} - 1 - {j})) >= {percent} * ({n} + {m})"


def components(edges: DataFrame, keep: c.Scratch) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges(a, b).

    Large and small stars in turn: each round links all larger neighbours, then all smaller ones, to the least of them,
    which halves distances; rounds end when no edge changes.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while mark[0]:
        near = both(e)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = keep(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        before, e = e, keep(small.distinct(), "links")
        keep.drop(before, large)
        last, mark = mark, e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last == mark:
            break
    roots = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    out = keep(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "jaccard-roots")
    keep.drop(e)
    return out


def close(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of the class pairs (a, b), those whose sketches allow the similarity: sets of sizes n and m that reach it differ in
    at most (n + m) * (100 - percent) / (100 + percent) members."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            apart = np.array([fewest_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * apart <= (100 - percent) * n))

    side = lambda k: classes.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"x{k}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb")
    return met.mapInArrow(c.released(compare), "a long, b long").hint("rebalance")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, keep: c.Scratch, most_rows: int | None = None) -> DataFrame:
    """Of the class pairs (a, b), those whose sets reach the similarity.

    Sketches rule most others out. Sets are then built for the classes named only, from their representatives' texts,
    and go to their pairs packed, as 48 bits of each hash.
    """
    pairs = keep(close(classes, pairs, percent), "jaccard-close")
    if not pairs.take(1):
        return pairs
    named = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    reps = keep(named.join(classes, "cid").select("cid", F.col("rep.doc_id").alias("_id"), F.col("rep.rk").alias("_rk"), F.col("rep.times").alias("times")), "jaccard-reps")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("rk"))
    chosen = c.matching(rows, reps, most_rows)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [np.unique(x >> np.uint64(16)) for x in sets_of(batch.column("w"))]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([len(x) for x in s], pa.int32()), pa.array([pack(np.diff(x, prepend=np.uint64(0))) for x in s], pa.binary())], names=["cid", "k", "s"])

    built = hashed_words(chosen, "cid").mapInArrow(c.released(sets), "cid long, k int, s binary")
    if reps.where("times > 1").take(1):  # a representative that is several equal rows
        built = built.dropDuplicates(["cid"])
    built = keep(built, "jaccard-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(data: bytes, n: int) -> np.ndarray:
            return np.cumsum(unpack(data, n, np.uint64), dtype=np.uint64)

        last, left = None, None
        for batch in batches:
            out = []
            for i, a in enumerate(batch.column("a").to_numpy()):
                if a != last:  # pairs come sorted by a, so a centre's set is read once
                    last, left = a, read(batch.column("sa")[i].as_py(), batch.column("ka")[i].as_py())
                right = read(batch.column("sb")[i].as_py(), batch.column("kb")[i].as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                out.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    left, right = built.select(F.col("cid").alias("a"), F.col("k").alias("ka"), F.col("s").alias("sa")), built.select(F.col("cid").alias("b"), F.col("k").alias("kb"), F.col("s").alias("sb"))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "ka", "sa", "kb", "sb").mapInArrow(c.released(compare), "a long, b long")
    # few links remain of many sets compared: without this every task of the comparison writes a file of a row or two
    found = keep(met.hint("rebalance"), "jaccard-links")
    keep.drop(built, reps, pairs)
    return found


def near_duplicates(docs: DataFrame, percent: int = PERCENT, heaviest: int = HEAVIEST, light: int = LIGHT, keep_root: bool = False, most_rows: int | None = None) -> DataFrame:
    """doc_id, rk (hash of the text), n_shingles, component_id: one row for each row of docs. With keep_root also root,
    which tells components apart even where they bear the same id; null for wordless texts, which link with nothing.
    most_rows bounds the broadcasts; results don't depend on it."""
    spark = docs.sparkSession
    keep = c.Scratch(docs)
    c.small_batches(spark)
    ranges = ranges_for(docs)
    heads = keep(prefixes(docs, frequency_table(docs, ranges, light, heaviest), percent), "jaccard-prefixes")
    rows = keep(heads.select("doc_id", "rk", "n", "cid"), "jaccard-rows")
    copies = heads.where("n > 0").groupBy("cid", "gid", "n", "doc_id", "rk").agg(F.count(F.lit(1)).alias("times"), F.first("bits").alias("bits"))
    classes = copies.groupBy("cid").agg(F.first("gid").alias("gid"), F.first("n").alias("n"), F.min(F.struct("doc_id", "rk", "times")).alias("rep"), F.min("doc_id").alias("least"), F.first("bits").alias("bits"))
    classes = keep(classes, "jaccard-classes")
    lead = keep(classes.groupBy("gid").agg(F.min("cid").alias("lead")), "jaccard-leads")
    runs = keep(light_runs(heads, ranges), "jaccard-runs")
    heavy = heads.where("n > 0").select(F.posexplode_outer("heavy").alias("i", "run"), "gid", "n", F.size("light").alias("k")).where("run IS NOT NULL")
    heavy = heavy.groupBy("run", "gid").agg(F.first("n").alias("n"), F.first((F.col("k") + F.col("i")).cast("long")).alias("pos"))
    several = heavy.groupBy("run").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("run")
    heavy = keep(heavy.join(several, "run"), "jaccard-heavy")
    keep.drop(heads)

    # round 1: stars in runs and groups, and all pairs of short runs
    every = runs.unionByName(heavy)
    centre = every.groupBy("run").agg(F.min(F.struct("gid", "n", "pos")).alias("m"), F.count(F.lit(1)).alias("k"))
    # besides the smallest, a member that leads one of a few other orders: a family whose smallest member is far out meets elsewhere
    order = F.xxhash64("gid", F.pmod("run", F.lit(CENTRES)))
    other = every.groupBy("run").agg(F.min(F.struct(order.alias("o"), "gid", "n", "pos")).alias("m"), F.count(F.lit(1)).alias("k")).where(f"k > {SHORT_RUN}")
    centres = centre.select("run", F.struct("m.gid", "m.n", "m.pos").alias("m")).unionByName(other.select("run", F.struct("m.gid", "m.n", "m.pos").alias("m")))
    star = every.join(centres, "run").where("gid <> m.gid").select(F.col("m.gid").alias("g"), F.col("gid").alias("h"), F.col("m.n").alias("gn"), F.col("n").alias("hn"), F.col("m.pos").alias("gp"), F.col("pos").alias("hp"))
    short = runs.join(centre.where(f"k <= {SHORT_RUN}").select("run"), "run")
    short = short.alias("x").join(short.alias("y"), F.expr("x.run = y.run AND x.gid < y.gid")).selectExpr("x.gid AS g", "y.gid AS h", "x.n AS gn", "y.n AS hn", "x.pos AS gp", "y.pos AS hp")
    met = star.unionByName(short).where(may_link("gn", "hn", "gp", "hp", percent)).select("g", "h").distinct()
    across = met.join(lead.select(F.col("gid").alias("g"), F.col("lead").alias("a")), "g").join(lead.select(F.col("gid").alias("h"), F.col("lead").alias("b")), "h").select("a", "b")
    within = classes.join(lead, "gid").where("cid <> lead").select(F.col("lead").alias("a"), F.col("cid").alias("b"))
    tested = keep(across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
    links = verified(docs, classes, tested, percent, keep, most_rows)
    joined = components(links, keep)

    # what is still open in long runs: stars from a few members of the run's largest component, then from more
    own = classes.select(F.col("gid").alias("run"), "gid", F.lit(0).cast("long").alias("pos")).distinct()
    shared = every.select("run", "gid", "pos").unionByName(own).join(classes.select("cid", "gid", "n"), "gid").select("run", "cid", "n", "pos")
    shared = keep(shared, "jaccard-members")
    keep.drop(runs, heavy, lead)

    def unjoined(joined: DataFrame) -> DataFrame:
        """The members, with their roots, of runs that lie in several components."""
        member = shared.join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        several = member.groupBy("run").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("run")
        return keep(member.join(several, "run"), "jaccard-open")

    def link(pairs: DataFrame, joined: DataFrame) -> DataFrame:
        """Components after verifying the pairs that were not tested before."""
        nonlocal tested
        fresh = keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
        tested = tested.unionByName(fresh)
        found = verified(docs, classes, fresh, percent, keep, most_rows)
        if not found.take(1):
            return joined
        out = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found), keep)
        keep.drop(joined, found)
        return out

    member = unjoined(joined)
    for several in STARS:
        if not member.take(1):  # nothing is open
            break
        count = member.groupBy("run", "root").agg(F.count(F.lit(1)).alias("k"))
        large = count.groupBy("run").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("all")).where(f"all > {SHORT_RUN}").selectExpr("run", "m.root AS root")
        leads = [F.min(F.struct(F.xxhash64("cid", F.lit(k)).alias("o"), "cid", "n", "pos")) for k in range(several)]
        centre = member.join(large, ["run", "root"]).groupBy("run", "root").agg(F.array_distinct(F.transform(F.array(*leads), lambda x: F.struct(x["cid"].alias("cid"), x["n"].alias("n"), x["pos"].alias("pos")))).alias("m"))
        centre = centre.select("run", F.col("root").alias("r"), F.explode("m").alias("m"))
        star = member.join(centre, "run").where("root <> r AND " + may_link("n", "m.n", "pos", "m.pos", percent))
        joined = link(star.select(F.col("cid").alias("a"), F.col("m.cid").alias("b")), joined)
        keep.drop(member)
        member = unjoined(joined)

    # last: every pair of a run whose ends still lie in different components
    if member.take(1):
        again = member.alias("x").join(member.alias("y"), F.expr("x.run = y.run AND x.root < y.root AND " + may_link("x.n", "y.n", "x.pos", "y.pos", percent)))
        joined = link(again.selectExpr("x.cid AS a", "y.cid AS b"), joined)

    roots = classes.select("cid", "least").join(joined.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    root = ["root"] if keep_root else []
    label = keep(roots.join(names, "root").select("cid", "component_id", *root), "jaccard-names")
    out = rows.join(c.small(label, c.BROADCAST_ROWS if most_rows is None else most_rows), "cid", "left")
    out = out.select("doc_id", "rk", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *root)
    out = c.stored(out, "jaccard-components")
    keep.close()
    return out


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.read(spark, sf_dir, "documents").select("doc_id", "text")).drop("rk")


#: All pairs that share a shingle, and the least id that each document reaches over links.
OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT b, root FROM r JOIN u ON node = a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON node = d.doc_id GROUP BY d.doc_id
"""
