"""Every stage against plain Python on a small corpus, clashing column names, and empty tables for every query."""

import glob
import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillfold.llm import chunks, decontaminate, mixing, sharding, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    r = random.Random(11)
    word = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(word) for _ in range(r.randrange(3, 80))) for _ in range(90)]
    texts += [" ".join(t.split()[:-1] + ["changed"]) for t in texts[:12]] + texts[12:20]
    texts += [f"{texts[30]} {' '.join(BENCH[0].split()[:20])}", BENCH[1], "you vile scoundrel " * 8, None, "", "  \n"]
    rows = [(i, t, "en", "abc"[i % 3] if i % 17 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[40], "en", "a", 1), (None, None, None, None, None)]


BENCH = ["b1 b2 b3 " + " ".join(f"w{i}" for i in range(30)), " ".join(f"q{i}" for i in range(25)), "short item"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    labels = [(i, 0, int("scoundrel" in (t or ""))) for i, t, *_ in corpus()[:100] if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(df, columns=COLUMNS):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_jaccard_stage(spark, docs, folder):
    table = corpus()
    sets, root = [shingles(r[1]) for r in table], list(range(len(table)))
    for i in range(len(table)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    found = defaultdict(list)
    for r, k, s in zip(table, root, sets, strict=True):
        found[k if s else (k, "bare")].append(r)
    got = rows(corpus_pipeline.keep_one_of_near_copies(spark, docs, folder))
    assert len(got) == len(found)
    least = {k: min((x[0] is None, x[0] or 0) for x in v) for k, v in found.items()}
    assert sorted(str(x[0]) for x in got) == sorted(str(None if last else i) for last, i in least.values()) and all(x in table for x in got)


def hits(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    hit = set()
    for item in BENCH:
        w = item.split()
        n = min(13, len(w))
        for i in range(len(w) - n + 1):
            hit |= {k for j in range(len(words) - n + 1) if words[j : j + n] == w[i : i + n] for k in range(j, j + n)}
    return len(hit), len(words)


def test_decontamination_stage(spark, docs, folder):
    want = [r for r in corpus() if not ((h := hits(r[1]))[0] and 20 * h[0] >= h[1])]
    got = rows(corpus_pipeline.drop_contaminated(spark, docs, folder))
    assert got == sorted(want, key=str) and len(got) < len(corpus())


def test_toxicity_stage(spark, docs, folder):
    kept = rows(corpus_pipeline.drop_toxic(spark, docs, folder))
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet").where("crc32(cast(doc_id as string)) % 5 <> 0"))
    want = [r for r in corpus() if float(model.score(toxicity.np.array([toxicity.features(r[1] or "", model.lexicon)]))[0]) < 0.5]
    assert kept == sorted(want, key=str)


def mixed(table, whole):
    """Taken words by a plain walk over each source in key order."""
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    by = defaultdict(list)
    for r in table:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    total, own = 1.5 * sum(size(r[1]) for r in table), {s: sum(size(r[1]) for r in by[s]) for s in order}
    weight, target, open_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * own[s]]
        if not full:
            break
        target |= {s: 2.0 * own[s] for s in full}
        open_ -= set(full)
        if not open_:
            break
    target |= {s: share[s] for s in open_}
    out = []
    for s in order:
        epochs = min(2, int(target[s] // own[s])) if own[s] else 0
        rest = int(target[s] - epochs * own[s])
        key = lambda r: (hashlib.md5(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] if r[0] is not None else -1, size(r[1]))
        for r in sorted(by[s], key=key):
            n = size(r[1])
            into = max(0, min(n, rest))
            rest -= n
            if whole:
                into = n if 2 * into >= max(n, 1) else 0
            out.append((r, min(2 * n, epochs * n + into)))
    return out


def test_mixing_stage(spark, docs, folder):
    want = Counter()
    for r, taken in mixed(corpus(), True):
        n = len((r[1] or "").split())
        want[str(r)] += taken // n if n else 0
    assert Counter(map(str, rows(corpus_pipeline.mix_sources(spark, docs, folder)))) == +want
    got = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(docs).collect())
    assert got == sorted((str(r[0]), len((r[1] or "").split()), t) for r, t in mixed(corpus(), False))


def test_mixing_of_equal_rows(spark):
    table = [(7, "one two three", "en", "a", 1)] * 5 + [(8, "x " * 9, "en", "b", 1)]
    got = sorted(r.taken for r in mixing.mix(spark.createDataFrame(table, SCHEMA)).collect())
    assert got == sorted(t for _, t in mixed(table, False)) and sum(got) in (35, 36)


def test_sharding_stage(spark, docs, folder):
    out = corpus_pipeline.shard_documents(spark, docs, folder)
    assert rows(out) == sorted(corpus(), key=str)
    by = defaultdict(list)
    for r in out.collect():
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(len(by[s]) for s in range(40)) <= 1


def test_shuffle_is_uniform(spark):
    """Where a row goes doesn't follow from its place: shard counts of each tenth of the ids are as chance has them."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    out = sharding.shard(docs.selectExpr("struct(doc_id) AS row", "text"), 10, "row", rows_per_partition=300).selectExpr("row.doc_id AS i", "shard", "slot").collect()
    times = Counter((r.i // 400, r.shard) for r in out)
    chi = sum((times[a, b] - 40) ** 2 / 40 for a in range(10) for b in range(10))
    assert 40 < chi < 140
    close = sum(abs(a - b) == 1 for a, b in zip([r.slot for r in sorted(out, key=lambda r: r.i)], [r.slot for r in sorted(out, key=lambda r: r.i)][1:], strict=False))
    assert close < 100


INNER = "row rk _id _rk _h key part size tie base s p target taken source_size ahead copy place at into equals epochs shard slot block first lefts doc pos term item gone lines gap payload score n_words items contaminated root n_lines h t x".split()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_columns_of_any_name_pass(spark, docs, folder, name, stage):
    extra = [x for x in INNER if name != "sharding" or x not in ("shard", "slot")]
    more = docs.select("*", *[(docs.doc_id * 100 + k).cast("string").alias(x) for k, x in enumerate(extra)])
    out = stage(spark, more, folder)
    assert out.columns[: len(more.columns)] == more.columns
    want = {r.doc_id: tuple(r) for r in more.where("doc_id IS NOT NULL").collect()}
    got = [r for r in out.select(*more.columns).collect() if r.doc_id is not None]
    assert got and all(tuple(r)[5:] == want[r.doc_id][5:] for r in got)


def test_operators_pass_over_columns_of_any_name(spark, docs):
    more = docs.select("*", *[docs.doc_id.cast("string").alias(x) for x in INNER])
    assert rows(chunks.drop_repeated(more), ["doc_id", "text", "row", "gone"]) and mixing.mix(more).count() == more.count()
    assert decontaminate.decontaminate(more, docs.selectExpr("doc_id AS item_id", "text")).count() == more.count()


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(f"{path}/{os.path.basename(p)}")
    return path


CORPUS = [x for x in sorted(entry.queries()) if re.match(r"op\d+_|pipeline", x)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", CORPUS)
def test_queries_on_empty_tables(spark, empty, name):
    assert entry.queries()[name](spark, empty).count() == 0
