"""Results don't depend on bounds: with every broadcast bound at 0 and small fans, ranges and blocks, rows stay the same."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillfold.llm import chunks, common, decontaminate, jaccard, mixing, ngram, ranges
from quillfold.llm.common import Scratch


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    line = [" ".join(f"t{r.randrange(300)}" for _ in range(r.randrange(4, 70))) for _ in range(60)]
    rows = [(i, "\n".join(r.choice(line) if r.random() < 0.4 else f"own {i} " + " ".join(f"u{r.randrange(900)}" for _ in range(12)) for _ in range(4)), "abc"[i % 3]) for i in range(120)]
    rows += [(200 + i, rows[i][1] + (" end" if i % 2 else ""), "a") for i in range(30)] + [(None, None, None), (None, rows[3][1], None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


@pytest.fixture(scope="module")
def items(spark, docs):
    some = [(r.doc_id, " ".join(r.text.split()[3:40])) for r in docs.where("doc_id < 10").collect()]
    return spark.createDataFrame([*some, (99, "t1 t2 t3"), (None, "own 5")], "item_id long, text string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_filter_clears_no_key(spark):
    keys = common.stored(spark.range(0, 3000, 7).selectExpr("xxhash64(id) AS k"), "keys")
    rows_ = spark.range(3000).selectExpr("id", "xxhash64(id) AS k")
    passed = {r.id for r in rows_.where(common.may_be_in(keys, "k", rows_.k)).collect()}
    assert set(range(0, 3000, 7)) <= passed and len(passed) < 800


def test_lookups(spark, docs):
    table = docs.selectExpr("doc_id", "xxhash64(text) AS rk", "source")
    keys = common.stored(table.where("doc_id % 3 = 0 OR doc_id IS NULL").selectExpr("doc_id AS _id", "rk AS _rk", "doc_id + 1 AS more").distinct(), "keys")
    for f in (common.matching, common.unmatched, common.looked_up):
        assert rows(f(table, keys, 0)) == rows(f(table, keys)) and rows(f(table, keys))


def test_jaccard_by_filter(docs, monkeypatch):
    want = rows(jaccard.near_duplicates(docs))
    assert rows(jaccard.near_duplicates(docs, most_rows=0)) == want
    monkeypatch.setattr(ranges, "FAN", 3)
    monkeypatch.setattr(ranges, "FLUSH", 50)
    assert rows(jaccard.near_duplicates(docs, light=1)) == want


def test_passages_by_filter(docs):
    assert rows(chunks.drop_repeated(docs, most_rows=0)) == rows(chunks.drop_repeated(docs))


def test_decontamination_by_filter(docs, items):
    want = rows(decontaminate.decontaminate(docs, items))
    assert rows(decontaminate.decontaminate(docs, items, most_rows=0)) == want and any("True" in x for x in want)


def test_mixing_by_small_ranges(docs):
    want = rows(mixing.mix(docs))
    for n in (1, 7, 10**9):
        assert rows(mixing.mix(docs, rows_per_range=n)) == want


def test_model_in_many_ranges(docs, monkeypatch):
    want = [(r.doc_id, r.n_known, round(r.base_score, 9)) for r in ngram.score(docs, ngram.train(docs), "doc_id").orderBy("doc_id", "n_known").collect()]
    monkeypatch.setattr(ranges, "FAN", 3)
    monkeypatch.setattr(ranges, "FLUSH", 50)
    monkeypatch.setattr(ngram, "TOKENS_PER_SHARD", 300)
    got = ngram.score(docs, ngram.train(docs), "doc_id").orderBy("doc_id", "n_known").collect()
    assert [(r.doc_id, r.n_known, round(r.base_score, 9)) for r in got] == want


def messages_of_a_shard(folder):
    """A model whose one shard has 600,000 rows in eight messages, and these rows with their exchange."""
    rng, words = np.random.default_rng(5), 5000
    ngram.write(folder, "words-0", ngram.ef.save({"hash": np.arange(words, dtype=np.uint64), "count": np.full(words, 1000)}))
    model = ngram.Model(folder, np.array([0, words]), 600_000, 0.5, 10, np.array([0, (words + 1) * (words + 2)], np.uint64), np.zeros(0), {})
    by = ranges.Exchange(lambda key: np.searchsorted(key, model.bounds), 1, np.uint64, (np.uint32, np.uint32))
    sent = []
    for _ in range(8):
        one, two, third = (rng.zipf(1.3, 75_000) % words for _ in range(3))
        third[::9] = words + 1  # the mark after an end
        key = (one * model.span + two).astype(np.uint64)
        order = np.argsort(key)
        sent.append(by.messages([key[order], third[order].astype(np.uint32), rng.integers(1, 4, len(key))], [], 1))
    return model, by, pa.Table.from_batches(sent)


def test_shard_is_built_in_bounded_memory(tmp_path, monkeypatch):
    model, by, sent = messages_of_a_shard(str(tmp_path))
    wholes = []
    for rows in (1 << 10, 1 << 14, 10**9):
        monkeypatch.setattr(ngram, "ROWS_AT_ONCE", rows)
        tracemalloc.start()
        made = ngram.build(model, by, 0, sent).to_pylist()
        peak = tracemalloc.get_traced_memory()[1] / 600_000
        tracemalloc.stop()
        assert peak < 40 or rows == 10**9, f"{peak:.0f} bytes a row"
        wholes.append((made, (tmp_path / "trie-0").read_bytes()))
    assert wholes[0] == wholes[1] == wholes[2]
    columns, _ = by.merged(sent.to_pylist())
    found = set(zip(columns[0].tolist(), columns[1].tolist(), strict=True))
    assert made[0]["nodes"] == len({k for k, _ in found}) and made[0]["trigrams"] == sum(w != model.words + 1 for _, w in found)


def test_stretches_are_all_rows_with_whole_keys(tmp_path):
    _, by, sent = messages_of_a_shard(str(tmp_path))
    parts = list(by.stretches(sent, 20_000))
    assert all(a[0].max() < b[0].min() for a, b in zip(parts, parts[1:], strict=False)) and len(parts) > 5
    often = max(np.unique(by.merged(sent.to_pylist())[0][0], return_counts=True)[1])
    assert max(len(p[0]) for p in parts) <= 20_000 + often + 8 * (20_000 >> 12) + 8
    for got, want in zip(zip(*parts, strict=True), by.merged(sent.to_pylist())[0], strict=True):
        assert (np.sort(np.concatenate(got)) == np.sort(want)).all()


def test_scratch_goes(spark, docs):
    keep = Scratch(docs)
    table = keep(docs, "some")
    path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert os.path.isdir(path)
    keep.close()
    assert not os.path.exists(path)
