"""Nulls, empty and long texts, repeated rows, empty tables and extra columns, for every operator and stage."""

import re

import pytest

import corpus_pipeline
from quillfold.llm import chunks, decontaminate, jaccard, language, mixing, ngram, rules, sharding, succinct, toxicity

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
A = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
ROWS = [
    (1, A, "en", "s0", 1, "x"), (2, A, "en", "s0", 1, "x"), (2, A, "en", "s0", 1, "x"), (3, None, None, None, None, None), (4, "", "en", "s1", 0, "x"), (5, " \n\t", None, "s1", 3, None),
    (6, LONG, "de", "s0", len(LONG), "x"), (7, LONG + " tail", "de", None, 1, "x"), (None, "no id here but words enough", "en", "s2", 1, "x"), (None, None, None, None, None, None),
    (8, "one two", "fr", "s2", 7, "x"), (8, "another text with the same id as the last", "fr", "s2", 7, "x"), (9, "a\nb\na\nb\n\n" * 40, "fr", "s2", 7, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(10, A), (11, None), (12, ""), (13, "one two"), (None, "with the same"), (14, A)], "item_id long, text string")


def counts(df):
    return df.count()


def test_decontamination(docs, items):
    got = decontaminate.decontaminate(docs, items).collect()
    assert len(got) == len(ROWS)
    first = [r for r in got if r.doc_id in (1, 2)]
    assert [(r.n_words, r.n_hit, r.contaminated, list(r["items"])) for r in first] == [(16, 16, True, ["10", "14"])] * 3
    assert {(r.n_words, r.n_hit, tuple(r["items"])) for r in got if r.doc_id == 8} == {(2, 2, ("13",)), (9, 3, ("",))}
    assert all(not r.contaminated for r in got if r.doc_id in (3, 4, 5, 6, 7, 9, None))
    assert decontaminate.decontaminate(docs.where("false"), items).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, items.where("false")).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x b filler a y"), (2, "a " + "z " * 40 + "b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.proximity_matches(docs, items, 5).collect()} == {1}


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * total) < 6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(docs.where("false")).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(docs.where("doc_id = 4")).collect())


def test_sharding(docs):
    rows = corpus_pipeline.carried(docs)
    got = sharding.shard(rows, 4, "row", rows_per_partition=3, rows_per_block=2).collect()
    assert len(got) == len(ROWS)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by.values()) and sorted(map(len, by.values())) == [3, 3, 3, 4]
    assert sharding.shard(rows.where("false"), 4, "row").count() == 0


def test_matrix_margins():
    import numpy as np

    counts, size = [5, 0, 7, 9, 4, 0, 0, 0], np.array([10, 8, 7])
    lefts = [[sum(counts[(2 * (p >> (3 - d))) << (2 - d) : (2 * (p >> (3 - d)) + 1) << (2 - d)]) for d in range(3)] for p in range(8)]
    rows, before = zip(*(sharding.matrix_row(p, lefts[p], size, 3) for p in range(8)), strict=True)
    assert (np.array(rows).sum(1) == counts).all() and (np.array(rows).sum(0) == size).all() and (np.array(rows) >= 0).all()
    assert (np.array(before) == np.cumsum([np.zeros(3, int), *rows[:-1]], 0)).all()


def test_slots_are_a_bijection():
    import numpy as np

    for size in (1, 2, 3, 40, 1000, 4097):
        got = np.concatenate([sharding.bijection(np.arange(a, min(size, a + 100)), size, 1, 7) for a in range(0, size, 100)])
        assert sorted(got) == list(range(size)) and (size < 40 or (got != np.arange(size)).mean() > 0.9)


def test_language(docs):
    net = language.fit(docs)
    got = language.predict(docs, net).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"} and "und" not in {r.lang_pred for r in got if r.doc_id in (1, 6, 9)}
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.where("false"))).collect()} == {"und"}


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (2, 0, 0), (6, 1, 0), (None, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false"), labels.where("toxic = 0")):
        got = toxicity.score(docs, toxicity.fit(docs, some)).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)


def test_toxicity_learns_words_stems_and_disguises(spark):
    import numpy as np

    clean = [f"fine words number {'abcdefghij'[i % 10]} here {'klmnopqr'[i % 8]} today" for i in range(300)]
    bad = [c.replace("words", "you scoundrel" if i % 2 else "villain" + "abcdefg"[i % 7]) for i, c in enumerate(clean[:100])]
    texts = spark.createDataFrame(list(enumerate(clean + bad)), "doc_id long, text string")
    model = toxicity.fit(texts, spark.createDataFrame([(i, int(i >= 300)) for i in range(400)], "doc_id long, toxic int"))
    score = lambda t: float(model.score(np.array([toxicity.features(t, model.lexicon)]))[0])
    assert score("fine scoundrel here today") > 0.5 > score("fine weather here today") and score("fine villainq here") > 0.5
    x = toxicity.features("a sc0undr3l", model.lexicon)
    assert x[toxicity.FEATURES.index("hidden")] == 1


def test_line_chunks(spark):
    shared = [f"shared line {i}" for i in range(12)]
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(5)] + shared + [f"end {i}"])) for i in range(6)] + [(7, None), (8, ""), (9, "\n\n\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in chunks.drop_repeated(docs).collect()}
    assert got[0].n_removed == 0 and got[0].text == rows[0][1] and all(got[i].n_removed >= 4 for i in range(1, 6))
    for i in range(1, 6):
        left = got[i].text.split("\n")
        assert [x for x in rows[i][1].split("\n") if x in left or x not in shared] == left and len(left) + got[i].n_removed == got[i].n_lines
    assert got[7].text is None and got[7].n_lines == 0 and got[8].n_removed == got[9].n_removed == 0
    assert chunks.drop_repeated(docs.where("false")).count() == 0


def test_line_chunks_on_edges(docs):
    assert chunks.drop_repeated(docs).count() == len(ROWS)


def test_jaccard(docs):
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    name = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    assert name[3, 0] == 3 and name[4, 0] == 4 and name[8, 1] == 8 and name[None, 0] is None and name[None, 2] is None
    assert jaccard.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("light", [1, 24])
def test_jaccard_against_all_pairs(spark, light):
    import random

    r = random.Random(5)
    base = [[f"t{r.randrange(4000)}" for _ in range(60)] for _ in range(8)]
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for k in range(160):
        w = list(base[k % 8])
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"z{k}{r.randrange(99)}"
        texts.append(" ".join(w if k % 3 else passage + w[: r.randrange(5, 20)]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(docs, light=light).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(texts))}


def test_rules(docs):
    got = rules.judge(docs).collect()
    assert len(got) == len(ROWS) and all(r.base_failed and not r.kept for r in got if r.doc_id in (3, 4, 5))
    row = next(r for r in got if r.doc_id == 9)
    assert row.n_dup_lines == 158 and row.n_repeat_words == row.n_words == 160
    assert rules.judge(docs.where("false")).count() == 0


def test_ngrams(docs):
    got = ngram.score(docs, ngram.train(docs), "doc_id", "term").collect()
    assert len(got) == len(ROWS) and all(r.score <= 0 and r.n_known == r.n_tokens for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert {r.n_tokens for r in ngram.score(docs, ngram.train(docs.where("false")), "doc_id").collect() if r.doc_id == 8} == {3, 10}
    one = docs.where("doc_id = 1")
    assert {r.n_known for r in ngram.score(docs, ngram.train(one), "doc_id").collect() if r.doc_id == 9} == {1}


def test_monotone_sequences():
    import numpy as np

    r = np.random.default_rng(3)
    for n, most in ((0, 1), (1, 5), (500, 3), (3000, 10**7)):
        v = np.sort(r.integers(0, most, n))
        parts = succinct.load(np.frombuffer(succinct.save(succinct.monotone(v)), np.uint8))
        assert (succinct.element(parts, np.arange(n)) == v).all()
        if n > 1:
            a, b = succinct.neighbours(parts, np.arange(n - 1))
            assert (a == v[:-1]).all() and (b == v[1:]).all()
    v = r.integers(0, 2**23, 1000)
    assert (succinct.unpacked(succinct.packed(v, 23), 23, np.arange(1000)) == v).all()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, tmp_path, name, stage):
    spark.createDataFrame([(1, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "tail one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert kept <= {(r[0], r[1]) for r in ROWS}
    assert out.columns[: len(docs.columns)] == docs.columns
    if name == "jaccard":
        assert {x[0] for x in kept} == {1, 3, 4, 5, 6, 8, 9, None} and out.where("doc_id = 1").count() == 1
    if name in ("toxicity", "sharding"):
        assert out.count() == len(ROWS)
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
