"""Benchmark rows that share an id, or have none, are found by each of their texts."""

from quillfold.llm import decontaminate

FIRST, SECOND = ("stone river " + " ".join(f"{x}{i}" for i in range(14)) for x in ("a", "b"))
ABSENT = "stone river " + " ".join(f"never{i}" for i in range(14))


def test_items_of_equal_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "so " + FIRST), (2, SECOND + " then"), (3, "clean stone river"), (4, FIRST + " " + SECOND)], "doc_id long, text string")
    for key in (7, None):
        items = spark.createDataFrame([(key, FIRST), (key, SECOND), (key, ABSENT), (key, SECOND)], "item_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated, list(r["items"])) for r in decontaminate.decontaminate(docs, items).collect()}
        name = [str(key) if key else ""]
        assert got == {1: (17, 16, True, name), 2: (17, 16, True, name), 3: (3, 0, False, []), 4: (32, 32, True, name)}


def test_proximity_of_equal_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "x b filler a y"), (2, "q c d")], "doc_id long, text string")
    for key in (7, None):
        items = spark.createDataFrame([(key, "a b"), (key, "d c")], "item_id long, text string")
        assert {r.doc_id for r in decontaminate.proximity_matches(docs, items, 5).collect()} == {1, 2}


def test_proximity_against_brute_force(spark):
    import random

    r = random.Random(4)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 40)))) for i in range(40)]
    items = [(i, " ".join(r.choice("abcdefghx") for _ in range(r.randrange(1, 5)))) for i in range(12)] + [(99, "a b c d e f g h")]
    slop, want = 6, set()
    for i, text in docs:
        words = text.split()
        for k, item in items:
            need = set(item.split())
            for last in range(len(words)):
                if len(need) <= slop and need <= set(words[max(0, last - slop + 1) : last + 1]):
                    first = min(max(p for p in range(last + 1) if words[p] == w) for w in need)
                    want.add((i, k, first))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.proximity_matches(*frame, slop).collect()
    assert {(x.doc_id, x.item_id, x.first) for x in got} == want and len(want) > 50
    assert all(x.last - x.first < slop for x in got)
