"""The Jaccard stage keeps one row of every component, and every unlinked text."""

import corpus_pipeline

A = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
SCHEMA = "doc_id long, text string, source string"


def test_one_row_of_each_component(spark):
    alone = [(None, f"unlinked text number {i} of {i * 7} and {i * 13}", "n") for i in range(6)]
    same_id = [(8, "one two", "e"), (8, "another text with the same id as the last", "e")]
    linked = [(3, A + " end", "l"), (2, A, "b"), (2, A, "a"), (2, A, "a"), (None, A, "l")]
    all_null = [(None, "both of these rows have no id at all", "z"), (None, "both of these rows have no id at all", "y")]
    bare = [(5, None, "w"), (5, None, "w"), (6, "", "w"), (None, " ", "w")]
    docs = spark.createDataFrame(alone + same_id + linked + all_null + bare, SCHEMA).repartition(3)
    want = alone + same_id + [(2, A, "a"), (None, "both of these rows have no id at all", "y")] + bare
    got = [tuple(r) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_null_ids_without_repeats(spark):
    rows = [(None, f"unlinked text number {i} of {i * 7} and {i * 13}", "n") for i in range(6)]
    got = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
