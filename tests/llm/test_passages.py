"""Repeated passages of any length in differing contexts, against a plain-Python version of the rule."""

import random

import pytest

from quillfold.llm import chunks


def words(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def brute(rows):
    """(text, n_removed) by row number: lines of later occurrences of two-line windows and of lines of over 50 words."""
    seen, gone = {}, {}
    for doc, text in sorted({x for x in rows if x[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = text.split("\n")
        for i in range(len(lines)):
            for n in (1, 2):
                body = "\n".join(lines[i : i + n])
                if i + n > len(lines) or not body.strip() or (n == 1 and len(body.split()) <= 50):
                    continue
                first = seen.setdefault(body, (doc, i))
                if first != (doc, i):
                    gone.setdefault((doc, text), set()).update(k for k in range(i, i + n) if first[0] != doc or k >= first[1] + n)
    out = []
    for doc, text in rows:
        cut = gone.get((doc, text), set())
        out.append((doc, text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in cut), len(cut)))
    return sorted(out, key=str)


def got(docs):
    return sorted(((r.doc_id, r.text, r.n_removed) for r in chunks.drop_repeated(docs).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_passage_goes_whole_in_differing_contexts(spark, n):
    r = random.Random(n)
    passage = [words(r, 60 if n == 1 else 12) for _ in range(n)]
    rows, left = [], []
    for i in range(8):
        before, after = [words(r, 12) for _ in range(i % 3)], [words(r, 12) for _ in range(i % 4)]
        rows.append((i, "\n".join(before + passage + after)))
        left.append((i, rows[0][1] if i == 0 else "\n".join(before + after), n if i else 0))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == sorted(left, key=str)


def test_against_brute_force(spark):
    r = random.Random(9)
    pool = [words(r, r.choice([1, 5, 55])) for _ in range(25)] + ["", " ", "x"]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.7 else words(r, 8) for _ in range(r.randrange(1, 9)))) for i in range(120)]
    rows += [(200, "x\nx\nx\nx"), (201, "\n\n\n"), (202, None), (203, ""), (None, rows[0][1]), rows[5], rows[5]]
    want = brute(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want
    left = "\n".join(t for _, t, _ in want if t).split("\n")
    assert {x for _, t in rows if t for x in t.split("\n") if x.strip()} == {x for x in left if x.strip()}


def test_bodies_of_one_hash_are_compared(spark, monkeypatch):
    true_hash = chunks.F.xxhash64
    monkeypatch.setattr(chunks.F, "xxhash64", lambda *x: true_hash(*x) % 3)
    rows = [(1, "a\nb"), (2, "c\nd"), (3, "a\nb\ne"), (4, "f\ng\nh"), (5, "d\nf\ng"), (6, "i\nj")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
