"""Spans against the plain patterns of the contract, run naively."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillfold.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            n = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(n) <= 19 and pii.luhn(n), "phone": 9 <= len(n) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@_%+-0123456789 ()é\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert [x for x in pii.spans(text) if x[2] in pii.KINDS[:4]] == plain(text)


def test_known_values():
    text = "mail bob@x.org, card 4111 1111 1111 1111, ip 10.0.0.256 and 10.0.0.1, +44 20 7946 0958, IBAN GB82 WEST 1234 5698 7654 32"
    assert [x[2] for x in pii.spans(text)] == ["email", "card", "ip", "phone", "iban"]
    assert pii.redact("a b@c.de") == "a <email>"
    assert pii.spans("") == [] and pii.spans("9" * 50_000) == []


def test_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a@b.c", None), (3, "a@b.c", None)], "doc_id long, text string, spans string")
    got = sorted((r.doc_id, r.n_email, r.spans) for r in pii.scan(rows).collect())
    assert got == [(1, 0, ""), (2, 0, ""), (3, 1, "email:0:5"), (3, 1, "email:0:5")]
    assert pii.scan(rows.where("false")).count() == 0
