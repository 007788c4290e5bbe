"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Spans are (kind, start, end) in code points, end exclusive. Of each base kind the matches are the leftmost
non-overlapping ones; one that fails its check is dropped and not tried again, and one that passes stays, whatever its
score. Kinds beyond the base (IBAN with mod-97, US social security numbers, and secrets: keys and tokens whose letters and
digits are as mixed as random ones) need a score of LEAST_SCORE: their prior, raised or lowered by the words around them.

Null and empty texts have no spans; texts of any length are scanned whole and in linear time, since every pattern starts
only where a run of its characters starts. Rows are scanned one by one, so repeated rows agree; an empty table gives no
rows, and columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as c

# Kinds in the order of the contract, then the added ones.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = 4
LEAST_SCORE = 0.6

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the head of a digit run: any later start in the run fails or succeeds with it.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
DIGIT = re.compile("[0-9]")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: A run of key characters, as long as a key; KEY_MARK are prefixes that name a key by themselves.
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
KEY_MARK = re.compile(r"AKIA[0-9A-Z]{16}$|gh[pousr]_|xox[abprs]-|sk_live_")
#: Least entropy of a secret in bits a character; random hexadecimal digits have nearly 4.
LEAST_BITS = 3.2
#: Words that make a kind likelier within CONTEXT characters of a span, and words that make it less likely.
CONTEXT = 48
FOR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"), "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "key", "apikey", "password", "passwd", "credential", "auth", "bearer"),
}
AGAINST = ("version", "isbn", "serial", "order", "example", "checksum", "sha", "commit")
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.5, "secret": 0.5}
RAISE, LOWER = 0.2, 0.3
#: A value that is given to such a name is raised once more.
GIVEN = re.compile(r"(?i)(?:token|secret|key|passw(?:or)?d|credentials?|auth|bearer)[^A-Za-z0-9]{1,6}$")
NEAR_WORD = re.compile("[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    packed = iban.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(ch, 36)) for ch in packed[4:] + packed[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @, dotted domain, from one @ to the next."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", domain.end() if domain else at + 1)


def digits_of(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def bits(text: str) -> float:
    """Entropy of a text's characters, in bits for each."""
    return -sum(k / len(text) * math.log2(k / len(text)) for k in Counter(text).values())


def random_looking(text: str) -> bool:
    """Whether a run is mixed like a key: letters and digits in turn, and no few characters that make up most of it."""
    letters, digits = re.search("[A-Za-z]", text), DIGIT.search(text)
    return bool(KEY_MARK.match(text)) or bool(letters and digits) and bits(text) >= LEAST_BITS


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all confirmed spans by start, then kind."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(a, b, "email") for a, b in emails(text)]
    more: list[tuple[int, int, str]] = []
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            number = digits_of(m[0])
            if 12 <= len(number) <= 19 and luhn(number):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
        more += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text) if mod97(m[0])]
        more += [(m.start(), m.end(), "ssn") for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9"]
        more += [(m.start(), m.end(), "secret") for m in SECRET.finditer(text) if random_looking(m[0])]
    found += [x for x in more if score(text, *x) >= LEAST_SCORE]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def score(text: str, start: int, end: int, kind: str) -> float:
    """How likely the confirmed span is personal data, from 0 to 1, by the words near it."""
    near = NEAR_WORD.findall(text[max(0, start - CONTEXT) : start].lower() + " " + text[end : end + CONTEXT].lower())

    def told(words: tuple[str, ...]) -> bool:
        return any(x == w or len(w) > 3 and x.startswith(w) for x in near for w in words)

    up = told(FOR[kind])
    if kind == "secret":
        up += bool(KEY_MARK.match(text, start)) + bool(GIVEN.search(text[max(0, start - 24) : start]))
    return round(min(1.0, max(0.0, PRIOR[kind] + RAISE * up - LOWER * told(AGAINST))), 6)


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redact(text: str) -> str:
    """The text with every span replaced by its kind; where spans overlap, the first one counts."""
    out, done = [], 0
    for a, b, k in spans(text):
        if a >= done:
            out += [text[done:a], f"<{k}>"]
            done = b
    return "".join([*out, text[done:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_likely long, score double"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id with counts by base kind, the digest of base spans, all spans and their number, how many of them score
    LEAST_SCORE or more, and the highest score (0 without spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = spans(text)
                base = [x for x in found if x[2] in KINDS[:BASE]]
                kinds = [x[2] for x in base]
                scores = [score(text, *x) for x in found]
                rows.append((*(kinds.count(k) for k in KINDS[:BASE]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), len(found), sum(x >= LEAST_SCORE for x in scores), max(scores, default=0.0)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.float64()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(c.released(run), SCHEMA)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(c.read(spark, sf_dir, "documents"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express."""
    return op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS m FROM d UNION ALL SELECT doc_id, 'ip', unnest(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')) FROM d
 UNION ALL SELECT doc_id, 'card', unnest(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')) FROM d UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')) FROM d),
n AS (SELECT doc_id, kind, m, regexp_replace(m, '[^0-9]', '', 'g') AS g FROM m),
k AS (SELECT doc_id, kind, CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0 WHEN 'phone' THEN length(g) BETWEEN 9 AND 15
 ELSE length(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(g)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(g[length(g) - i] AS INTEGER) ELSE CAST(g[length(g) - i] AS INTEGER) * 2 - CASE WHEN CAST(g[length(g) - i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 END AS ok FROM n)
SELECT d.doc_id, count(*) FILTER (ok AND kind = 'email') AS n_email, count(*) FILTER (ok AND kind = 'ip') AS n_ip, count(*) FILTER (ok AND kind = 'card') AS n_card, count(*) FILTER (ok AND kind = 'phone') AS n_phone FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""
