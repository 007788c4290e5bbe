"""Benchmark decontamination over a distributed positional inverted index.

The index stores the postings (term, document, position) of every benchmark term in all documents; everything but the
documents' word counts is then read from it. For a window of a benchmark item (`width` consecutive words, or the whole of
a shorter item) the postings of its rarest term propose alignments of the item with a document. They are intersected with
the postings of the window's next rarest terms, shifted by the terms' offsets, and what is left with those of all its
terms. Runs of matched positions as long as a window are phrase matches. Proximity matches are read from the same index.

A list is intersected by looking postings up: few wanted ones are broadcast, many pass a filter of bounded size over the
index before both sides are shuffled. No texts are moved.

Null or wordless texts have no postings and come back clean; texts of any length are indexed whole. Documents and items
are told apart by a 64-bit hash of id and text, equal rows get equal results, and a null id is an id like any other. An empty table of
items leaves every document clean, an empty table of documents gives no rows. Columns besides ids and texts are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .chunks import stretches

WIDTH = 13
#: Words of a proximity match.
SLOP = 20
#: Terms of a window that are intersected one after another, from the rarest, before all the others at once.
RAREST = 3


def words_of(text: Column) -> Column:
    return c.tokens(c.lower_ascii(text), c.NON_WORD)


def worded(items: DataFrame) -> DataFrame:
    """item_id, item_rk (text hash), item words: items are told apart by id and text, as documents are; equal rows are one."""
    rows = items.select("item_id", "text").distinct()
    return rows.select("item_id", F.xxhash64("text").alias("item_rk"), words_of(F.col("text")).alias("item")).where(F.size("item") > 0)


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number for each item and text), item_id, n (its words), at, term: one row for each word."""
    named = worded(items).select(F.xxhash64("item_rk", F.coalesce(F.col("item_id").cast("string"), F.lit("null"))).alias("item"), "item_id", F.size("item").alias("n"), "item_rk", F.posexplode("item").alias("at", "term"))
    return named.drop("item_rk")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc (a number for each id and text), pos (from 0), term (a number): the postings of the stored terms(word, term).

    Only numbers leave the explode, and the outer form keeps the optimizer from adding a filter that would split every
    text a second time; the join drops its null rows.
    """
    listed = docs.select(doc_key(), F.posexplode_outer(words_of(F.col("text"))).alias("pos", "word"))
    return listed.join(c.small(terms, c.BROADCAST_ROWS), "word").select("doc", "pos", "term")


def doc_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.octet_length("text")).alias("doc")


def looked_up(postings: DataFrame, wanted: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Rows of the stored wanted(doc, pos, term, ...) whose posting is in the index."""
    on = ["doc", "pos", "term"]
    if wanted.count() <= (c.BROADCAST_ROWS if most_rows is None else most_rows):
        return postings.join(F.broadcast(wanted), on).select(*wanted.columns).distinct()
    keys = wanted.select(F.xxhash64(*on).alias("k"))
    near = postings.where(c.may_be_in(keys, "k", F.xxhash64(*on))).distinct()
    return wanted.join(near, on, "left_semi").distinct()


class Index:
    """The stored postings of the documents for the items' terms, and how often each term occurs."""

    def __init__(self, docs: DataFrame, items: DataFrame, keep: c.Scratch, most_rows: int | None = None):
        self.keep, self.most_rows = keep, most_rows
        words = keep(item_terms(items), "item-words")
        terms = words.select("term").distinct().withColumnRenamed("term", "word")
        numbered = keep(terms.withColumn("term", F.xxhash64("word")), "terms")
        same = numbered.groupBy("term").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        if same.take(1):
            raise ValueError("two benchmark terms have the same 64-bit hash")
        self.terms = keep(words.withColumnRenamed("term", "word").withColumn("term", F.xxhash64("word")).drop("word"), "item-terms")
        self.postings = keep(index(docs, numbered), "postings")
        self.counts = keep(self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("postings")), "term-counts")
        keep.drop(words, numbered)

    def windows(self, width: int) -> DataFrame:
        """item, need, start, terms: one row for each window, its terms as (postings, term, offset) from the rarest, of each
        term one place. Windows with a term that no document has can't occur and are left out."""
        sized = self.terms.withColumn("need", F.least(F.lit(width), F.col("n")))
        first, last = F.greatest(F.lit(0), F.col("at") - F.col("need") + 1), F.least(F.col("at"), F.col("n") - F.col("need"))
        each = sized.select("item", "need", "at", "term", F.explode(F.sequence(first, last)).alias("start"))
        rated = each.join(self.counts, "term", "left").select("item", "need", "start", "term", (F.col("at") - F.col("start")).alias("offset"), F.coalesce("postings", F.lit(0)).alias("k"))
        rated = rated.groupBy("item", "need", "start", "k", "term").agg(F.min("offset").alias("offset"))
        return rated.groupBy("item", "need", "start").agg(F.array_sort(F.collect_list(F.struct("k", "term", "offset"))).alias("terms")).where("terms[0].k > 0")

    def aligned(self, width: int) -> DataFrame:
        """item, need, start, doc, first: windows whose RAREST terms all stand in the document at their offsets from `first`."""
        windows = self.keep(self.windows(width), "windows")
        # windows of an item that share their rarest term at one place of it propose the same postings once
        probe = windows.select("item", "start", F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["offset"].alias("offset"))
        probe = self.keep(probe.select("item", "term", (F.col("start") + F.col("offset")).alias("at"), "start", "offset"), "probes")
        once = c.small(self.keep(probe.select("item", "term", "at").distinct(), "probe-terms"), c.BROADCAST_ROWS)
        met = self.postings.join(once, "term").select("doc", "pos", "item", "at")
        near = met.join(c.small(probe.drop("term"), c.BROADCAST_ROWS), ["item", "at"]).select("doc", "item", "start", (F.col("pos") - F.col("offset")).alias("first"))
        near = self.keep(near.where("first >= 0").distinct(), "alignments")
        # only documents with alignments matter from here on
        self.close = self.keep(self.within(near), "close-postings")
        for k in range(1, RAREST):
            side = windows.select("item", "start", F.get("terms", k)["term"].alias("term"), F.get("terms", k)["offset"].alias("offset"))
            wanted = near.join(c.small(side, c.BROADCAST_ROWS), ["item", "start"])
            whole = self.keep(wanted.where("term IS NULL").select("doc", "item", "start", "first"), "alignments")
            wanted = self.keep(wanted.where("term IS NOT NULL").select("doc", (F.col("first") + F.col("offset")).alias("pos"), "term", "item", "start", "first"), "wanted")
            found = self.keep(looked_up(self.close, wanted, self.most_rows).select("doc", "item", "start", "first").unionByName(whole), "alignments")
            self.keep.drop(near, whole, wanted)
            near = found
        return near.join(c.small(windows.select("item", "start", "need"), c.BROADCAST_ROWS), ["item", "start"])

    def phrases(self, width: int = WIDTH) -> DataFrame:
        """doc, item, first, last: stretches of document words (from 0, inclusive) made of whole windows of the item."""
        near = self.keep(self.aligned(width), "alignments")
        # windows of one alignment of item and document overlap: each of its places is looked up once
        places = near.select("doc", "item", "need", (F.col("first") - F.col("start")).alias("shift"), F.explode(F.expr("sequence(start, start + need - 1)")).alias("at")).distinct()
        side = self.terms.select("item", "at", "term")
        wanted = self.keep(places.join(c.small(side, c.BROADCAST_ROWS), ["item", "at"]).withColumn("pos", F.col("shift") + F.col("at")), "wanted")
        found = looked_up(self.close, wanted, self.most_rows)
        runs = found.groupBy("doc", "item", "need", "shift").agg(F.array_sort(F.collect_set("pos")).alias("p"))
        runs = runs.select("doc", "item", "need", F.explode(stretches("p")).alias("x")).where("x.n >= need")
        return runs.select("doc", "item", F.col("x.start").alias("first"), (F.col("x.start") + F.col("x.n") - 1).alias("last")).distinct()

    def within(self, some: DataFrame) -> DataFrame:
        """The postings of the documents that the stored table names."""
        docs = self.keep(some.select("doc").distinct(), "near-docs")
        if docs.count() <= (c.BROADCAST_ROWS if self.most_rows is None else self.most_rows):
            return self.postings.join(F.broadcast(docs), "doc", "left_semi")
        return self.postings.where(c.may_be_in(docs, "doc", F.col("doc"))).join(docs, "doc", "left_semi")

    def nearby(self, slop: int = SLOP) -> DataFrame:
        """doc, item, first, last: the shortest spans of at most `slop` words that hold every distinct term of the item, in
        any order, by their last word. Items of more distinct terms than `slop` have none."""
        terms = self.terms.groupBy("item", "term").agg(F.min("at").alias("at")).join(self.counts, "term", "left")
        sized = terms.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("m"), F.min(F.struct(F.coalesce("postings", F.lit(0)).alias("k"), "term")).alias("r")).where(f"m <= {slop} AND r.k > 0")
        sized = self.keep(sized.select("item", "m", F.col("r.term").alias("rare")), "near-items")
        listed = self.keep(terms.join(sized, "item").select("item", "term", "m", (F.col("term") == F.col("rare")).alias("rare")), "near-terms")
        if not listed.take(1):
            return listed.select(F.lit(0).cast("long").alias("doc"), "item", F.lit(0).alias("first"), F.lit(0).alias("last"))
        # a zone is two neighbouring buckets of slop words: every span lies in one, with its rarest term
        rare = self.postings.join(c.small(listed.where("rare").select("item", "term"), c.BROADCAST_ROWS), "term")
        bucket = F.floor(F.col("pos") / slop).cast("int")
        zones = self.keep(rare.select("doc", "item", F.explode(F.array(bucket - 1, bucket)).alias("zone")).distinct(), "zones")
        around = self.within(zones).select("doc", "pos", "term", F.explode(F.array(bucket - 1, bucket)).alias("zone"))
        around = around.join(c.small(zones, c.BROADCAST_ROWS), ["doc", "zone"]).join(c.small(listed.select("item", "term", "m"), c.BROADCAST_ROWS), ["item", "term"])
        met = around.groupBy("doc", "item", "m", "zone").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("p")).where("size(p) >= m")
        # at each last word, the latest place of every term up to it; a zone has 2 * slop words at most
        ends = met.select("doc", "item", "m", F.col("p"), F.explode("p").alias("x"))
        heads = F.filter("p", lambda y: (y["pos"] <= F.col("x.pos")) & (y["pos"] > F.col("x.pos") - slop))
        held = ends.select("doc", "item", "m", F.col("x.pos").alias("last"), heads.alias("h")).where("size(array_distinct(transform(h, y -> y.term))) = m")
        latest = F.expr("array_min(transform(array_distinct(transform(h, y -> y.term)), t -> array_max(transform(filter(h, y -> y.term = t), y -> y.pos))))")
        return held.select("doc", "item", latest.alias("first"), "last").groupBy("doc", "item", "first").agg(F.min("last").alias("last"))


def matches(docs: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, item_id, first, last of found(doc, item, first, last)."""
    names = docs.select("doc_id", doc_key()).distinct().join(found, "doc")
    return names.join(item_terms(items).select("item", "item_id").distinct(), "item").select("doc_id", "item_id", "first", "last").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, most_rows: int | None = None) -> DataFrame:
    """doc_id, item_id, first, last: stretches of document words (from 0, inclusive) made of whole windows of the item."""
    return matches(docs, items, Index(docs, items, c.Scratch(docs), most_rows).phrases(width))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP) -> DataFrame:
    """doc_id, item_id, first, last: shortest spans of at most `slop` words with every distinct term of the item."""
    return matches(docs, items, Index(docs, items, c.Scratch(docs)).nearby(slop))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = 0.05, keep_hash: bool = False, most_rows: int | None = None, slop: int | None = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings), n_near (items that the document holds within `slop` words),
    contaminated, one row for each row of docs; with keep_hash also rk, the hash of the text."""
    keep = c.Scratch(docs)
    built = Index(docs, items, keep, most_rows)
    hits = keep(built.phrases(width), "phrases")
    ids = built.terms.select("item", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")).distinct()
    seen = hits.select("doc", F.explode(F.sequence("first", "last")).alias("p")).groupBy("doc").agg(F.countDistinct("p").alias("n_hit"))
    named = hits.join(c.small(keep(ids, "item-ids"), c.BROADCAST_ROWS), "item").groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    near = built.nearby(slop).groupBy("doc").agg(F.countDistinct("item").alias("n_near")) if slop else hits.select("doc", F.lit(0).cast("long").alias("n_near")).limit(0)
    all_ = c.stored(seen.join(named, "doc").join(near, "doc", "full").select("doc", "n_hit", "items", "n_near"), "contaminated")
    keep.close()
    sized = docs.select("doc_id", F.xxhash64("text").alias("rk"), doc_key(), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    zero = F.lit(0).cast("long")
    out = sized.join(c.small(all_, c.BROADCAST_ROWS), "doc", "left").select(
        "doc_id", *(["rk"] if keep_hash else []), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("n_near", zero).alias("n_near")
    )
    scale = round(1 / share)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (scale * F.col("n_hit") >= F.col("n_words")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(c.read(spark, sf_dir, "documents"), c.read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "n_near"
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS need FROM (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
b2 AS (SELECT item_id, text, w FROM (SELECT item_id, text, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, need, array_to_string(w[i:i + need - 1], ' ') AS k FROM (SELECT item_id, w, need, unnest(range(1, len(w) - need + 2)) AS i FROM b)),
lens AS (SELECT DISTINCT need FROM b),
dw AS (SELECT doc_id, i, need, array_to_string(w[i:i + need - 1], ' ') AS k FROM (SELECT doc_id, w, need, unnest(range(1, len(w) - need + 2)) AS i FROM d, lens WHERE len(w) >= need)),
h AS (SELECT doc_id, item_id, i, dw.need FROM dw JOIN bw ON dw.k = bw.k AND dw.need = bw.need),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + need)) AS q FROM h) GROUP BY doc_id),
bt AS (SELECT item, any_value(m) AS m, term FROM (SELECT item, count(DISTINCT term) OVER (PARTITION BY item) AS m, term FROM (SELECT DISTINCT item, term FROM (SELECT item, unnest(w) AS term FROM (SELECT row_number() OVER () AS item, w FROM (SELECT DISTINCT item_id, text, w FROM b2))))) WHERE m <= 20 GROUP BY item, term),
dp AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS term FROM d),
dt AS (SELECT doc_id, item, m, pos, term FROM dp JOIN bt USING (term)),
full_ AS (SELECT doc_id, item FROM dt GROUP BY doc_id, item, m HAVING count(DISTINCT term) = m),
dz AS (SELECT dt.* FROM dt JOIN full_ USING (doc_id, item)),
nr AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM (SELECT x.doc_id, x.item, x.pos FROM dz x JOIN dz y ON x.doc_id = y.doc_id AND x.item = y.item AND y.pos BETWEEN x.pos - 19 AND x.pos GROUP BY x.doc_id, x.item, x.pos, x.m HAVING count(DISTINCT y.term) = x.m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
