"""Benchmark decontamination over a positional inverted index.

Corpus counts of the benchmark's terms give every window its two rarest terms, and every item its
rarest ones. The postings (term, document, position) of those terms alone are stored in the shared
folder, once, whatever the number of windows. A window is looked up in them: the list of its rarest
term, shifted by the offset of that term in the window, is intersected with the list of the second
one, shifted by its own; what survives is compared word for word where the document is read again.
Windows with a term that is nowhere in the corpus end at the counts. Proximity matches come from the
same lists: places of an item's rarest term that have its next rarest ones within a span of words.

The corpus is read three times: for the counts, for the postings, and for the words of the documents.
Lists are never gathered: an intersection is a join on document, position and term, so a term that a
third of the tokens are is spread over all tasks, and duplicates of a document are dropped before it.
The sides that hold the benchmark are broadcast after a count; beyond BROADCAST_ROWS they are joined by
shuffle over shards of the documents.

Cases: a null text has no words; an item of fewer words than a window is one window, an item of none
has no window; repeated rows get the same result; a null doc_id or item_id is carried (a null item
counts no item but hits words); an empty table on either side gives no hits; extra columns are ignored.
An item of one term is near wherever that term is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vespertide.llm.common import ascii_lower, discard, materialize, read_table, row_key, same_row, whole_text

WINDOW_WORDS = 13
#: Proximity: so many of an item's rarest terms within so many words of the rarest.
NEAR_TERMS = 3
NEAR_SPAN = 20
BROADCAST_ROWS = 500_000
SHARDS = 16
# Fixed value: what stands between words; words are runs of digits, letters a-z and everything beyond ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HIT_SHARE = 20
DOC = ["__vt_id", "__vt_text_hash"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(whole_text(text)), BETWEEN_WORDS), "")


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if its count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.__vt_id").eqNullSafe(F.col(f"{b}.__vt_id")) & (F.col(f"{a}.__vt_text_hash") == F.col(f"{b}.__vt_text_hash"))


def windows(benchmark: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """Distinct windows: phrase (their words), and the ids of the items that hold them."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    each = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
    return each.select("item_id", F.slice("w", F.col("i"), size).alias("phrase")).groupBy("phrase").agg(F.collect_set("item_id").alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences in the corpus of each of the given terms that occurs."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    if terms.count() <= BROADCAST_ROWS:
        return tokens.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    # Counted first, so that no term brings more than one row a task to the shuffle.
    return tokens.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(document, pos, term, shard) of every occurrence of the given terms."""
    tokens = row_key(docs).select(*DOC, F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return tokens.join(small(terms), "term", "left_semi").withColumn("shard", F.pmod(F.xxhash64(*DOC), F.lit(SHARDS)).cast("int"))


def by_term(lists: DataFrame, side: DataFrame) -> DataFrame:
    """Postings met with rows of the benchmark that ask for their term."""
    if side.count() <= BROADCAST_ROWS:
        return lists.join(F.broadcast(side), "term")
    return lists.join(side.withColumn("shard", F.explode(F.array(*[F.lit(i) for i in range(SHARDS)]))), ["term", "shard"])


def anchors_of(found: DataFrame, counted: DataFrame) -> DataFrame:
    """wid with its two rarest terms and their offsets; windows that hold a term the corpus lacks are left out."""
    each = found.select("wid", F.posexplode("phrase").alias("offset", "term"))
    ranked = each.join(counted, "term", "left").groupBy("wid").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("rare")
    )
    first, second = F.col("rare")[0], F.element_at("rare", F.least(F.size("rare"), F.lit(2)))
    return ranked.where("least > 0").select("wid", first["term"].alias("term"), first["offset"].alias("offset"), second["term"].alias("term2"), second["offset"].alias("offset2"))


def rarest_of_items(benchmark: DataFrame, counted: DataFrame, terms: int) -> DataFrame:
    """(item_id, need): the rarest distinct terms of each item that the corpus has, rarest first."""
    each = benchmark.where(F.col("item_id").isNotNull()).select("item_id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).distinct()
    return each.join(counted, "term").groupBy("item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term"))), 1, terms)["term"].alias("need"))


class Index:
    """The stored lists of what a benchmark asks for, and the benchmark's windows and items with the terms they are looked up by."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, near_terms: int = NEAR_TERMS):
        docs = docs.select("doc_id", "text")
        self.windows = materialize(windows(benchmark, width).withColumn("wid", F.monotonically_increasing_id()), "windows")
        asked = materialize(self.windows.select(F.explode("phrase").alias("term")).distinct(), "asked-terms")
        counted = materialize(term_counts(docs, asked), "term-counts")
        self.anchors = materialize(anchors_of(self.windows, counted), "window-anchors")
        self.items = materialize(rarest_of_items(benchmark, counted, near_terms), "item-terms")
        terms = self.anchors.select("term").union(self.anchors.select("term2")).union(self.items.select(F.explode("need"))).distinct()
        terms = materialize(terms, "listed-terms")
        self.lists = materialize(postings(docs, terms), "postings")
        for done in (asked, counted, terms):
            discard(done)

    def close(self) -> None:
        """Delete the stored tables."""
        for done in (self.windows, self.anchors, self.items, self.lists):
            discard(done)

    def candidates(self) -> DataFrame:
        """(document, start, wid): places where the two rarest terms of a window stand as they do in it."""
        start = F.col("pos") - F.col("offset")
        first = by_term(self.lists, self.anchors).where(start >= 0)
        first = first.select(*DOC, "wid", start.alias("start"), "term2", (start + F.col("offset2")).alias("pos2")).distinct()
        a, b = first.alias("a"), self.lists.alias("b")
        met = a.join(b, same_doc("a", "b") & (F.col("a.term2") == F.col("b.term")) & (F.col("a.pos2") == F.col("b.pos")))
        return met.select("a.__vt_id", "a.__vt_text_hash", "start", "wid").distinct()

    def near(self, span: int = NEAR_SPAN) -> DataFrame:
        """(document, item_id, pos): places of the rarest term of an item that have its next rarest ones within span words, in any order."""
        asked = self.items.select("item_id", F.col("need")[0].alias("term"), F.slice("need", 2, F.size("need")).alias("rest"))
        at = by_term(self.lists, asked).select(*DOC, "item_id", "pos", "rest").distinct()
        alone = at.where(F.size("rest") == 0).select(*DOC, "item_id", "pos")
        cell = F.floor(F.col("pos") / span)
        want = at.select(*DOC, "item_id", "pos", F.size("rest").alias("n"), F.explode("rest").alias("term"), cell.alias("cell"))
        want = want.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
        a, b = want.alias("a"), self.lists.withColumn("cell", cell).alias("b")
        met = a.join(b, same_doc("a", "b") & (F.col("a.term") == F.col("b.term")) & (F.col("a.cell") == F.col("b.cell")) & (F.abs(F.col("a.pos") - F.col("b.pos")) <= span))
        met = met.select("a.__vt_id", "a.__vt_text_hash", "item_id", "a.pos", "n", "a.term").groupBy(*DOC, "item_id", "pos", "n").agg(F.count_distinct("term").alias("have"))
        return alone.unionByName(met.where("have = n").select(*DOC, "item_id", "pos"))


def looked_up(docs: DataFrame, index: Index) -> DataFrame:
    """Row keys of the documents that hold windows, and __vt_spots: places whose words equal those of a window, as (start, end, items), ordered."""
    found = materialize(index.candidates(), "window-candidates")
    named = index.windows.select("wid", "phrase", "items")
    if named.count() <= BROADCAST_ROWS:
        full = found.join(F.broadcast(named), "wid")
    else:
        spread = F.pmod(F.xxhash64(*DOC), F.lit(SHARDS)).cast("int")
        full = found.withColumn("shard", spread).join(named.withColumn("shard", F.explode(F.array(*[F.lit(i) for i in range(SHARDS)]))), ["wid", "shard"])
    by_doc = materialize(full.groupBy(*DOC).agg(F.collect_list(F.struct("start", "phrase", "items")).alias("parts")), "candidates-by-document")
    discard(found)
    # Texts are shuffled only of documents that have candidates, as long as their keys can be broadcast.
    keyed = row_key(docs)
    a, b = keyed.alias("a"), small(by_doc.select(*DOC)).alias("b")
    asked = a.join(b, same_doc("a", "b"), "left_semi").withColumn("__vt_words", words_of(F.col("text")))
    words = F.col("__vt_words")
    equal = F.filter("b.parts", lambda p: F.slice(words, p["start"] + 1, F.size(p["phrase"])) == p["phrase"])
    spots = F.sort_array(F.transform(equal, lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.size(p["phrase"])).alias("end"), p["items"].alias("items"))))
    a, b = asked.alias("a"), by_doc.alias("b")
    return a.join(b, same_doc("a", "b")).select("a.__vt_id", "a.__vt_text_hash", spots.alias("__vt_spots")).where(F.size("__vt_spots") > 0).dropDuplicates(DOC)


def phrase_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """(document, start, length, items): every place where a window of the benchmark stands, once for each window."""
    found = looked_up(docs.select("doc_id", "text"), Index(docs, benchmark, width))
    return found.select(*DOC, F.explode("__vt_spots").alias("s")).select(*DOC, "s.start", (F.col("s.end") - F.col("s.start")).alias("length"), "s.items")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, terms: int = NEAR_TERMS, span: int = NEAR_SPAN) -> DataFrame:
    """(document, item_id, pos): see Index.near."""
    return Index(docs, benchmark, near_terms=terms).near(span)


def covered(spots: Column) -> Column:
    """Words inside any of the spots, which are ordered by start."""

    def add(state: Column, s: Column) -> Column:
        new = F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], state["upto"]))
        return F.struct((state["n"] + new).alias("n"), F.greatest(state["upto"], s["end"]).alias("upto"))

    return F.aggregate(spots, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), add, lambda state: state["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, with_near: bool = False) -> DataFrame:
    """One row per document: words, words inside any occurring window, items, and the verdict; with_near adds n_near, the items with proximity matches."""
    index = Index(docs, benchmark, width)
    found = looked_up(docs.select("doc_id", "text"), index)
    items = F.sort_array(F.array_distinct(F.flatten(F.transform("__vt_spots", lambda s: s["items"].cast("array<string>")))))
    hit = materialize(found.select(*DOC, covered(F.col("__vt_spots")).cast("long").alias("n_hit"), items.alias("items")), "hit-documents")
    base = row_key(docs.select("doc_id", "text")).select("doc_id", *DOC, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    a, b = base.alias("a"), small(hit).alias("b")
    none = F.array().cast("array<string>")
    out = a.join(b, same_doc("a", "b"), "left").select("a.*", F.coalesce("b.n_hit", F.lit(0)).alias("n_hit"), F.coalesce("b.items", none).alias("items"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words")))
    if not with_near:
        index.close()
        return out
    near = materialize(index.near().select(*DOC, "item_id").distinct().groupBy(*DOC).agg(F.count("*").alias("n_near")), "near-items")
    index.close()
    a, b = out.alias("a"), small(near).alias("b")
    return a.join(b, same_doc("a", "b"), "left").select("a.*", F.coalesce("b.n_near", F.lit(0)).alias("n_near"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark, and the number of items whose rarest terms stand near each other in it."""
    out = contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", "text"), with_near=True)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    bad = contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text")).where("contaminated").select(*DOC)
    keyed = row_key(docs)
    return keyed.join(bad, same_row(keyed, bad), "left_anti").select(*docs.columns)


# Item ids sort as strings; a document word is hit if any window that stands in the document covers it.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM wins),
spot AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, spot.k AS k, item_id FROM spot JOIN wins ON spot.p = wins.p AND spot.k = wins.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d WHERE len(w) > 0),
bt AS (SELECT DISTINCT item_id, unnest(w) AS term FROM b WHERE item_id IS NOT NULL),
cnt AS (SELECT term, count(*) AS n FROM tok WHERE term IN (SELECT term FROM bt) GROUP BY term),
need AS (SELECT item_id, term, r, count(*) OVER (PARTITION BY item_id) AS size FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n, term) AS r FROM bt JOIN cnt USING (term)) WHERE r <= 3),
t0 AS (SELECT doc_id, item_id, size, pos FROM need JOIN tok USING (term) WHERE r = 1),
t1 AS (SELECT t0.doc_id, t0.item_id, t0.pos, t0.size, count(DISTINCT need.term) AS have FROM t0 JOIN need ON need.item_id = t0.item_id AND need.r > 1 JOIN tok ON tok.doc_id = t0.doc_id AND tok.term = need.term AND abs(tok.pos - t0.pos) <= 20 GROUP BY ALL),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT doc_id, item_id FROM t1 WHERE have = size - 1 UNION ALL SELECT doc_id, item_id FROM t0 WHERE size = 1) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
