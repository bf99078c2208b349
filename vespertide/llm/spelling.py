"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so the order of letters doesn't count and taking
a letter away takes its value away. Words one addition or removal apart are those where one key less a
letter's value is the other key; words one exchange apart are those where both keys less a letter's value
agree (their keys differ by the exchange value of the two letters). Both are equi-joins, and what meets is
verified letter by letter.

Keys where more than GROUP_WORDS words meet (words of the same letters in many orders) carry the order of
letters in the join key: the rest of the word without the letter at each of its places. Then only real
variants meet, so no group's pairs are all formed.

Cases: null and empty texts have no words; a null id counts as empty in the hash; repeated rows count each
for itself; words of any length are compared whole; other columns of the table play no part. Ties between
the largest near words go to the smallest word in code-point order. No words give no rows.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vespertide.llm.common import ascii_lower, discard, hot_join, materialize, read_table, whole_text, with_size

RUN = r"[A-Za-zÀ-ÿ]+"
#: The power, and the prime that sums are taken by so that words of any length have a key.
POWER, MODULUS = 5, (1 << 61) - 1
GROUP_WORDS = 64
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
DAMAGE_EVERY = 199


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    value = code
    for _ in range(POWER - 1):
        value = value * code
    return value


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda key, c: (key + letter_value(c)) % MODULUS)


def damaged(run: Column, doc_id: Column, every: int) -> Column:
    """The run, less one letter for each so-manieth hash of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = DAMAGE_EVERY, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of words that are long and frequent enough. every: see damaged(); None leaves runs as they are."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(whole_text(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("run"))
    lower = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    words = lower.select((damaged(F.col("run"), F.col("id"), every) if every else F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def rests(word: Column, letter: Column) -> Column:
    """(place, rest) for each place of the letter: hash of the word without what stands there."""
    places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(word, i, F.lit(1)) == letter)
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)).alias("rest")))


def whole_rest(word: Column, at: Column) -> Column:
    """The hash that rests() has for a longer word which is this one but for a letter behind `at` letters."""
    return F.xxhash64(F.substr(word, F.lit(1), at), F.substr(word, at + 1))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): both ways round, every pair one letter added, removed or exchanged apart, once. words: (word, n), each once."""
    keyed = materialize(words.select("word", "n", anagram_key(F.col("word")).alias("own")), "word-keys")
    letters = F.array_distinct(F.split(F.col("word"), ""))
    less = keyed.select("word", "n", "own", F.explode(letters).alias("letter")).withColumn("key", F.pmod(F.col("own") - letter_value(F.col("letter")), F.lit(MODULUS)))
    every = less.unionByName(keyed.withColumns({"letter": F.lit(None).cast("string"), "key": F.col("own")}))
    # Whole words have no letter, words less a letter have one.
    sized = materialize(with_size(every, "key", GROUP_WORDS).withColumn("crowded", F.col("__vt_n").isNotNull()).drop("__vt_n"), "word-removals")
    loose, crowded = sized.where("NOT crowded"), sized.where("crowded")

    def sides(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        names = {"word": "other", "n": "other_n", "own": "other_own"}
        return rows.select("key", "word", "n", "own", *more), rows.select("key", *[F.col(a).alias(b) for a, b in names.items()], *more)

    removed, whole = sides(loose.where("letter IS NOT NULL"))[0], sides(loose.where("letter IS NULL"))[1]
    added = removed.join(whole, "key")
    a, b = sides(loose.where("letter IS NOT NULL"))
    exchanged = a.join(b, "key").where((F.col("word") < F.col("other")) & (F.col("own") != F.col("other_own")))
    placed = crowded.where("letter IS NOT NULL").select("key", "word", "n", "own", F.explode(rests(F.col("word"), F.col("letter"))).alias("r")).select("*", "r.place", "r.rest").drop("r")
    short = crowded.where("letter IS NULL").withColumn("place", F.explode(F.sequence(F.lit(1), F.length("word") + 1)))
    short = sides(short.withColumn("rest", whole_rest(F.col("word"), F.col("place") - 1)), "place", "rest")[1]
    # A letter of a run can be taken from any place of it: the pair comes once for each, so it is made distinct below.
    added_there = placed.join(short, ["key", "place", "rest"])
    c, d = sides(placed, "place", "rest")
    exchanged_there = c.join(d, ["key", "place", "rest"]).where((F.col("word") < F.col("other")) & (F.col("own") != F.col("other_own")))
    pair = ["word", "n", "other", "other_n"]
    there = added_there.select(*pair).distinct().unionByName(exchanged_there.select(*pair))
    found = added.select(*pair).unionByName(exchanged.select(*pair)).unionByName(there)
    verified = found.where(F.levenshtein("word", "other", 1) == 1)
    return verified.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *[F.when(F.col("way") == 0, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("word", "other"), ("n", "other_n"), ("other", "word"), ("other_n", "n"))]
    )


def roots_of(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """(word, root): where chains of forms end. forms: (word, form), form never null; most: the largest count.

    Counts grow by the ratio along a chain, so its length is bounded, and each round doubles what is followed.
    """
    out = materialize(forms.select("word", F.col("form").alias("root")), "word-roots")
    followed, longest = 1, int(log(max(most, 1), ratio)) + 1
    while followed < longest:
        further = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialize(hot_join(out, further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "word-roots")
        discard(out)
        out, followed = jumped, followed * 2
    return out


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; words: (word, n), each once.

    form: the near word of the largest n, if that is at least `ratio` times the word's; root: where forms lead.
    """
    words = materialize(words, "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    judged = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    judged = judged.withColumn("form", F.when(F.col("form_n") >= ratio * F.col("n"), F.col("best.form")))
    judged = materialize(judged.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n")), "word-forms")
    most = words.agg(F.max("n")).first()[0] or 0
    roots = roots_of(judged.where("form IS NOT NULL").select("word", "form"), most, ratio)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of the words of documents."""
    return variant_groups(words_of(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


#: SQL has no crc32, so it is taken byte by byte through the table of the reflected polynomial, which a rule makes.
OP11_SQL = f"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, {0xEDB88320}) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run),
bytes AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend({0xFFFFFFFF}::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), {0xFFFFFFFF}::BIGINT) AS h
  FROM bytes, crc),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {DAMAGE_EVERY} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
less AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS p)),
added AS (SELECT DISTINCT l.word AS a, l.n AS an, w.word AS b, w.n AS bn FROM less l JOIN words w ON l.rest = w.word),
near AS (
  SELECT a AS word, b AS other, bn AS other_n FROM added UNION ALL SELECT b, a, an FROM added
  UNION ALL SELECT x.word, y.word, y.n FROM less x JOIN less y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form, CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain(word, reached, k) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(reached, k) AS root FROM chain GROUP BY word) r USING (word)
"""
