"""Toxicity by a weighted lexicon.

Texts are folded first: case, look-alike letters of other scripts and full-width forms, and digits
and signs that stand for letters inside words. One Aho-Corasick pass over the folded text finds the
entries of the lexicon, whole words or word beginnings, and the exception phrases that excuse what
they cover. The weights of the entries found add up, the sum is set against the length of the text,
and a logistic curve turns both into a score.

Lexicon and curve are learned from labelled rows, those whose crc32(doc_id as text) mod 5 is not 0:
document counts of words and word beginnings per label are taken by Spark on a sample bounded by
max_training_rows, the significant ones are candidates, and a greedy cover takes one by one the entry
that explains most toxic texts not explained yet, so words that merely come along are left out.

Cases: a null or empty text has no words and gets the score of a text without findings; a text is
scanned whole; repeated rows are scored each for itself; without labels (or toxic ones) the lexicon
is SEED_WORDS alone; labels that are null are no training rows; other columns are kept.
Seed words stay in the lexicon unless clean texts hold them as often as toxic ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespertide.llm.common import materialize, read_table, whole_text

MAX_TRAINING_ROWS = 10_000
COUNT_ROWS = 200
STEMS = range(4, 10)
LEAST_TEXTS = 3
#: Least share of the toxic training texts that an entry must explain when it is taken.
LEAST_SHARE = 0.02
LEAST_WEIGHT = 2.0
LEAST_Z = 4.0
FOLDS = 5
REJECT_AT = 0.5
#: Least weight of the sum for length, so that length always counts.
LEAST_BY_SHARE = 0.1

# Insults of everyday English, used as they are where nothing can be learned.
SEED_WORDS = ["idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "filth", "vermin"]
SEED_WEIGHT = 4.0
# Phrases in which such words insult nobody.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "trash collection", "empty the trash", "trash folder", "clown fish", "clown car", "class clown", "clown nose", "stupid simple", "keep it simple stupid", "loser bracket", "sore loser", "pond scum", "soap scum", "bastard sword", "bastard file"]
# Letters of other scripts that look like Latin ones, then digits and signs that stand for letters.
LOOK_ALIKES = dict(zip("асеорхуіјѕԁһӏкмтвнгԛԝαεοικνρτυχβηγ", "aceopxyijsdhlkmtbhrqwaeoikvptuxbny"))
IN_WORD_SIGNS = dict(zip("0134578@$!|€", "oieastbasile"))

FOLD_TABLE = {ord(k): v for k, v in LOOK_ALIKES.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
SIGN_TABLE = {ord(k): v for k, v in IN_WORD_SIGNS.items()}
HAS_SIGN = re.compile(r"[0134578@$!|€](?=[^\W\d_])")
#: Signs and one or two digits at the end of a word, as in "a$$" or "scum5"; an exclamation mark there is punctuation.
ENDING_SIGN = re.compile(r"(?<=[^\W\d_])(?:[$@€]+|[0134578]{1,2})(?![\w$@€])")
SIGNED_WORD = re.compile(r"[\w@$!|€]*[0134578@$!|€](?=[^\W\d_])[\w@$!|€]*?(?=[@$!|€]*(?:[^\w@$!|€]|$))")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Folded text of the same words. Digits and signs are read as letters only inside words and at their ends."""
    text = text.lower().translate(FOLD_TABLE)
    if HAS_SIGN.search(text):
        text = SIGNED_WORD.sub(lambda m: m.group().translate(SIGN_TABLE) if any(c.isalpha() for c in m.group()) else m.group(), text)
    return ENDING_SIGN.sub(lambda m: m.group().translate(SIGN_TABLE), text)


@dataclass
class Lexicon:
    """Entries with weights; those that end in * are word beginnings. The curve: bias, by sum, by sum for length."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    curve: tuple[float, float, float] = (-3.0, 1.5, 0.5)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for entry, weight in sorted(self.entries.items(), key=lambda e: not e[0].endswith("*")):
            word = entry.rstrip("*")
            if self.entries.get(f"{word}*", 0.0) >= weight and not entry.endswith("*"):
                continue
            a.add_word(word, (len(word), weight, entry.endswith("*"), False))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), 0.0, False, True))
        if len(a):
            a.make_automaton()
        return a


def findings(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight), one for each word start: the heaviest entry there that no exception phrase covers."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    size = len(folded)
    for last, (n, weight, beginning, exception) in automaton.iter(folded):
        start, end = last - n + 1, last + 1
        if start and folded[start - 1].isalnum() or not beginning and end < size and folded[end].isalnum():
            continue
        if exception:
            excused.append((start, end))
        elif start not in best or weight > best[start][1]:
            best[start] = (end, weight)
    return [(s, e, w) for s, (e, w) in sorted(best.items()) if not any(a <= s and e <= b for a, b in excused)]


def features(text: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """Sum of weights, and the same per hundred words, both on a log scale."""
    total = sum(w for _, _, w in findings(fold(text), automaton))
    if not total:
        return 0.0, 0.0
    return math.log1p(total), math.log1p(100 * total / max(1, len(text.split())))


@lru_cache(maxsize=4)
def _automaton(entries: tuple, exceptions: tuple) -> ahocorasick.Automaton:
    return Lexicon(dict(entries), list(exceptions)).automaton()


def with_score(df: DataFrame, lexicon: Lexicon, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """df with the score of each whole text, 0 to 1."""
    entries, exceptions, (bias, by_sum, by_share) = tuple(lexicon.entries.items()), tuple(lexicon.exceptions), lexicon.curve

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(entries, exceptions)
        for texts in batches:
            x = np.array([features(t, automaton) for t in texts], np.float64).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-(bias + x @ np.array([by_sum, by_share])))))

    return df.withColumn(into, scored(whole_text(F.col(text_col))))


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_training_rows: int) -> DataFrame:
    """text and toxic (0 or 1) of a sample of the training rows, evenly by a hash of the id and bounded."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    usable = usable.where(~held_out())
    n = usable.count()
    steps = 1 << 20
    keep = usable if n <= max_training_rows else usable.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(steps)) < int(steps * max_training_rows / n))
    # About max_training_rows ids at most, so they can be broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(keep), "doc_id").select(whole_text(F.col("text")).alias("text"), "toxic")


def terms_of(text: str) -> set[str]:
    """Words of three or more characters, and their beginnings."""
    words = {w for w in WORD.findall(fold(text)) if len(w) > 2}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def counted_terms(texts: DataFrame, only: frozenset | None = None) -> DataFrame:
    """(term, n): texts that hold a term, of those in `only`. Counts are summed over COUNT_ROWS texts at a time, so memory stays bounded."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), COUNT_ROWS):
                held: Counter = Counter()
                for text in batch["text"].iloc[first : first + COUNT_ROWS]:
                    held.update(terms_of(text) if only is None else terms_of(text) & only)
                yield pd.DataFrame({"term": list(held), "n": list(held.values())}).astype({"term": object, "n": "int64"})

    return texts.select("text").mapInPandas(rows, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> Lexicon:
    """Lexicon and curve from labelled documents."""
    sample = training_rows(docs, labels, max_training_rows)

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon(dict.fromkeys(SEED_WORDS, SEED_WEIGHT))
    # Only terms that toxic texts hold are counted in clean ones.
    in_toxic = materialize(counted_terms(sample.where("toxic = 1")).where((F.col("n") >= LEAST_TEXTS) | F.col("term").isin(SEED_WORDS)), "toxic-terms")
    names = frozenset(r["term"] for r in in_toxic.select("term").collect()) | frozenset(SEED_WORDS)
    in_clean = counted_terms(sample.where("toxic <> 1"), names)
    zero = lambda side: F.coalesce(f"{side}.n", F.lit(0))
    counted = in_toxic.alias("a").join(in_clean.alias("b"), "term", "full").select("term", zero("a").alias("t"), zero("b").alias("c"))
    counted = materialize(counted, "term-counts")
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    z = weight / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    ranked = counted.where(F.col("t") >= LEAST_TEXTS).select("term", "t", "c", weight.alias("w"), z.alias("z")).where((F.col("w") >= LEAST_WEIGHT) & (F.col("z") >= LEAST_Z))
    seeds = {r["term"]: r for r in counted.where(F.col("term").isin(SEED_WORDS)).select("term", weight.alias("w")).collect()}
    entries = {w: max(SEED_WEIGHT, seeds[w]["w"]) if w in seeds else SEED_WEIGHT for w in SEED_WORDS if w not in seeds or seeds[w]["w"] > 0}
    # Significant terms of a bounded sample; the cover takes at most 1 / LEAST_SHARE of them.
    rows = ranked.orderBy(F.desc("z"), F.desc(F.length("term")), "term").collect()
    entries |= covering_entries(sample, rows, math.ceil(max(LEAST_TEXTS, LEAST_SHARE * toxic)))
    lexicon = Lexicon(entries)
    lexicon.curve = fit_curve(sample, lexicon)
    return lexicon


def covering_entries(sample: DataFrame, rows: list, least: int) -> dict[str, float]:
    """Entries of a greedy cover of the toxic texts of the sample; rows are the candidates with their counts."""
    if not rows:
        return {}
    names = [r["term"] for r in rows]
    number = {n: i for i, n in enumerate(names)}

    @F.pandas_udf("array<int>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted(number[t] for t in terms_of(x) if t in number) for x in texts])

    texts = sample.where("toxic = 1").select(held("text").alias("held")).where(F.size("held") > 0).collect()
    return {names[i]: float(rows[i]["w"]) for i in cover([set(r["held"]) for r in texts], rows, least)}


def cover(texts: list[set[int]], rows: list, least: int) -> list[int]:
    """Candidates one by one: each time the one with the best evidence in texts that hold none of the ones taken."""
    taken: list[int] = []
    where: dict[int, set[int]] = {}
    for k, held in enumerate(texts):
        for i in held:
            where.setdefault(i, set()).add(k)
    left = {i: len(x) for i, x in where.items()}
    while left:
        # Among equals the longer and more exact entry, so that word beginnings are taken only where they explain more.
        i = max(left, key=lambda i: (left[i] - 3 * rows[i]["c"], len(rows[i]["term"].rstrip("*")), not rows[i]["term"].endswith("*"), -i))
        if left[i] < least or left[i] <= 2 * rows[i]["c"]:
            del left[i]
            continue
        taken.append(i)
        gone = {k for k in where[i] if texts[k]}
        for k in gone:
            for j in texts[k]:
                if j in left:
                    left[j] -= 1
            texts[k] = set()
        left.pop(i, None)
    return taken


def fit_curve(sample: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression of the label on the two features, on the bounded sample, with a small ridge."""
    entries, exceptions = tuple(lexicon.entries.items()), tuple(lexicon.exceptions)

    @F.pandas_udf("a double, b double")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(entries, exceptions)
        for texts in batches:
            yield pd.DataFrame([features(t, automaton) for t in texts], columns=["a", "b"], dtype=np.float64)

    # Features are rounded and counted, so equal texts are one row.
    rows = sample.select("toxic", both("text").alias("f")).groupBy("toxic", F.round("f.a", 2).alias("a"), F.round("f.b", 2).alias("b")).agg(F.count("*").alias("n")).collect()
    x = np.array([[1.0, r["a"], r["b"]] for r in rows])
    y, n = np.array([float(r["toxic"]) for r in rows]), np.array([float(r["n"]) for r in rows])
    beta, ridge = np.zeros(3), np.diag([1e-3, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    # Both features count: a document of the same words that is longer never scores higher.
    return float(beta[0]), max(0.0, float(beta[1])), max(LEAST_BY_SHARE, float(beta[2]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = with_score(docs, lexicon, into="score")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, reject_at: float = REJECT_AT) -> DataFrame:
    """docs without those that score reject_at or more."""
    return with_score(docs, lexicon, into="__vt_score").where(F.col("__vt_score") < reject_at).select(*docs.columns)
