"""Secret scan: fixed patterns, and a battery of randomness tests for strings without a telling name.

A candidate is a run of 20 or more characters of the base64 alphabets. The narrowest encoding that
holds all its characters is inferred (hex, base32, alphanumeric, base64). Three tests are made
against that encoding: chi-squared uniformity over classes of its alphabet, Wald-Wolfowitz runs
about the middle of the alphabet, and serial correlation of neighbouring symbols. The two-sided
p-values combine by Fisher's method into one p-value of "as uniform as a random key".

A finding is a candidate that looks random while ordinary strings do not, so the null is an ordinary
string: its chance of looking this random is measured over the distinct candidates of the corpus that
are words (letters only, cased as in prose), per encoding and length class. Where a class has few words
the measure leans on the words of all classes, and those on a stated chance (PRIOR_TAIL), each with the
weight of PRIOR_WEIGHT strings; so one rule holds at every size. Benjamini-Hochberg at level `fdr` then
gives each class its threshold: short strings, whose tests are weak, must look more random than long
ones. A string counts once however often it is copied. Counts come from a histogram of fixed size.

A run that mixes the two base64 alphabets is of no single encoding and is tested part by part.

Cases: a null text counts as empty; texts are scanned whole; repeated rows are scanned each for
itself; an empty table gives an empty result. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespertide.llm.common import materialize, read_table, whole_text

# The patterns of the base kinds, with the least length of what they must hold.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
# The alphabets of encodings, from narrow to wide, each in its own order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
LENGTH_CLASSES = [20, 24, 32, 40, 64, 128]
SCORE_BINS = 400
FDR = 0.01
#: A candidate whose combined p-value is below this isn't random whatever the others look like.
LEAST_SCORE = 0.02
#: Chance of an ordinary string to score LEAST_SCORE, before any is seen (falling as 1 / score beyond), and how many seen ones weigh as much.
PRIOR_TAIL = 0.005
PRIOR_WEIGHT = 100
#: Parts of a run that is of no single encoding.
PARTS = r"[A-Za-z0-9+/]{20,}|[A-Za-z0-9_-]{20,}"
ROWS = "doc_id long, base array<struct<kind: string, start: int, end: int>>, tested array<struct<start: int, end: int, encoding: string, length_class: int, score: double, word: boolean, name: long>>"


def base_spans(text: str, patterns: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by start, then kind as listed."""
    out = [("assign", m.start(), m.end()) for m in patterns["assign"].finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [("access", m.start(), m.end()) for m in patterns["access"].finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # Runs are whole and disjoint, so asking for the least length at once finds the same ones.
    out += [("hex", m.start(), m.end()) for m in patterns["hex"].finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    if k <= 0 or x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def fisher(p: list[float]) -> float:
    """Combined p-value: upper tail of chi-squared with twice as many degrees, which has a closed form."""
    half = -sum(math.log(max(x, 1e-300)) for x in p)
    term = total = 1.0
    for i in range(1, len(p)):
        term *= half / i
        total += term
    return min(1.0, math.exp(-half) * total)


def inferred(body: str) -> str | None:
    used = set(body)
    return next((name for name, letters in ALPHABETS.items() if used <= set(letters)), None)


def battery(body: str, encoding: str) -> float:
    """p-value that body is drawn uniformly from the alphabet of its encoding."""
    letters = ALPHABETS[encoding]
    x = np.array([letters.index(c) for c in body], np.float64)
    n, m = len(x), len(letters)
    # Classes wide enough to expect 5 symbols each; upper case, lower case and digits stay apart in wide alphabets.
    classes = max(2, min(m, n // 5))
    counts = np.bincount((x * classes // m).astype(int), minlength=classes)
    widths = np.bincount((np.arange(m) * classes // m).astype(int), minlength=classes) * n / m
    uniform = chi_tail(float(((counts - widths) ** 2 / widths).sum()), classes - 1)
    high = x >= m / 2
    ups, downs = int(high.sum()), int(n - high.sum())
    if ups and downs:
        mean = 1 + 2 * ups * downs / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    c = x - x.mean()
    spread = float((c * c).sum())
    serial = normal_tail((float((c[1:] * c[:-1]).sum()) / spread + 1 / n) * math.sqrt(n)) if spread > 0 else 0.0
    # Few different symbols: how likely n draws show so few.
    seen = len(set(body))
    expect = m * (1 - (1 - 1 / m) ** n)
    var = m * (1 - 1 / m) ** n + m * (m - 1) * (1 - 2 / m) ** n - m * m * (1 - 1 / m) ** (2 * n)
    variety = 0.5 * math.erfc((expect - seen) / math.sqrt(2 * max(var, 1e-9))) if seen < expect else 1.0
    return fisher([uniform, runs, serial, max(variety, 1e-300)])


def looks_like_words(body: str) -> bool:
    """Letters, hyphens and underscores only, in lower case after the first of each part: what prose and names are made of."""
    return re.fullmatch(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/+](?:[A-Z]?[a-z]+|[A-Z]+))*", body) is not None


def tested_candidates(text: str, pattern: re.Pattern) -> list[dict]:
    out = []
    for m in pattern.finditer(text):
        body = m.group().rstrip("=")
        parts = [(m.start(), m.end(), body)]
        if inferred(body) is None:
            parts = [(m.start() + p.start(), m.start() + p.end(), p.group()) for p in re.finditer(PARTS, body)]
        for start, end, part in parts:
            encoding = inferred(part)
            name = xxhash.xxh64_intdigest(part.encode()) - (1 << 63)
            length = max(c for c in LENGTH_CLASSES if c <= max(len(part), LENGTH_CLASSES[0]))
            out.append({"start": start, "end": end, "encoding": encoding, "length_class": length, "score": battery(part, encoding), "word": looks_like_words(part), "name": name})
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base spans and every candidate with its tests."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = {"assign": re.compile(ASSIGN), "access": re.compile(ACCESS), "hex": re.compile(HEX[:-1] + "{%d,}" % LEAST["hex"])}
        candidate = re.compile(CANDIDATE)
        for batch in batches:
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "base": [[{"kind": k, "start": a, "end": b} for k, a, b in base_spans(t, patterns)] for t in batch["text"]],
                    "tested": [tested_candidates(t, candidate) for t in batch["text"]],
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text")).mapInPandas(rows, ROWS)


def least_scores(counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], fdr: float = FDR) -> dict[tuple[str, int], float]:
    """Least score that counts as a finding, per class, from histograms of the distinct words and of the other strings."""
    score = np.arange(SCORE_BINS) / SCORE_BINS
    above = lambda h: np.cumsum(h[::-1])[::-1]
    stated = PRIOR_TAIL * LEAST_SCORE / np.maximum(score, LEAST_SCORE)
    pool = sum((words for words, _ in counts.values()), np.zeros(SCORE_BINS))
    pooled = (above(pool) + PRIOR_WEIGHT * stated) / (pool.sum() + PRIOR_WEIGHT)
    found = {}
    for key, (words, others) in counts.items():
        null = (above(words) + PRIOR_WEIGHT * pooled) / (words.sum() + PRIOR_WEIGHT)
        enough = (score >= LEAST_SCORE) & (above(others) > 0) & (null * others.sum() <= fdr * above(others))
        if enough.any():
            found[key] = float(score[np.flatnonzero(enough)[0]])
    return found


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[tuple[str, int], float]:
    """least_scores over the distinct strings of the whole corpus."""
    each = scanned.select(F.explode("tested").alias("t")).select("t.encoding", "t.length_class", "t.word", "t.name", F.least(F.floor(F.col("t.score") * SCORE_BINS), F.lit(SCORE_BINS - 1)).cast("int").alias("bin"))
    # At most encodings x length classes x 2 x SCORE_BINS rows.
    bins = each.distinct().groupBy("encoding", "length_class", "word", "bin").agg(F.count("*").alias("n")).collect()
    counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for b in bins:
        pair = counts.setdefault((b["encoding"], b["length_class"]), (np.zeros(SCORE_BINS), np.zeros(SCORE_BINS)))
        pair[0 if b["word"] else 1][b["bin"]] += b["n"]
    return least_scores(counts, fdr)


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, base and found: all spans, by start, then kind as listed."""
    scanned = materialize(scan(docs), "secret-candidates")
    least = thresholds(scanned, fdr)
    keep = F.lit(False)

    def passes(t):
        hit = F.lit(False)
        for (encoding, length), score in sorted(least.items()):
            hit = hit | ((t["encoding"] == encoding) & (t["length_class"] == length) & (t["score"] >= score))
        return hit & ~t["word"]

    inside = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    random = F.transform(F.filter("tested", lambda t: passes(t) & ~inside(t)), lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((rank(a) - rank(b)).cast("int"))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", random), order).alias("found"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, their digest, and all spans."""
    out = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))
