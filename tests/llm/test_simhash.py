import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vespertide.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, budget=4):
    names = {p: p for p in prints}

    def top(p):
        while names[p] != p:
            p = names[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if bin(p ^ q).count("1") <= budget:
                names[max(top(p), top(q))] = min(top(p), top(q))
    return {p: top(p) for p in prints}


def test_fingerprint_matches_plain_form():
    for text in ["", " \n", "one", "One two THREE", "a b c d", "É x ß Q w e r t y " * 40, "A\x0bb\x0cc\rd e f g"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_walk_finds_every_pair(monkeypatch):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(40)} | {rng.getrandbits(64) for _ in range(100)})
    bits = np.array(prints, np.uint64)
    expected = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= 4}
    for frontier in (1 << 20, 16):
        monkeypatch.setattr(simhash, "FRONTIER", frontier)
        found = [(int(a), int(b)) for x, y in simhash.walk_trie(np.zeros(len(bits), np.int64), bits) for a, b in zip(x, y)]
        assert len(found) == len(set(found)) and set(found) == expected


def test_components_match_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = ["", None, "  ", "lone words here"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "bits")
    prints = [simhash.fingerprint(t or "") for _, t in rows]
    tops = plain_components(sorted(set(prints)))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[tops[p]] = min(i, least.get(tops[p], i))
    for limit in (1024, 8):
        monkeypatch.setattr(simhash, "ROOT_ROWS", limit)
        got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), f"{r['bits'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.near_duplicates(docs).collect())
        assert got == sorted(((i if i is not None else -1), f"{p:016x}", least[tops[p]]) for (i, _), p in zip(rows, prints))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, bits string, root int")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).columns == ["doc_id", "text", "bits", "root"]


def plain_kept(rows, similarity=0.8):
    """Smallest id of each group of texts joined by links of five-word similarity within the search budget."""
    prints = [simhash.fingerprint(t or "", simhash.SEARCH_WORDS) for _, t in rows]
    sets = []
    for _, t in rows:
        words = (t or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])
            if alike and bin(prints[i] ^ prints[j]).count("1") <= simhash.SEARCH_BUDGET and top[i] != top[j]:
                low, high = sorted((top[i], top[j]))
                top = [low if x == high else x for x in top]
    return sorted({min(rows[k][0] for k in range(len(rows)) if top[k] == x) for x in set(top)})


def edited(rng, base, n, words):
    copy = list(base)
    for _ in range(n):
        copy[rng.randrange(len(copy))] = rng.choice(words)
    return " ".join(copy)


def test_keep_one_matches_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = ["", None, "  ", "lone words here", "Lone  WORDS here", "lone words"]
    for _ in range(20):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        texts += [edited(rng, base, rng.randint(0, 12), words) for _ in range(rng.randint(1, 8))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows + [rows[9]], "doc_id long, text string").withColumn("bits", F.lit(1)).withColumn("root", F.lit("x"))
    for mean in (512, 1):
        # Few rows a root ask for more blocks that agree.
        monkeypatch.setattr(simhash, "MEAN_ROOT_ROWS", mean)
        kept = simhash.keep_one(docs)
        assert kept.columns == ["doc_id", "text", "bits", "root"]
        assert sorted(r["doc_id"] for r in kept.collect()) == plain_kept(rows)
    # Near copies of far less than the least similarity all stay.
    far = [(i, edited(rng, base, len(base) // 3, words)) for i in range(10)]
    assert simhash.keep_one(spark.createDataFrame(far, "doc_id long, text string")).count() == 10


def test_large_groups_lose_no_link(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    base, other, walk = ([rng.choice(words) for _ in range(200)] for _ in range(3))
    texts = [" ".join(other), " ".join(base)] + [edited(rng, base, 3, words) for _ in range(60)]
    # A chain: neighbours are alike, its ends are not; copies of the base far from each other, and some of too little similarity.
    for _ in range(60):
        walk = edited(rng, walk, 2, words).split()
        texts.append(" ".join(walk))
    texts += [edited(rng, base, n, words) for n in (6, 8, 10, 12, 14, 16, 20) for _ in range(6)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = plain_kept(rows)
    assert 3 < len(kept) < len(rows) // 2
    for most, shingles, centres in ((8, 3_000, 256), (16, 2_000_000, 1)):
        monkeypatch.setattr(simhash, "GROUP_TEXTS", most)
        monkeypatch.setattr(simhash, "GROUP_SHINGLES", shingles)
        monkeypatch.setattr(simhash, "MOST_CENTRES", centres)
        assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == kept
