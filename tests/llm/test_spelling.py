import random
import re
import zlib
from collections import Counter
from itertools import combinations

from tests.llm.cases import odd_documents, write_tables
from vespertide.llm import spelling
from vespertide.llm.spelling import near_words, op11_spelling, roots_of, variant_groups, words_of


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def wanted(counts):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def random_words(rng, letters, sizes, how_many):
    return {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))): rng.choice([5, 7, 25, 26, 125, 700, 4000]) for _ in range(how_many)}


def test_random_words_equal_brute_force(spark):
    rng = random.Random(3)
    for letters in ("ab", "abcé", "abcdefÿß"):
        counts = random_words(rng, letters, [3, 4, 5, 6], 250)
        assert got(variant_groups(table(spark, counts))) == wanted(counts)


def test_crowded_keys_equal_brute_force(spark, monkeypatch):
    """Many orders of the same letters: beyond GROUP_WORDS only real variants meet."""
    rng = random.Random(4)
    base = "aabbcde"
    counts = {"".join(rng.sample(base, len(base))): rng.choice([5, 30, 200]) for _ in range(150)}
    counts |= {w[:i] + c + w[i + k :]: rng.choice([5, 6]) for w in list(counts)[:60] for i, c, k in [(rng.randrange(7), rng.choice("abx"), rng.choice([0, 1]))]}
    want = wanted(counts)
    for size in (1, 10, 10_000):
        monkeypatch.setattr(spelling, "GROUP_WORDS", size)
        assert got(variant_groups(table(spark, counts))) == want


def test_pairs_come_once(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP_WORDS", 1)
    pairs = near_words(table(spark, {"aaaaaa": 5, "aaaaaaa": 5, "aaaaab": 5, "aaabaa": 5})).select("word", "other").collect()
    assert len(pairs) == len(set(pairs)) == 2 * 3


def test_exchange_values_of_letters_differ():
    """No two pairs of letters have one exchange value, so a pair meets once; values are far below the modulus."""
    values = [ord(c) ** spelling.POWER for c in map(chr, [*range(97, 123), *range(0xC0, 0x100)])]
    seen = Counter(a - b for a in values for b in values if a != b)
    assert max(seen.values()) == 1 and max(values) * 1000 < spelling.MODULUS


def test_chains_are_followed_to_their_end(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(11)]
    roots = roots_of(spark.createDataFrame(forms, "word string, form string"), 5**12)
    assert {r["word"]: r["root"] for r in roots.collect()} == {w: "w11" for w, _ in forms}


def test_words_of_odd_documents_equal_brute_force(spark, tmp_path):
    docs = odd_documents(spark, ["Straße STRASSE Éclair éclair x×y÷z " * 9, "wordss words wor ds " * 40])
    counts = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert got(op11_spelling(spark, write_tables(tmp_path / "odd", documents=docs))) == wanted(counts)
    assert op11_spelling(spark, write_tables(tmp_path / "none", documents=docs.limit(0))).count() == 0


def test_damage_takes_one_letter(spark):
    docs = spark.createDataFrame([(i, "abcdef") for i in range(2000)], "doc_id long, text string")
    words = {r["word"]: r["n"] for r in words_of(docs, min_letters=1, min_count=1).collect()}
    damaged = [i for i in range(2000) if zlib.crc32(f"{i}:abcdef".encode()) % 199 == 0]
    assert words["abcdef"] == 2000 - len(damaged) and sum(words.values()) == 2000
    assert {len(w) for w in words} == {5, 6}
