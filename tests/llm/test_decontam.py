import random
import re

from tests.llm.cases import odd_documents, write_tables
from vespertide.llm import decontam
from vespertide.llm.decontam import contamination, drop_contaminated, op3_decontamination, phrase_matches, proximity_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, passage in items:
        v = words(passage)
        k = min(13, len(v))
        wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(20))
    more = [f"x {passage} y", " ".join(passage.split()[3:17]), "pre Ünï-Ñandú post", f"{passage} {passage}", "w0 " * 400 + passage, "a a a a a a a a a a a a a a a"]
    docs = odd_documents(spark, more)
    items = [(1, passage), (2, "ünï ñandú"), (3, ""), (4, None), (5, passage), (10, "a " * 14), (6, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in contamination(docs, bench).collect())
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, *brute(r["text"], items)) for r in docs.collect())
    assert got == want
    with monkeypatch.context() as m:
        # A benchmark too large to broadcast gives the same.
        m.setattr(decontam, "BROADCAST_ROWS", 0)
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in contamination(docs, bench).collect()) == want
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    empty = write_tables(tmp_path / "a", documents=docs, benchmark=bench.limit(0))
    assert op3_decontamination(spark, empty).where("n_hit > 0").count() == 0
    none = write_tables(tmp_path / "b", documents=docs.limit(0), benchmark=bench)
    assert op3_decontamination(spark, none).count() == 0


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "red fox jumps over the lazy dog"), (2, "dog the over lazy jumps fox red"), (3, "red " + "z " * 30 + "fox dog")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "fox jumps over")], "item_id long, text string")
    assert [(r["__vt_id"], r["start"], r["length"]) for r in phrase_matches(docs, bench).collect()] == [(1, 1, 3)]
    assert {r["__vt_id"] for r in proximity_matches(docs, bench).collect()} == {1, 2}


def plain_near(texts, items, terms=3, span=20):
    """doc -> items with proximity matches."""
    split = {d: words(t) for d, t in texts}
    counts = {}
    for w in split.values():
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    out = {d: set() for d in split}
    for item, passage in items:
        need = sorted((counts[x], x) for x in set(words(passage)) if x in counts)[:terms]
        for d, w in split.items():
            for i, x in enumerate(w):
                if need and x == need[0][1] and all(y in w[max(0, i - span) : i + span + 1] for _, y in need[1:]):
                    out[d].add(item)
    return out


def test_proximity_matches_brute_force(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(f"v{int(rng.expovariate(0.05))}" for _ in range(rng.randint(0, 300)))) for i in range(60)]
    items = [(i, " ".join(f"v{rng.randint(0, 130)}" for _ in range(rng.randint(0, 6)))) for i in range(40)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {i: set() for i, _ in texts}
    for r in proximity_matches(docs, bench).collect():
        got[r["__vt_id"]].add(r["item_id"])
    want = plain_near(texts, items)
    assert got == want and any(want.values())
