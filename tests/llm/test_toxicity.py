import random

from tests.llm.cases import odd_documents, write_tables
from vespertide.llm.toxicity import Lexicon, drop_toxic, features, findings, fold, learn, op4_toxicity, with_score


def test_folding_and_findings():
    assert fold("ІDІ0T  mо​ron") == "idiot  moron"
    assert fold("year 2024 and 100 3rd") .startswith("year 2024 and 100")
    assert fold("you a$$ and 5cum5, idiot! costs 5$ at 10:30") == "you ass and scums, idiot! costs 5$ at 10:30"
    automaton = Lexicon({"idiot": 4.0, "trash": 2.0, "mor*": 3.0}).automaton()
    text = fold("1d10t, trash can, trash, morons, idiotic")
    assert [text[a:b] for a, b, _ in findings(text, automaton)] == ["idiot", "trash", "mor"]
    assert features("", automaton) == (0.0, 0.0)


def test_learns_and_holds(spark, sf_dir):
    got = op4_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    wrong = sum(r["predicted"] != r["toxic"] for r in rows)
    assert len(rows) > 50 and wrong <= 0.05 * len(rows)
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_odd_rows(spark, tmp_path):
    docs = odd_documents(spark, ["you stupid worthless idiot scum", "empty the trash can"])
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    lexicon = learn(docs, labels)
    scored = {r["doc_id"]: r["toxicity"] for r in with_score(docs, lexicon).collect()}
    assert scored[10] > 0.5 > scored[11] and scored[0] == scored[1]
    kept = drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert op4_toxicity(spark, write_tables(tmp_path / "a", documents=docs.limit(0), labels=labels.limit(0))).count() == 0


def plain_findings(folded, entries, exceptions):
    """Every entry at every word start, the heaviest one that no exception phrase covers, without an automaton."""
    bounded = lambda a, b, open_end: (a == 0 or not folded[a - 1].isalnum()) and (open_end or b == len(folded) or not folded[b].isalnum())
    excused = [(a, a + len(p)) for p in exceptions for a in range(len(folded)) if folded.startswith(p, a) and bounded(a, a + len(p), False)]
    best = {}
    for entry, weight in entries.items():
        word = entry.rstrip("*")
        for a in range(len(folded)):
            if folded.startswith(word, a) and bounded(a, a + len(word), entry.endswith("*")) and weight > best.get(a, (0, 0))[1]:
                best[a] = (a + len(word), weight)
    return [(a, w) for a, (b, w) in sorted(best.items()) if not any(x <= a and b <= y for x, y in excused)]


def test_findings_match_brute_force():
    rng = random.Random(9)
    words = ["idiot", "id", "idiotic", "trash", "can", "trashy", "moron", "the", "clown", "fish", "cl0wn", "m0r0n"]
    for _ in range(300):
        entries = {w + rng.choice(["", "*"]): rng.choice([1.0, 2.0, 3.0, 4.0]) for w in rng.sample(["idiot", "id", "trash", "moron", "clown", "clow"], 4)}
        folded = fold("".join(rng.choice(words) + rng.choice([" ", " ", "", ", "]) for _ in range(rng.randint(0, 12))))
        got = [(a, w) for a, _, w in findings(folded, Lexicon(entries, ["trash can", "clown fish"]).automaton())]
        assert got == plain_findings(folded, entries, ["trash can", "clown fish"]), (folded, entries)


def test_length_counts(spark):
    lexicon = learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert lexicon.curve[2] > 0 and len(lexicon.entries) < 100
    word = max(lexicon.entries, key=lexicon.entries.get).rstrip("*")
    texts = [(0, f"{word} here"), (1, f"{word} here " + "many other words " * 200)]
    a, b = (r["toxicity"] for r in with_score(spark.createDataFrame(texts, "doc_id long, text string"), lexicon).orderBy("doc_id").collect())
    assert a > b
