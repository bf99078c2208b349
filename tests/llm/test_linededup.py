import random

from vespertide.llm import common, linededup


def plain(rows):
    """Brute force for corpora whose passages are single long lines."""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate(t.split("\n")):
            if len(line.split()) >= 50:
                first.setdefault(line, (i, k))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if first.get(x, (i, k)) == (i, k)) for i, t in rows}


def test_long_lines_like_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 4)
    passages = [" ".join(f"{word()}{i}" for i in range(rng.randint(51, 80))) for _ in range(4)]
    short = ["boiler plate line", "All rights reserved.", ""]
    rows = []
    for i in range(60):
        lines = [" ".join(f"{word()}{rng.random():.3f}" for _ in range(rng.randint(3, 60))) for _ in range(rng.randint(1, 6))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            lines.insert(rng.randint(0, len(lines)), p)
        lines.append(rng.choice(short))
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.drop_repeated_passages(docs).collect()}
    assert got == plain(rows)


def test_runs_of_short_lines_go_and_odd_rows_stay(spark):
    block = [f"line {i} of a long shared block with some words of its own" for i in range(40)]
    rows = [
        (1, "\n".join(["start one", *block, "end one"]), 5, "x"),
        (2, "\n".join(["another start", "shifted by a line", *block, "end two"]), 5, "x"),
        (3, None, None, None),
        (4, "", 0, None),
        (None, "nothing here", 12, "z"),
        (5, "twice given", 11, "r"),
        (5, "twice given", 11, "r"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, hash string")
    out = linededup.drop_repeated_passages(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1]["text"] == rows[0][1]
    assert got[2]["text"].startswith("another start\n") and got[2]["text"].endswith("end two") and len(got[2]["text"].split("\n")) < 15
    assert got[2]["n_chars"] == len(got[2]["text"]) and got[3]["text"] is None and got[4]["text"] == "" and got[None]["text"] == "nothing here"


def test_hash_clash_is_settled_by_bytes(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    found = linededup.chunks(docs)
    clash = found.withColumn("hash", found["hash"] * 0)
    assert linededup.removable(clash).count() == 1
    # Bytes differ, so nothing goes.
    texts = linededup.origin_texts(docs, linededup.removable(clash))
    assert [r["origin_text"] for r in texts.collect()] == [a]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, words int")
    assert linededup.drop_repeated_passages(docs).columns == docs.columns
    assert linededup.drop_repeated_passages(docs).count() == 0


def brute(rows, need=50):
    """Every run of lines with enough words is looked up among all runs at earlier places."""
    seen, out = {}, {}
    for d, text in sorted(rows):
        lines, go = text.split("\n"), set()
        words = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if words[a] and words[b] and sum(words[a : b + 1]) >= need:
                    o = seen.setdefault(tuple(lines[a : b + 1]), (d, b))
                    if o[0] != d or o[1] < a:
                        go |= set(range(a, b + 1))
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in go)
    return out


def test_passages_of_several_lines_like_brute_force(spark):
    rng = random.Random(2)
    line = lambda n: " ".join(f"w{rng.random():.6f}" for _ in range(n))
    hot = [line(rng.randint(1, 6)) for _ in range(3)] + ["", " "]
    passages = [[rng.choice(hot) if rng.random() < 0.4 else line(rng.randint(5, 30)) for _ in range(rng.randint(2, 9))] for _ in range(12)]
    rows = [(0, "\n".join(hot))]
    for i in range(1, 80):
        lines = []
        for _ in range(rng.randint(1, 5)):
            part = rng.choice(passages)
            lines += rng.choice([part, part, part[rng.randint(0, 2) :], [line(rng.randint(1, 49))], [rng.choice(hot)], [rng.choice(hot[:3])] * rng.randint(1, 40)])
        rows.append((i, "\n".join(lines)))
    want = brute(rows)
    assert sum(want[i] != t for i, t in rows) > 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.drop_repeated_passages(docs).collect()} == want


def test_short_lines_around_a_long_one_go_with_it_unless_known_before(spark):
    long, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, "boiler"), (2, f"title\n{long}\n\n{other}\nboiler"), (3, f"x\ntitle\n{long}\n\n{other}\nboiler")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.drop_repeated_passages(docs).collect()}
    assert got == {1: "boiler", 2: rows[1][1], 3: "x\nboiler"}


def test_hot_keys_are_dealt_in_shards(spark, monkeypatch):
    from vespertide.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    passage = [f"line {i} of a block that very many documents share, word for word" for i in range(6)]
    rows = [(i, "\n".join([f"own start {i}", *passage, f"own end {i}"])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.drop_repeated_passages(docs).collect()}
    assert got == {i: t if i == 0 else f"own start {i}\nown end {i}" for i, t in rows}


def test_windows_over_lines_keep_the_parts_of_the_session(spark):
    rows = [(i, "\n".join(f"{i} line {k} " + "word " * (60 if k % 5 == 0 else 9) for k in range(12))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = linededup.chunks_of(common.materialize(linededup.worded_lines(docs), "lines"))
        # Small rows are not packed into a few tasks, each of which sorts all of its lines once for each order.
        assert found.rdd.getNumPartitions() == 13
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
