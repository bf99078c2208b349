"""Properties that the ranking, the matching and the profiles must keep."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vespertide.functions import text as T
from vespertide.operators import profile, recommend, signals, store
from vespertide.operators.common import standardised
from vespertide.sources import files
from vespertide.streaming import feedback

ITEM = "id long, title string, year string, genres array<string>, keywords array<string>, cast array<string>, director string, directors array<string>, writers array<string>, overview_terms array<string>, collection string, decade string, overview string, vote_average double, vote_count int"


def item(i, title, genres, keywords, director="", collection="", cast=(), year="2000"):
    return (i, title, year, genres, keywords, list(cast), director, [], [], [f"word{i}", f"more{i}", "shared", "common", *keywords], collection, "2000s", "", 7.0, 1000)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        item(1, "Seed", ["Drama", "Science Fiction"], ["space", "physics", "time"], "Ann Director", "Saga", ["Ada", "Bob"]),
        item(2, "Neighbour", ["Drama", "Science Fiction"], ["space", "physics", "planet"], "Ann Director", "", ["Ada"]),
        item(3, "Sequel", ["Drama", "Science Fiction"], ["space", "physics", "time"], "Ann Director", "Saga"),
        item(4, "Making Of", ["Documentary"], ["space", "physics", "time"], "Other One"),
    ]
    rows += [item(10 + k, f"Filler {k}", [["Comedy"], ["Horror"], ["War"]][k % 3], [["love", "party"], ["ghost", "house"], ["army", "front"]][k % 3], f"Person {k % 4}") for k in range(14)]
    return spark.createDataFrame(rows, ITEM)


@pytest.fixture(scope="module")
def one_signal(corpus):
    return [signals.metadata_signal(corpus)]


def ids(df):
    return [r["id"] for r in df.orderBy("place").collect()]


def test_named_item_leads_and_is_never_returned(corpus, one_signal):
    got = recommend.recommend(corpus, one_signal, references=[1], keywords=["ghost"], min_z=0.5)
    found = ids(got)
    assert found[:2] == [3, 2] and 1 not in found and 4 not in found
    assert all(r["why"] != "no specific overlap computed" for r in got.collect())


def test_keywords_alone_suffice_and_nothing_gives_nothing(corpus, one_signal):
    found = ids(recommend.recommend(corpus, one_signal, keywords=["ghost"], min_z=0.5))
    assert found and all(i >= 10 and (i - 10) % 3 == 1 for i in found)
    assert recommend.recommend(corpus, one_signal).count() == 0
    assert recommend.recommend(corpus, one_signal, keywords=["unheardof"]).count() == 0


def test_floor_and_watched(spark, corpus, one_signal):
    assert recommend.recommend(corpus, one_signal, references=[1], min_z=50.0).count() == 0
    watched = spark.createDataFrame([("sequel", "2000"), ("neighbour", None)], "title_key string, year string")
    found = ids(recommend.recommend(corpus, one_signal, references=[1], watched=watched, min_z=0.5))
    assert 3 not in found and 2 in found
    assert 2 not in ids(recommend.recommend(corpus, one_signal, references=[1], disliked=[2], min_z=0.5))


def test_negative_best_gives_nothing(spark):
    scored = spark.createDataFrame([(1, -1.0), (2, -2.0)], "id long, z double")
    assert recommend.above_floor(scored, -5.0).count() == 0


def test_one_seat_per_collection(spark):
    rows = [(1, "a", 9.0), (2, "a", 8.0), (3, "", 7.0), (4, None, 6.0), (5, "b", 5.0), (6, "a", 4.0)]
    df = spark.createDataFrame(rows, "id long, collection string, z double")
    assert ids(recommend.seated(df, 6)) == [1, 3, 4, 5, 2, 6] and ids(recommend.seated(df, 3)) == [1, 3, 4]


@pytest.mark.parametrize(
    ("answer", "want"),
    [('{"order":[4,0,2]}', [5, 1, 3]), ('{"order":[99,1,1,-1]}', [2, 1, 3]), ("not json", [1, 2, 3]), (None, [1, 2, 3]), ('{"order":[2]}', [3, 1, 2]), ('{"order":[]}', [1, 2, 3])],
)
def test_rerank(spark, answer, want):
    picks = spark.createDataFrame([(k, k) for k in range(1, 11)], "place int, id long")
    assert ids(recommend.rerank(picks, answer)) == want
    assert ids(recommend.rerank(picks.where("place <= 3"), answer)) == [1, 2, 3]


def test_matching(spark):
    candidates = spark.createDataFrame(
        [(1, "Dune", "2021", 9000, 90.0), (2, "Dune", "1984", 3000, 30.0), (3, "The Real Adolescence: Our Killer Kids", "2024", 9999, 99.0), (4, "WALL·E", "2008", 10, 1.0), (5, "Amélie", "2001", 10, 1.0), (6, "Alien³", "1992", 10, 1.0)],
        "id long, title string, year string, votes int, popularity double",
    )
    asked = [("dune", "1984"), ("dune", "1985"), ("adolescence", None), ("wall-e", None), ("AMELIE", "2001"), ("alien3", None), ("", None), ("zz", "2000")]
    requests = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(asked)], "request int, want_title string, want_year string")
    got = {r["request"]: r["id"] for r in recommend.best_matches(requests, candidates).collect()}
    assert got == {0: 2, 1: 2, 3: 4, 4: 5, 5: 6}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.overview_terms(F.lit("The cat's  BIG-hearted friend's friend, 'til dawn-- a dawn"))) == ["cat's", "big-hearted", "friend's", "friend", "dawn"]
    assert one(T.decade(F.lit("1999"))) == "1990s" and one(T.decade(F.lit("99"))) == ""
    split = one(T.split_catalogue_title(F.lit("Fugue, The (1972) ")))
    assert (split["title"], split["year"]) == ("The Fugue", "1972")
    assert one(T.split_title_year(F.lit(" Plain ")))["year"] is None
    assert one(T.rating_label(F.lit(100), F.lit(7.25))) == "7.2/10 (100 votes)" and one(T.rating_label(F.lit(3), F.lit(9.0))) == "not enough ratings yet"
    for text, want in (("v:1:42", (1, 42)), ("v:-1:7", (-1, 7)), ("v:0:7", (None, None)), ("x", (None, None)), ("v:1:" + "9" * 70, (None, None))):
        got = one(T.vote_of_callback(F.lit(text)))
        assert (got["verdict"], got["item"]) == want


def test_standardised_guards(spark):
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, s double")
    assert standardised(flat).count() == 0 and standardised(flat.limit(1)).count() == 0


def test_votes_and_profiles(spark, corpus):
    t = datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, 7, 2, 1, t), (2, 7, 2, -1, t + timedelta(1)), (3, 7, 3, 1, t), (4, 7, 999, 1, t), (5, 8, 2, 0, t)], "event_id long, user_id long, item long, verdict int, ts timestamp_ntz")
    now = profile.latest_votes(log)
    assert {(r["user_id"], r["item"]): r["verdict"] for r in now.collect()} == {(7, 2): -1, (7, 3): 1, (7, 999): 1, (8, 2): 0}
    assert {r["user_id"]: (r["up"], r["down"]) for r in profile.vote_counts(now).collect()} == {7: (2, 1), 8: (0, 1)}
    fragment = profile.vote_fragment(now, corpus)
    assert {(r["user"], r["kind"], r["item"], r["rating"], r["total"]) for r in fragment.collect()} == {(7, "disliked", 2, 0.5, 3), (7, "liked", 3, 5.0, 3), (8, "disliked", 2, 0.5, 1)}
    listed = [(7, "liked", k, None, f"T{k}", "1999", 4.0) for k in range(1, 71)] + [(7, "liked", 71, 3, "x", None, 4.0), (7, "liked", 72, None, "Sequel ", "2000", 4.0)]
    merged = profile.merge(fragment, spark.createDataFrame(listed, "user long, kind string, place int, item long, title string, year string, rating double"))
    liked = [(r["source"], r["title"]) for r in merged.where("user = 7 AND kind = 'liked'").orderBy("place").collect()]
    assert len(liked) == 60 and liked[0] == ("votes", "Sequel") and liked[1] == ("listed", "T1") and "Sequel " not in {t for _, t in liked}
    films = spark.createDataFrame([(1, k, f"F{k}", "2000", [5.0, 3.0, 4.0, 1.0][k] if k < 4 else None) for k in range(20)], "user long, pos int, title string, year string, rating double")
    split = {k: [r["pos"] for r in profile.split_ratings(films).where(F.col("kind") == k).orderBy("place").collect()] for k in ("liked", "disliked")}
    assert split == {"liked": [0, 2, *range(4, 14)], "disliked": [3]}


def test_legacy_taste(spark):
    w = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (3, "a", 1.0)], "id long, term string, w double")
    liked = spark.createDataFrame([(1, 5.0), (2, 3.0)], "seed long, rating double")
    got = {r["term"]: round(r["w"], 6) for r in signals.legacy_taste(w, liked, spark.createDataFrame([(3,)], "seed long")).collect()}
    assert got == {"a": round(2.5 / 3 - 0.3, 6), "b": round(0.5 / 3, 6)}


def test_files(spark, tmp_path):
    (tmp_path / "ml").mkdir()
    (tmp_path / "ml/ratings.csv").write_text("userId,movieId,rating,timestamp\n1,2,4.5,9\n")
    (tmp_path / "ml/movies.csv").write_text('movieId,title,genres\n2,"Fugue, The (1972)",Drama\n')
    (tmp_path / "ml/links.csv").write_text("movieId,imdbId,tmdbId\n2,tt1,603\n3,tt2,\n")
    kind, folder = files.find_dataset(spark, str(tmp_path))
    assert kind == "csv" and [tuple(r) for r in files.ratings_csv(spark, folder).collect()] == [(1, 2, 4.5)]
    assert [tuple(r) for r in files.links_csv(spark, folder).collect()] == [(2, 603)] and files.titles_csv(spark, folder).count() == 1
    assert files.find_dataset(spark, str(tmp_path / "ml")) is None
    files.save(spark.range(3), f"{tmp_path}/u/ratings_train.parquet")
    files.save(spark.range(2), f"{tmp_path}/u/ratings_test.parquet")
    assert files.union_existing(spark, f"{tmp_path}/u").count() == 5 and files.load(spark, f"{tmp_path}/none") is None
    assert files.same_ids(spark.range(3), files.load(spark, f"{tmp_path}/u/ratings_train.parquet")) and not files.same_ids(spark.range(2), spark.range(3))
    (tmp_path / "old.json").write_text('{"5": {"title": "A", "score": 3.0}, "6": {"id": 60, "title": "B"}}')
    legacy = files.legacy_records(spark, f"{tmp_path}/old.json", "id long, title string, score double")
    assert sorted(tuple(r) for r in legacy.collect()) == [(5, "A"), (60, "B")]
    assert files.import_once(legacy, legacy).count() == 0 and files.import_once(legacy.limit(0), legacy).count() == 2


def test_grid_and_features(spark):
    html = '<ul><li class="griditem"><div class="react-component x" data-item-name="Dune (2021)" data-item-slug="dune"></div><span class="rating rated-9">x</span></li><li class="griditem"><div class="react-component" data-item-name="Heat"></div><span class="rating">★★½</span></li><li class="griditem"><div class="other"></div></li></ul>'
    rows = files.grid_rows(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert [tuple(r)[2:] for r in rows] == [("Dune", "2021", "dune", 4.5), ("Heat", None, "", 2.5)]
    raw = '{"id":1,"title":"A","release_date":"1999-03-31","genres":[{"name":"Drama"}],"crew":[{"name":"D1","job":"Director"},{"name":"W","job":"Writer"},{"name":"D2","job":"Director"}],"cast":[{"name":"C"}]}'
    f = spark.createDataFrame([(raw,)], "j string").select(files.features(F.col("j")).alias("f")).first()["f"]
    assert (f["year"], f["decade"], f["director"], f["directors"], f["writers"], f["keywords"], f["vote_count"]) == ("1999", "1990s", "D1", ["D1", "D2"], ["W"], [], 0)


def test_store(spark):
    requests = spark.createDataFrame([("A ", None), ("b", "1")], "query string, year string")
    searches = spark.createDataFrame([("a", None, None, 2), ("B", "1", 5, 1)], "query string, year string, item_id long, _v int")
    assert {(r["query"], r["hit"], r["item_id"]) for r in store.cached_search(requests, searches).collect()} == {("A ", True, None), ("b", False, None)}


def test_spacing(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = [0, 2, 3.5, 6.4, 6.6, 20]
    log = spark.createDataFrame([(1, k, t + timedelta(seconds=s)) for k, s in enumerate(at)], "user_id long, event_id long, ts timestamp_ntz")
    want = [True, False, True, False, True, True]
    assert [r["accepted"] for r in feedback.accept_requests_batch(log).orderBy("event_id").collect()] == want
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    q = feedback.accept_requests(stream).writeStream.format("memory").queryName("accepted").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["accepted"] for r in spark.table("accepted").orderBy("event_id").collect()] == want


def test_vote_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, 7, 2, 1, t), (2, 7, 2, -1, t + timedelta(1))], "event_id long, user_id long, item long, verdict int, ts timestamp_ntz")
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    q = feedback.current_votes(stream).writeStream.format("memory").queryName("votes_now").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("votes_now").collect()] == [(7, 2, -1)]


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_uncovered_named_items_leave_the_word_to_keywords(spark, sf_dir):
    from vespertide.operators import blend, recommend
    from vespertide.plans import catalogue
    from vespertide.sources import tables

    both = catalogue.both_signals(spark, sf_dir)
    # A named item that is there, but that no signal covers.
    thin = tables.items(spark, sf_dir).where("id = 9").withColumn("id", F.lit(10**9))
    items = tables.items(spark, sf_dir).unionByName(thin)
    assert blend.reference_scores(both, spark.createDataFrame([(10**9,)], "seed long")) is None
    words = dict(keywords=catalogue.KEYWORDS, min_z=0.3, mode_genre="none", never="none")
    assert recommend.recommend(items, both, references=[10**9], **words).count() > 0
    assert recommend.recommend(items, both, references=[10**9]).count() == 0
    with pytest.raises(ValueError):
        blend.assembled([None])
