import random

import pytest

from vespertide.operators.titles import TitleIndex, best_matches, searched

CANDIDATES = "id long, title string, original_title string, year string, votes long, popularity double"


def score(want, want_year, c):
    got, alt = c["got"], c["alt"]
    share = min(len(want), len(got)) / max(len(want), len(got), 1)
    if want == got or want == alt:
        fit = 100.0
    elif got and (got.startswith(want) or want.startswith(got)):
        fit = 60 * share
    elif got and (want in got or got in want):
        fit = 30 * share
    else:
        return None, None
    year = 0.0
    if c["year"] and want_year:
        year = 40.0 if c["year"] == want_year else 20.0 if abs(int(c["year"]) - int(want_year)) <= 1 else -15.0
    return fit, fit + year + min(c["votes"] or 0, 5000) / 1000 + min(c["popularity"] or 0, 100) / 50


def corpus(rng, letters, n):
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 6, 9])))
    stored = [dict(id=i, got=word(), alt=rng.choice([None, None, word()]), year=rng.choice([None, "", "1999", "2000", "2001"]), votes=rng.choice([None, 10, 9000]), popularity=rng.choice([None, 1.0, 500.0])) for i in range(n)]
    asked = [(i, word(), rng.choice([None, "", "2000"])) for i in range(60)]
    return stored, asked


def tables(spark, stored, asked):
    rows = [(c["id"], c["got"], c["alt"], c["year"], c["votes"], c["popularity"]) for c in stored]
    return spark.createDataFrame(asked, "request int, want_title string, want_year string"), spark.createDataFrame(rows, CANDIDATES)


@pytest.mark.parametrize("letters", ["ab", "abcde"])
def test_best_matches_equal_brute_force(spark, letters):
    rng = random.Random(len(letters))
    stored, asked = corpus(rng, letters, 150)
    want = {}
    for request, title, year in asked:
        found = [(-s, c["id"]) for c in stored for _, s in [score(title, year, c)] if s is not None and s >= 55]
        if found:
            want[request] = min(found)[1]
    requests, candidates = tables(spark, stored, asked)
    assert {r["request"]: r["id"] for r in best_matches(requests, candidates).collect()} == want


def test_two_searches_equal_brute_force(spark):
    rng = random.Random(9)
    stored, asked = corpus(rng, "ab", 300)
    want = {}
    for request, title, year in asked:
        found = [(-fit, -(c["votes"] or 0), c["id"], s, c["year"]) for c in stored for fit, s in [score(title, year, c)] if s is not None]
        dated = sorted(x for x in found if year and x[4] == year)[:3]
        best = min([(-x[3], x[2]) for x in dated or sorted(found)[:3]], default=None)
        if best and -best[0] >= 55:
            want[request] = best[1]
    requests, candidates = tables(spark, stored, asked)
    assert {r["request"]: r["id"] for r in searched(requests, candidates, per_search=3).collect()} == want


def test_a_year_that_has_any_title_is_good_enough(spark):
    """The exact title of another year is not looked at once the wanted year has a title that holds it."""
    stored = [(1, "Alpha Beta Gamma Delta", None, "1999", 0, 0.0), (2, "Alpha", None, "2005", 0, 0.0)]
    candidates = spark.createDataFrame(stored, CANDIDATES)
    ask = lambda year: spark.createDataFrame([(1, "alpha", year)], "request int, want_title string, want_year string")
    assert [r["id"] for r in searched(ask("1999"), candidates).collect()] == [1]
    assert [r["id"] for r in searched(ask("2001"), candidates).collect()] == [2]
    assert [r["id"] for r in best_matches(ask("1999"), candidates).collect()] == [2]


def test_candidates_of_a_request_are_few(spark):
    """Each side is looked up by its rarest gram: of 2,000 titles that share a beginning, the others of a request are not met."""
    rng = random.Random(5)
    names = sorted({"the" + "".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(2_000)})
    candidates = spark.createDataFrame([(i, t, None, None, 0, 0.0) for i, t in enumerate(names)], CANDIDATES)
    index = TitleIndex(candidates)
    wanted = spark.createDataFrame([(t,) for t in names[:50]], "want string")
    rare = {r["gram"]: r["df"] for r in index.frequency.collect()}
    met = index.postings.join(wanted.join(index.rarest, wanted["want"] == index.rarest["got"]).select("want", "gram"), "gram").count()
    assert rare["the"] == len(names) and met < 50 * 20
    assert index.related(wanted).count() == 50


def test_nothing_asked_or_stored(spark):
    requests, candidates = tables(spark, [], [(1, "a", None)])
    assert best_matches(requests, candidates).count() == 0
    assert best_matches(requests.limit(0), candidates).count() == 0
    blank = spark.createDataFrame([(1, "!!", None), (2, None, None)], "request int, want_title string, want_year string")
    some = spark.createDataFrame([(1, "??", "a", None, 0, 0.0)], CANDIDATES)
    assert best_matches(blank, some).count() == 0
    assert [r["id"] for r in best_matches(requests, some).collect()] == [1]


def test_what_many_requests_ask_for_meets_titles_that_score_alike_once(spark, monkeypatch):
    """300 requests for a title that 200 candidates have are 60,000 pairs; three questions about four kinds of them are twelve."""
    met, scored = [], TitleIndex.scored

    def counted(index, asked):
        found = scored(index, asked)
        met.append(found.count())
        return found

    monkeypatch.setattr(TitleIndex, "scored", counted)
    stored = [dict(id=1000 - i, got="redbolt", alt=None, year=["1999", None][i % 2], votes=[9000, 6000, None][i % 3], popularity=[100.0, 300.0, None][i % 3]) for i in range(200)]
    asked = [(i, ["Red Bolt", "RED BOLT!", "réd bolt"][i % 3], ["1999", "2000", None][i // 100]) for i in range(300)]
    requests, candidates = tables(spark, stored, asked)
    got = {r["request"]: (-r["score"], r["id"]) for r in best_matches(requests, candidates).collect()}
    best = {year: min((-score("redbolt", year, c)[1], c["id"]) for c in stored) for year in ["1999", "2000", None]}
    assert got == {i: best[year] for i, _, year in asked}
    assert met == [12]
