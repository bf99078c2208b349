"""Which stored title a wanted one means: an index of title grams, and the score of what it finds.

A title answers a wanted one only if one of the two holds the other. What holds a string holds all of its
grams, also the rarest one, so each side is looked up by one gram alone: the wanted title's rarest gram among
all grams of stored ones, and a stored title's rarest gram among all grams of wanted ones. What meets is
verified by the strings. Titles shorter than a gram are grams themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vespertide.functions import text as T
from vespertide.operators.common import finished, first_numbered, kept, small
from vespertide.settings import DEFAULTS

GRAM = 3
#: Results that each of the two searches of a request gives.
PER_SEARCH = 10


def grams(title: Column, sizes: range) -> Column:
    """Distinct substrings of so many characters."""
    return F.array_distinct(F.concat(*[cut(title, n) for n in sizes]))


def cut(title: Column, n: int) -> Column:
    return F.when(F.length(title) >= n, F.transform(F.sequence(F.lit(1), F.length(title) - (n - 1)), lambda i: F.substr(title, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def own_grams(title: Column) -> Column:
    """Grams of the full size, or the whole of a shorter title."""
    return F.when(F.length(title) >= GRAM, F.array_distinct(cut(title, GRAM))).otherwise(F.array(title))


class TitleIndex:
    """Stored titles (id, title, year, votes, popularity; original_title if there is one) by their grams.

    A title without a letter or digit is met by its original one alone. once: of titles that score alike whatever is
    asked, only the one of the smallest id is stored.
    """

    def __init__(self, candidates: DataFrame, once: bool = False):
        other = T.normalised_title(F.col("original_title")) if "original_title" in candidates.columns else F.lit(None).cast("string")
        rows = candidates.withColumn("got", T.normalised_title(F.col("title"))).withColumn("alt", other).select("id", "got", "alt", "year", "votes", "popularity")
        if once:
            alike = ["got", "alt", "year", voted().alias("__votes"), popular().alias("__popularity")]
            rows = rows.groupBy(*alike).agg(F.min_by(F.struct("id", "votes", "popularity"), F.struct("id")).alias("first")).select("first.id", "got", "alt", "year", "first.votes", "first.popularity")
        self.rows = kept(rows)
        names = self.rows.where("got <> ''").select("got").distinct()
        self.postings = kept(names.select("got", F.explode(grams(F.col("got"), range(1, GRAM + 1))).alias("gram")))
        self.frequency = kept(self.postings.groupBy("gram").agg(F.count("*").alias("df")))
        rare = names.select("got", F.explode(own_grams(F.col("got"))).alias("gram")).join(self.frequency, "gram")
        self.rarest = kept(rare.groupBy("got").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram")))

    def related(self, wanted: DataFrame) -> DataFrame:
        """(want, got): distinct pairs of a wanted and a stored title where one holds the other. wanted: (want), each once and none empty."""
        own = wanted.select("want", F.explode(own_grams(F.col("want"))).alias("gram"))
        # A gram no stored title has is rarest of all: nothing holds the wanted title.
        rare = own.join(self.frequency, "gram", "left").groupBy("want").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
        holding = self.postings.join(small(rare), "gram").where(F.contains("got", "want")).select("want", "got")
        every = wanted.select("want", F.explode(grams(F.col("want"), range(1, GRAM + 1))).alias("gram"))
        held = self.rarest.join(small(every), "gram").where(F.contains("want", "got")).select("want", "got")
        return holding.unionByName(held).distinct()

    def scored(self, asked: DataFrame) -> DataFrame:
        """Candidates of each row asked with score, those that may be meant alone. asked: with want, not empty, and want_year."""
        names = kept(asked.select("want").distinct())
        by_title = self.related(names).join(self.rows, "got")
        by_other = self.rows.where("alt IS NOT NULL").join(names, F.col("alt") == F.col("want")).where((F.col("got") == "") | ~(F.contains("got", "want") | F.contains("want", "got")))
        columns = ["want", "id", "got", "alt", "year", "votes", "popularity"]
        met = by_title.select(*columns).unionByName(by_other.select(*columns))
        return met.join(asked, "want").withColumn("score", match_score())


def voted() -> Column:
    """Votes as far as they count."""
    return F.least(F.coalesce("votes", F.lit(0)), F.lit(5000))


def popular() -> Column:
    return F.least(F.coalesce("popularity", F.lit(0.0)), F.lit(100.0))


def match_score() -> Column:
    """How well a candidate (got, alt, year, votes, popularity) fits a question (want, want_year)."""
    apart = F.abs(F.col("year").try_cast("int") - F.col("want_year").try_cast("int"))
    known = (F.coalesce(F.col("year"), F.lit("")) != "") & (F.coalesce(F.col("want_year"), F.lit("")) != "")
    year = F.when(~known, 0.0).when(F.col("year") == F.col("want_year"), 40.0).when(apart <= 1, 20.0).otherwise(-15.0)
    title = title_score()
    return F.when(title.isNull(), F.lit(-1.0)).otherwise(title + year + voted() / 1000 + popular() / 50)


def title_score() -> Column:
    want, got = F.col("want"), F.col("got")
    share = F.least(F.length(want), F.length(got)) / F.greatest(F.length(want), F.length(got), F.lit(1))
    same = (want == got) | (want == F.coalesce(F.col("alt"), F.lit("\x00")))
    return F.when(same, 100.0).when(F.startswith(got, want) | F.startswith(want, got), 60 * share).when(F.contains(got, want) | F.contains(want, got), 30 * share)


def best_of(scored: DataFrame, least: float, by: list[str]) -> DataFrame:
    """The best candidate of each group, if it is good enough; equal ones by id."""
    rest = [c for c in scored.columns if c not in by]
    best = scored.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(-F.col("score"), "id")).alias("best"))
    return best.select(*by, "best.*").where(F.col("score") >= least)


#: What a request asks for; many requests may ask for the same.
QUESTION = ["want", "want_year"]


def spelled(requests: DataFrame) -> DataFrame:
    """(want_title, want_year, want): what is asked for, each spelling once; a title without a letter or digit asks for nothing."""
    asked = kept(requests.select("want_title", "want_year").distinct())
    return kept(asked.withColumn("want", T.normalised_title(F.col("want_title"))).where("want <> ''"))


def answered(requests: DataFrame, asked: DataFrame, best: DataFrame) -> DataFrame:
    """requests with the answers to what they ask for. asked: as spelled() gives it; best: one row at most for each QUESTION."""
    same = (F.col("a.want") == F.col("b.want")) & F.col("a.want_year").eqNullSafe(F.col("b.want_year"))
    known = kept(asked.alias("a").join(best.alias("b"), same).select("a.*", *[f"b.{c}" for c in best.columns if c not in QUESTION]))
    to = small(known.withColumnsRenamed({"want_title": "__title", "want_year": "__year"}))
    return requests.select("request", "want_title", "want_year").join(to, (F.col("want_title") == F.col("__title")) & F.col("want_year").eqNullSafe(F.col("__year"))).drop("__title", "__year")


def best_matches(requests: DataFrame, candidates: DataFrame, least: float = DEFAULTS.min_search_score) -> DataFrame:
    """The best candidate of each request, if it is good enough. requests: (request, want_title, want_year), request once each; candidates: as for TitleIndex.

    What many requests ask for is looked up once, among candidates of which those that score alike count once.
    """
    return finished(lambda: found_at_once(requests, candidates, least))


def found_at_once(requests: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    asked = spelled(requests)
    best = best_of(TitleIndex(candidates, once=True).scored(asked.select(*QUESTION).distinct()), least, QUESTION)
    return best_of(answered(requests, asked, best), least, ["request"])


def searched(requests: DataFrame, candidates: DataFrame, per_search: int = PER_SEARCH, least: float = DEFAULTS.min_search_score) -> DataFrame:
    """The best candidate as two searches give it: among the first of the wanted year, and only if that year has none, among the first of any year.

    A search lists titles by how well they fit, whatever the year, the most voted first among equal ones. requests: (request, want_title, want_year), request once each.
    """
    return finished(lambda: found_by_searches(requests, candidates, per_search, least))


def found_by_searches(requests: DataFrame, candidates: DataFrame, per_search: int, least: float) -> DataFrame:
    asked = requests.withColumn("want", T.normalised_title(F.col("want_title"))).where("want <> ''")
    scored = kept(TitleIndex(candidates).scored(asked).withColumn("fit", title_score()))
    order = F.struct(-F.col("fit"), -F.coalesce("votes", F.lit(0)), F.col("id"))

    dated = first_numbered(scored.where((F.coalesce("want_year", F.lit("")) != "") & (F.col("year") == F.col("want_year"))), ["request"], per_search, order)
    open_ = first_numbered(scored.join(dated.select("request").distinct(), "request", "left_anti"), ["request"], per_search, order)
    return best_of(dated.unionByName(open_), least, ["request"]).drop("fit", "place")
