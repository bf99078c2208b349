"""Text functions, as Column to Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that say nothing about a synopsis.
STOP_WORDS = """
the and for with that this from his her its but who she him they them their has have was were are been when where what
will would into out off over after before then than not all one two new now get gets must can back own way himself
herself while about which there story film movie life man woman young old world years year time day night find finds
take takes make makes come comes help set only
""".split()
# Articles that catalogues move behind the title.
ARTICLES = ["The", "A", "An", "La", "Le", "Les", "El", "Il"]
# First and last year of the decades a request can name.
DECADES = {"80s": (1980, 1989), "90s": (1990, 1999), "00s": (2000, 2009), "10s": (2010, 2019), "20s": (2020, 2029)}

TITLE_YEAR = r"^(.*?)\s*\(([0-9]{4})\)\s*$"
TOKEN = r"[\p{L}\p{N}_]{2,}"


@F.pandas_udf(StringType())
def decomposed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKD without combining marks: the one text function that Spark has no built-in for."""
    for batch in texts:
        yield batch.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def normalised_title(title: Column) -> Column:
    """Letters and digits only, without accents, in lower case."""
    return F.regexp_replace(F.lower(decomposed(F.coalesce(title, F.lit("")))), "[^a-z0-9]+", "")


def clean_title(name: Column) -> Column:
    return split_title_year(name)["title"]


def split_title_year(name: Column) -> Column:
    """(title, year or null) of "Title (1999)"."""
    bare = F.trim(name)
    year = F.regexp_extract(bare, TITLE_YEAR, 2)
    return F.struct(F.when(year == "", bare).otherwise(F.trim(F.regexp_extract(bare, TITLE_YEAR, 1))).alias("title"), F.nullif(year, F.lit("")).alias("year"))


def split_catalogue_title(name: Column) -> Column:
    """The same, with an article that stands behind the title ("Fugue, The") moved to the front."""
    parts = split_title_year(F.coalesce(name, F.lit("")))
    moved = F.regexp_replace(parts["title"], rf"^(.*),\s+((?i:{'|'.join(ARTICLES)}))$", "$2 $1")
    return F.struct(moved.alias("title"), parts["year"].alias("year"))


def overview_terms(overview: Column, limit: int = 12) -> Column:
    """Content words in the order of their first appearance."""
    # From a letter to the last letter of a run, four characters at least.
    found = F.regexp_extract_all(F.lower(F.coalesce(overview, F.lit(""))), F.lit("[a-z][a-z'-]{2,}[a-z]"), F.lit(0))
    return F.slice(F.array_except(found, F.array(*map(F.lit, STOP_WORDS))), 1, limit)


def decade(year: Column) -> Column:
    return F.when(year.rlike("^[0-9]{4}$"), F.concat(F.substring(year, 1, 3), F.lit("0s"))).otherwise(F.lit(""))


def soup_token(text: Column) -> Column:
    """Lower case without spaces; tabs and hyphens stay, as the tokenizer splits at those."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit(""))


def soup(weights: dict) -> Column:
    """Token soup of an item: each field's values as often as its weight says."""
    none = F.array().cast("array<string>")

    def many(values: Column, weight: int) -> Column:
        cleaned = F.transform(F.coalesce(values, none), soup_token)
        return F.flatten(F.array_repeat(cleaned, weight))

    def one(value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) == "", none).otherwise(F.array(value))

    directors = F.when(F.size(F.coalesce(F.col("directors"), none)) > 0, F.col("directors")).otherwise(one(F.col("director")))
    fields = [("genres", F.col("genres")), ("director", directors), ("cast", F.col("cast")), ("keywords", F.col("keywords")), ("writers", F.col("writers")), ("overview", F.col("overview_terms")), ("collection", one(F.col("collection"))), ("decade", one(F.col("decade")))]
    return F.array_join(F.filter(F.concat(*[many(v, weights.get(k, 1)) for k, v in fields]), lambda t: t != ""), " ")


def soup_token_count(text: Column) -> Column:
    """Distinct tokens of a soup, split at white space."""
    return F.size(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t != "")))


def tokens(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores of any script, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def rating_of_markup(css_class: Column, text: Column) -> Column:
    """Stars out of a class "rated-N" (N halves), else out of star signs, else null."""
    halves = F.regexp_extract(css_class, r"(?:^|\s)rated-([0-9]+)(?:\s|$)", 1)
    stars = F.length(text) - F.length(F.replace(text, F.lit("★"), F.lit("")))
    half = F.length(text) - F.length(F.replace(text, F.lit("½"), F.lit("")))
    return F.when(halves != "", F.try_divide(halves.cast("double"), F.lit(2.0))).otherwise(F.nullif(stars + 0.5 * half, F.lit(0.0)))


def item_document() -> Column:
    """Prose about an item, for a text encoder."""
    listed = lambda label, values, n: F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.concat(F.lit(label), F.array_join(F.slice(values, 1, n), ", "), F.lit(".")))
    filled = lambda name: F.nullif(F.trim(F.coalesce(F.col(name), F.lit(""))), F.lit(""))
    return F.concat_ws(" ", F.concat(filled("title"), F.lit(".")), filled("tagline"), filled("overview"), listed("Genres: ", F.col("genres"), 100), listed("Themes: ", F.col("keywords"), 12), F.concat(F.lit("Directed by "), filled("director"), F.lit(".")), listed("Starring ", F.col("cast"), 4))


def query_document(text: Column, keywords: Column) -> Column:
    return F.concat_ws(". ", F.nullif(F.trim(text), F.lit("")), F.nullif(F.array_join(keywords, ", "), F.lit("")))


def rating_label(votes: Column, average: Column) -> Column:
    """"7.2/10 (n votes)", or that there are too few. One decimal, half to even."""
    few = F.coalesce(votes, F.lit(0)) < 20
    return F.when(few, F.lit("not enough ratings yet")).otherwise(F.concat(F.format_number(F.coalesce(average, F.lit(0.0)), 1), F.lit("/10 ("), votes.cast("string"), F.lit(" votes)")))


def why_line(why: Column) -> Column:
    """One clause for the overlaps of a pick."""
    said = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", ")))
    line = F.concat_ws("; ", F.when(F.coalesce(why["director"], F.lit("")) != "", F.concat(F.lit("same director ("), why["director"], F.lit(")"))), said("shared genres: ", why["genres"]), said("shared themes: ", why["keywords"]), said("shared cast: ", why["cast"]))
    return F.when(line == "", F.lit("no specific overlap computed")).otherwise(line)


def vote_of_callback(text: Column) -> Column:
    """(verdict, item) of "v:<1 or -1>:<id>", null fields where it is something else."""
    fits = text.rlike("^v:-?1:[0-9]+$") & (F.octet_length(text) <= 64)
    return F.struct(F.when(fits, F.split_part(text, F.lit(":"), F.lit(2)).try_cast("int")).alias("verdict"), F.when(fits, F.split_part(text, F.lit(":"), F.lit(3)).try_cast("long")).alias("item"))


def title_key(title: Column) -> Column:
    return F.lower(F.trim(title))
