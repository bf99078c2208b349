"""Documents that every operator must stand: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, bits long, root string, hash long, term string, n_tokens int, words string, score double"


def odd_documents(spark, more=()):
    texts = [None, "", " ", "a", "one two three", "one two three", "x" * 70_000, "wort " * 20_000, "l\n\n\nl\nline", "Ünï ñandú 日本語 😀 ́", *more]
    rows = [(i, t, None if i % 2 else "en", "src", None if t is None else len(t), 1, 2, "r", 3, "t", 4, "w", 0.5) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "one two three", None, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def write_tables(path, **tables):
    """A folder of tables, each of several files' worth of rows in one file folder."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
