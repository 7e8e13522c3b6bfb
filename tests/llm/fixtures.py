"""Small frames with the awkward cases: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHING = (
    "hashes array<int>, copies string, rank int, _text string, score string, word string, g int, d int, h int, _stats int, _parts string, "
    "_grams int, _text_hash string, _id string, _hash int, _repeated string, _salt int, _row string, _rank int, _to int, _next string, "
    "_first int, _after int, _length int, _sequence int, _times int, _offset int, _l int, _s int, _before int, _n int, row string, node int"
)


def docs(spark, rows):
    """Documents from (doc_id, text)."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def with_extras(df):
    """The rows with columns of clashing names, whose values tell the row and the column."""
    own = F.coalesce(F.col("doc_id"), F.lit(-1))
    for k, column in enumerate(CLASHING.split(", ")):
        name, kind = column.split(" ")
        value = own * 100 + k
        df = df.withColumn(name, F.array(value.cast("int")) if kind.startswith("array") else value.cast(kind))
    return df


def assert_values_stay(before, after):
    """Each row of ``after`` has the columns and the values of a row of ``before``, but for the text and its length."""
    assert after.columns[: len(before.columns)] == before.columns
    names = [c for c in before.columns if c not in ("text", "n_chars")]
    rows = lambda df: {repr(tuple(r)) for r in df.select(*(f"`{c}`" for c in names)).collect()}
    assert rows(after) <= rows(before)


AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog, again and again."),
    (1, "The quick brown fox jumps over the lazy dog, again and again."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "x"),
    (None, "A text without an id."),
    (6, "Été à l'école — naïve façade № 5 ▁ 日本語 😀\r\nİstanbul"),
    (7, "word " * 30000),
    (8, "z" * 5000),
]
