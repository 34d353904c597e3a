"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeats, clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quick brown fox jumps over the lazy dog while seven silent owls watch from their crooked tree and count every passing cloud"


def odd_rows():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [(1, PROSE, "en", "a", None), (2, PROSE, "en", None, 5), (2, PROSE, "en", None, 5), (3, None, "en", "a", 0), (4, "", None, "b", 0),
            (5, " \t\n\x0b\f\r ", "de", "b", 3), (6, long, "de", "a", None), (7, "!!! ### 123", "de", None, 1), (None, PROSE + " indeed", "en", "a", 1),
            (None, None, None, None, None), (8, "Ünïcode ÄÖÜ straße \U0001F600 <|endoftext|> x", "de", "b", 9), (9, "a\x00b \x1c c", "en", "b", 2)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """With further columns whose names operators might use themselves."""
    for n in names:
        df = df.selectExpr("*", f"'x' AS `{n}`")
    return df
