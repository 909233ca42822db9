"""Small tables that every operator has to stand."""

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, **columns):
    """A row for each text; ids from 0 unless given."""
    ids = columns.get("ids") or range(len(texts))
    source = columns.get("source") or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, source, strict=True)], DOCUMENTS)


def awkward(spark):
    """Nulls in every column, empty, wordless, short and very long texts, ties and repeated rows, and extra columns that clash."""
    long = " ".join(f"w{i % 7919}" for i in range(150_000))
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, " \n..!? ", None, "s", 7), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (5, "one", "en", "s", 3), (6, long, "en", "t", len(long)), (7, "x" * 300_000, "en", "t", 300_000), (9, " " * 5_000_000, "en", "t", 5_000_000), (10, "a" + "\n" * 2_000_000 + " \t" * 1_000_000 + "b", "en", "t", 4_000_002), (None, "no id here at all", "en", "s", 17), (8, "Ünïcödé 日本語 text 🎉", "ja", "s", 20)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.selectExpr("*", "1", "2", "3", "4", "5").toDF(*df.columns, "TEXT", "__uf_row", "__row", "sig", "sig")


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
