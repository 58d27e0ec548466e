"""Rows that every operator must survive: nulls, empty and long texts, repetitions, clashing names."""

LONG = "der kurze Satz und die lange Zeile " * 4000

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf.", "en", 1),
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf.", "en", 2),
    (2, None, None, None),
    (3, "", "en", 3),
    (4, "   \n\t ", "de", 3),
    (5, "1234 5678 !!!", "fr", 3),
    (6, LONG, "de", 4),
    (7, "Ünïcode wörds ñ and 汉字 stay whole: mail me at a.b+c@x-y.example.org or +1 (555) 010-9999.", "es", 5),
    (7, "Ünïcode wörds ñ and 汉字 stay whole: mail me at a.b+c@x-y.example.org or +1 (555) 010-9999.", "es", 5),
    (8, "a", "en", 6),
    (None, "A text without an id, the quick brown fox jumps over the lazy dog and runs away.", "en", 7),
]
#: Extra columns carry names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, label int"


def documents(spark, rows=ROWS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "rank", "words", "fp", "row", "n", "kind", "home", "target_id", "found", "_of"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return documents(spark, ROWS[:1]).where("false")


def labels(spark):
    rows = [(0, 1, 0), (1, 1, 0), (6, 1, 1), (7, 0, 0), (7, 1, None), (8, None, 1), (None, 1, 1), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
