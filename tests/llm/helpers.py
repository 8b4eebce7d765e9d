"""Small tables with the awkward rows that every operator must bear."""

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997} tail{i % 13}" for i in range(30_000))
AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 60),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 60),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n\x0b ", "en", "b", 5),
    (6, "two words", "en", None, 9),
    (7, "two words", "en", "c", 9),
    (8, LONG, "en", "c", len(LONG)),
    (None, "nobody knows the id of this text but it has words", "en", "a", 50),
    (9, "Grüße an 漢字 und 🙂 überall, ja!", "de", "d", 30),
    (9, "Grüße an 漢字 und 🙂 überall, ja!", "de", "d", 30),
]


def documents(spark, rows=AWKWARD, clash=False):
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F
        for name in ("size", "taken", "target", "score", "rank", "value", "class_id", "chunk", "kind", "held_out", "toxic", "node", "component"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def words(text):
    return (text or "").encode().lower().split()
