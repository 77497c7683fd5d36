"""Documents with the awkward cases, next to the given ones."""

import os

FOLDER = os.environ.get("TERMLOOM_TEST_FOLDER", "/root/testdata/sf0.001")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, Score double"

ODD = [
    (None, "no id at all, but a few words", "en", None, None, 1, 0.5),
    (900_001, None, None, "s1", None, None, None),
    (900_002, "", "en", "s1", 0, None, None),
    (900_003, " \t\n\x0b\x0c\r ", None, None, 7, None, None),
    (900_004, "one", "en", "s1", 3, None, None),
    (900_005, "one two", "en", "s1", 7, None, None),
    (900_006, "One\tTWO ", "en", "s2", 8, None, None),
    (900_007, "same same same same", "en", "s2", 19, None, None),
    (900_007, "same same same same", "en", "s2", 19, None, None),
    (900_008, "same same same  same", "en", "s3", 20, None, None),
    (900_009, "don't you'll we've THEY'RE I'm he'd it's 'tis", "en", "s3", 0, None, None),
    (900_010, "日本語 текст naïve cafe\u0301 ﬁn 😀😀 x\u00a0y a\u2003b", None, "s3", 0, None, None),
    (900_011, "12 345 ... !!! --- #$%", None, "s3", 0, None, None),
    (900_012, "<|endoftext|> stays <|startoftext|> text", "en", "s3", 0, None, None),
    (900_013, "word " * 30_000, "en", "s4", 150_000, None, None),
    (900_014, "x" * 20_000, None, "s4", 20_000, None, None),
    (900_015, "tail   \n\n  \n end  ", "en", "", 0, None, None),
    (-5, "a negative id", "en", "s5", 13, None, None),
]


def given(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame(ODD, SCHEMA)
    return docs.unionByName(extra, allowMissingColumns=True).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
