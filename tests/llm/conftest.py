import pytest
from pyspark.sql import types as T

# Documents with everything a stage must bear: nulls, empty and long texts, copies, odd columns.
WORDS = [f"w{i:03d}" for i in range(400)]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()),
                       T.StructField("node", T.StringType()), T.StructField("score", T.StringType()), T.StructField("id", T.LongType())])


def sentence(start, count, step=1):
    return " ".join(WORDS[(start + i * step) % len(WORDS)] for i in range(count))


@pytest.fixture(scope="session")
def texts():
    base = sentence(0, 120)
    return {
        1: base, 2: base, 3: base.replace("w060", "changed"), 4: base.upper(), 5: base.replace("w010", "x").replace("w040", "y").replace("w070", "z").replace("w100", "q"),
        6: None, 7: "", 8: " \t\n ", 9: "one two", 10: "one two", 11: "one two three four five", 12: sentence(7, 300, 7), 13: sentence(7, 300, 7) + " tail",
        14: sentence(3, 20000, 11), 15: "é ü日本語 \U0001f600 ΣΑΣ don't", 16: "| home | about | contact |\nAll rights reserved.\n" + sentence(30, 60) + ".",
        17: sentence(200, 80) + ".\n" + sentence(200, 80) + ".", 18: "spam spam spam " * 60, 19: "a" * 5000, 20: "<|endoftext|>x<|startoftext|>",
    }


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, None if k % 5 == 0 else "en" if k % 2 else "de", None if k % 7 == 0 else "hot" if k % 3 else "cold", None, "x", "y", "z", 9) for k, t in texts.items()]
    rows += [(None, texts[1], None, None, None, None, None, None, None), (12, texts[12], "en", "hot", 1, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
