import pytest
from pyspark.sql import types as T

from plenum.llm.common import prepared

LONG = " ".join(f"word{i % 977} alpha{i % 31}" for i in range(40_000))

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# names that operators use inside
CLASHES = ("k_id", "k_text", "h", "g", "fp", "fingerprint", "pos", "score", "ids", "found", "node", "root", "window", "__row", "label x")


@pytest.fixture(scope="session")
def llm(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return prepared(spark)


@pytest.fixture(scope="session")
def make(llm):
    """Documents from (doc_id, text[, lang]); every table has columns with clashing names."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        df = llm.createDataFrame(full, DOCUMENTS)
        for name in CLASHES:
            df = df.withColumn(name, df["source"])
        return df

    return build


ODD = [
    (1, None),
    (2, ""),
    (None, "a text without an id, long enough to count as a line"),
    (3, LONG),
    (4, "same text in two rows of one id, also in another"),
    (4, "same text in two rows of one id, also in another"),
    (5, "same text in two rows of one id, also in another"),
    (5, "one id with a second text, which is another text"),
    (6, " \n\t \x0b "),
    (7, "çà ́ 日本語 \U0001f600 \x00 \x1c end"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def none(make):
    return make([])


def triples(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)
