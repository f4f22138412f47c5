import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def make_docs(spark):
    def make(texts, langs=None, sources=None, ids=None):
        rows = [
            (
                i if ids is None else ids[i],
                text,
                langs[i] if langs else "en",
                sources[i] if sources else "s",
                None if text is None else len(text),
            )
            for i, text in enumerate(texts)
        ]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make


#: Texts that every operator must get through: null, empty, blanks, one word, other scripts, repeats.
ODD = [None, "", " ", "\n\n", "one", "one", "日本語 のテキスト　です", "x" * 5000, "a\x00b\x01c", "é́ 🙂🙂", "word " * 3000]
