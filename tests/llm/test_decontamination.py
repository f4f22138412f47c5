import random
import re

import pytest
from pyspark.sql import functions as F

from sitewright.llm.decontamination import find_contamination

from .conftest import ODD

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, width=10):
    windows = []
    for item, text in items:
        words = WORD.findall(lowered(text))
        windows += [(item, words[a : a + width]) for a in range(max(1, len(words) - width + 1)) if words]
    out = []
    for doc, text in docs:
        words, places = WORD.findall(lowered(text)), [m.span() for m in WORD.finditer(lowered(text))]
        hit, found = set(), set()
        for item, window in windows:
            for a in range(len(words) - len(window) + 1):
                if words[a : a + len(window)] == window:
                    hit.update(range(a, a + len(window)))
                    found |= {str(item)} if item is not None else set()
        spans = []
        for k in sorted(hit):
            if spans and k - 1 in hit:
                spans[-1][1] = places[k][1]
            else:
                spans.append(list(places[k]))
        out.append((doc, len(words), len(hit), sorted(found), [tuple(s) for s in spans], bool(hit)))
    return sorted(out)


def found(docs, items, *args, **more):
    rows = find_contamination(docs, items, *args, **more).collect()
    return sorted((r[0], r[1], r[2], r[3], [tuple(s) for s in r[4]], r[5]) for r in rows)


def passages(seed):
    rng = random.Random(seed)
    words, marks = ["a", "B", "ée", "1x", "日本", "z"], [" ", " - ", "\n", "...", "\x00"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))

    items = [(i or None, text(rng.randint(0, 14))) for i in range(15)] + [(50, None), (3, "a b a b"), (51, ""), (3, "a b a b")]
    docs = [(i, text(rng.randint(0, 200))) for i in range(40)] + [(99, None), (100, ""), (100, ""), (101, "İİ a B. a b")]
    return docs, items


@pytest.mark.parametrize("width", [1, 2, 3, 5, 10])
@pytest.mark.parametrize("shard_bytes", [4_000_000, 60])
def test_contamination_brute_force(spark, width, shard_bytes):
    docs, items = passages(width)
    got = found(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), width, shard_bytes=shard_bytes)
    assert got == brute(docs, items, width)


def test_short_item_is_half_a_window_of_another(spark):
    docs = [(1, "x a b c d e y"), (2, "a b c d e f g h i j k"), (3, "f g h i j k l")]
    items = [(1, "a b c d e"), (2, "a b c d e f g h i j")]
    assert found(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)) == brute(docs, items)


def test_contamination_odd_texts_and_columns(spark):
    docs = list(enumerate(ODD))
    items = [(1, "word " * 12), (2, "one"), (3, "日本語 のテキスト　です")]
    frame = spark.createDataFrame(docs, DOCS).withColumns({"id": F.lit(1), "items": F.lit("x"), "n_words": F.lit(2)})
    assert found(frame, spark.createDataFrame(items, ITEMS)) == brute(docs, items)


def test_contamination_id_named_like_a_result(spark):
    docs = spark.createDataFrame([("q", "one two")], "n_hit string, text string")
    got = find_contamination(docs, spark.createDataFrame([(1, "two")], ITEMS), id_column="n_hit")
    assert [tuple(r)[:3] for r in got.collect()] == [("q", 2, 1)]


def test_contamination_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert found(none, items) == []
    assert found(spark.createDataFrame([(1, "a b")], DOCS), items) == [(1, 2, 0, [], [], False)]
