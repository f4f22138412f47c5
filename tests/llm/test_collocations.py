import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm.collocations import MisraGries, collocations

from .conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "lang string, text string"


def brute(rows, max_words=3, threshold=10, top=2000, share=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    candidates = {k: v for k, v in f.items() if len(k) > 2 and v >= threshold}
    longer = Counter()
    for (lang, *words), v in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                part = (lang, *words[i : i + m])
                longer[part] = max(longer[part], v)
    ranked = defaultdict(list)
    for key, a in candidates.items():
        if longer[key] and 100 * longer[key] >= share * a:
            continue
        lang, *words = key
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        ranked[lang].append((-score, -a, " ".join(words).encode(), a, left, right))
    out = []
    for lang, own in ranked.items():
        for i, (score, _, phrase, a, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, i, phrase.decode(), a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n=60):
    rng = random.Random(seed)
    words, ends = ["a", "B", "c", "ée", "z\x00", "日本"], [" ", " ", " ", " \t ", ". ", "\n", "\x0b"]
    made = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 300))) for _ in range(n)]
    return [(rng.choice(["en", None, "und", "fr"]), text) for text in made] + [(None, None), ("en", "")]


@pytest.mark.parametrize("max_words", [2, 3, 4])
@pytest.mark.parametrize("counters", [1_000_000, 7])
def test_collocations_brute_force(spark, max_words, counters):
    rows = texts(max_words)
    got = collocations(spark.createDataFrame(rows, SCHEMA), max_words=max_words, counters=counters, top=150)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, max_words, top=150)


def test_collocations_full_filter(spark):
    # a bit table of a few bits lets everything through, and the exact counts drop it
    rows = texts(9)
    got = collocations(spark.createDataFrame(rows, SCHEMA), filter_bits=8)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_collocations_one_pair_everywhere(spark):
    rng = random.Random(4)
    rows = [("en", " ".join(["of the"] * rng.randint(1, 5) + [f"w{rng.randint(0, 9)}"])) for _ in range(900)]
    got = collocations(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_collocations_odd_texts_and_columns(spark):
    rows = [("en", text) for text in ODD for _ in range(11)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"group": F.lit(1), "phrase": F.lit("x"), "n": F.lit(2), "part": F.lit(3)})
    assert sorted(tuple(r) for r in collocations(docs).collect()) == brute(rows)


def test_collocations_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(2)
    stream = np.concatenate([rng.integers(0, 5000, 20_000), np.repeat(np.arange(6000, 6040), 60)]).astype(np.uint64)
    rng.shuffle(stream)
    true = Counter(stream.tolist())
    threshold = 50
    whole = MisraGries(len(stream) // threshold + 1)
    for part in np.array_split(stream, 9):
        own = MisraGries(whole.capacity)
        own.merge(part, np.ones(len(part), np.int64))
        whole.merge(own.codes, own.counts)
        whole.lost += own.lost
    assert 0 < whole.lost < threshold and len(whole.codes) <= whole.capacity
    assert {k for k, v in true.items() if v >= threshold} <= set(whole.survivors(threshold).tolist())
