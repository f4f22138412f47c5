import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import sitewright.llm.conversation_trie as trie
from sitewright.llm.conversation_trie import combined, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {conv: [x[2] for x in sorted(own)] for conv, own in turns.items()}
    members, children = defaultdict(list), defaultdict(list)
    rebuilt = {}
    for conv in turns:
        h = zlib.crc32(str(conv).encode()) % 6
        rebuilt[conv] = tuple(turns.get(int(conv / 100) * 100, [])[:h] + turns[conv][h:])
        for d in range(len(rebuilt[conv]) + 1):
            members[rebuilt[conv][:d]].append(conv)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    below = {}
    for key in sorted(members, key=len, reverse=True):
        own = (len(members[key]) - 1) * len(key[-1][1]) if key else 0
        below[key] = (own + sum(below[c][0] for c in children[key]), sum(below[c][1] for c in children[key]) or 1)
    out = []
    for key, own in members.items():
        ended = ",".join(str(c) for c in sorted(own) if len(rebuilt[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        saved, leaves = below[key]
        out.append((min(own), len(key), parent, len(own), len(children[key]), leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows):
    return sorted((tuple(r) for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=lambda r: r[:2])


def conversations(seed):
    rng, rows = random.Random(seed), []
    for conv in [*range(50), 100, 101, 205, 207, 350, 400, *range(401, 420), -3, -100]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 12, 40 if conv % 7 == 0 else 3])):
            role = rng.choice(["user", "a", None]) if rng.random() < 0.1 else "user"
            text = rng.choice(["x", "yé🙂", "", None]) if rng.random() < 0.2 else f"same{t}"
            rows.append((conv, rng.choice([t, t, t, None]), role, text))
    # two equal long conversations, rows without a conversation, repeated rows
    rows += [(c, k, "u", f"t{k}") for c in (777, 778) for k in range(300)]
    return [*rows, (None, 1, "user", "q"), rows[0], rows[0]]


@pytest.mark.parametrize("segment, block, chunk", [(256, 1024, 4096), (2, 3, 3)])
def test_trie_brute_force(spark, monkeypatch, segment, block, chunk):
    for name, value in (("SEGMENT", segment), ("BLOCK", block), ("CHUNK", chunk)):
        monkeypatch.setattr(trie, name, value)
    rows = conversations(segment)
    assert found(spark, rows) == brute(rows)


def test_trie_hot_prefix(spark):
    # most conversations are copies of one, and some are only a head
    rows = [(c, t, "u", f"turn {t}") for c in range(1, 400) for t in range(3 if c % 5 else 1)]
    assert found(spark, rows) == brute(rows)


def test_trie_empty_table(spark):
    assert found(spark, []) == []


def test_trie_turnless_conversation(spark):
    conv = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(conv, 0, "u", "gone")]
    assert found(spark, rows) == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_trie_other_columns(spark):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "b")]
    more = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "hi": F.lit(1), "part": F.lit(2), "digest": F.lit(3)})
    renamed = more.withColumnsRenamed({"conv_id": "c", "text": "body"})
    got = prefix_trie(renamed, conv_column="c", text_column="body").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == brute(rows)


def test_fingerprints_compose():
    codes = [random.Random(1).getrandbits(120) for _ in range(20)]

    def value(part):
        out = 0
        for code in part:
            out = combined(out, code, 1)
        return out

    for cut in range(21):
        assert combined(value(codes[:cut]), value(codes[cut:]), 20 - cut) == value(codes)


def test_groups_of_one_fingerprint_and_different_turns_fail(spark):
    root, one, other = (0, 0, 0, 0, 0, 0, 0), (5, 6, 0, 0, 1, 2, 9), (5, 6, 0, 0, 1, 3, 9)
    spans = spark.createDataFrame([(1, 0, 1, [root, one]), (2, 0, 1, [root, other])], trie.SPANS)
    convs = spark.createDataFrame([(1, 1, 5, 6, 0, 0, b"", [], []), (2, 1, 5, 6, 0, 0, b"", [], [])], trie.CONVS)
    with pytest.raises(Exception, match="fingerprint differ"):
        trie._summed(convs, spans).collect()
