"""Token operators against the tokenizer libraries themselves."""

import random
import zlib

import numpy as np
import pytest

from sitewright.llm.access_codes import Segment, read_codes, write_codes
from sitewright.llm.packing import LevelPacker, pack_sequences
from sitewright.llm.tokens import Encoder, vocabulary_path
from sitewright.session import fresh_folder

from .conftest import ODD

TRICKY = [
    *(t for t in ODD if t is not None),
    "  a",
    "a  ",
    "\t\n x  y   z   q",
    "it's  we'll\n\n\n",
    "<|endoftext|> x",
    "a\x1cb \x1d c",
    "\u0085 a\u0085b",
    "\nabc def",
    "x\n",
    "a\n b",
    "a \nb",
    "q\x01 z\x01\ny",
    "a\t b\tc",
    "end. Next, that; this: so! no? é. ñ,",
    "...! ?.. a.b.c x.. y",
]


@pytest.fixture(scope="module")
def plain():
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(vocabulary_path(None))
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


def mixtures(n):
    rng = random.Random(3)
    bits = ["the", " of", "\n", "  ", ".", ",", "'s", "é", "ß", "１２", "x1", "\t", "　", "Zz", "!!", "#", " \n", "日本", "<|endoftext|>"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_encoder_equals_library(plain):
    texts = TRICKY + mixtures(300)
    encoder = Encoder()
    for _ in range(2):  # the second time from what is known
        assert encoder.encode(texts) == [plain(t).tobytes() for t in texts]


def check_pieces(rows, texts, plain, window):
    per_doc, per_sequence = {}, {}
    for r in rows:
        per_doc.setdefault(r.doc_id, []).append(r)
        per_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = np.append(plain(text), 1).astype("<u4")
        at = 0
        for r in sorted(per_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    for pieces in per_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return per_sequence


def test_packing(spark, make_docs, plain):
    texts = ODD + mixtures(80) + ["the of " * 4000]
    docs = make_docs(texts).withColumnRenamed("n_chars", "start").repartition(3)  # a clashing name
    rows = pack_sequences(docs, window=64).collect()
    sequences = check_pieces(rows, dict(enumerate(texts)), plain, 64)
    short = [s for s in sequences.values() if sum(r.length for r in s) < 64]
    assert len(short) <= 3  # one per task
    assert pack_sequences(docs.limit(0)).count() == 0


def test_packing_with_few_open_windows(make_docs, plain):
    texts = mixtures(60)
    rows = pack_sequences(make_docs(texts).coalesce(1), window=64, open_limit=3).collect()
    check_pieces(rows, dict(enumerate(texts)), plain, 64)


def test_sum_of_squares_choice():
    rng = random.Random(5)
    packer = LevelPacker(16, 10**6)
    counts = [0] * 17
    for i in range(400):
        size = rng.randrange(1, 16)

        def squares(level):
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < 16:
                after[level + size] += 1
            return sum(c * c for c in after)

        options = [h for h in range(16 - size + 1) if h == 0 or counts[h]]
        best = max(options, key=lambda h: (-squares(h), h))
        packer.place((i, 0, b"\0\0\0\0" * size, size), size)
        if best:
            counts[best] -= 1
        if best + size < 16:
            counts[best + size] += 1
        assert packer.counts[1:16].tolist() == counts[1:16]


def test_codes_random_access():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(5), rng.integers(0, 50257, 5000), rng.integers(0, 2**32, 3000), np.arange(600)):
        ids = ids.astype(np.uint32)
        segment = Segment(Segment.encode(ids))
        assert (segment.decode() == ids).all()
        places = rng.integers(0, max(1, len(ids)), 500 if len(ids) else 0)
        assert (segment.access(places) == ids[places]).all()


def test_codes_files(spark, make_docs, plain):
    texts = ODD + mixtures(60)
    ids = [7 * (len(texts) - i) for i in range(len(texts) - 1)] + [None]
    docs = make_docs(texts, ids=ids).withColumnRenamed("lang", "part").withColumnRenamed("source", "index")
    segments = spark.read.parquet(write_codes(docs, fresh_folder(spark, "codes"), segment_tokens=50))
    assert segments.count() > 5
    got = {r.doc_id: (r.start, r.n_tokens, zlib.crc32(r.ids)) for r in read_codes(segments).collect()}
    start, want = 0, {}
    for name, text in sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0)):
        code = np.append(plain(text), 2).astype("<u4")
        want[name] = (start, len(code), zlib.crc32(code.tobytes()))
        start += len(code)
    assert got == want


def test_codes_of_nothing(spark, make_docs):
    folder = write_codes(make_docs([]), fresh_folder(spark, "codes"))
    assert read_codes(spark.read.parquet(folder)).count() == 0


def test_transducer_equals_library(make_docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    from sitewright.llm.piece_transducer import PIECE_MODEL, Transducer, encode_pieces

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))
    texts = [t for t in TRICKY + mixtures(200) + ["a" * 50, "!!!!!!???", "=== -----", "1234567", "the.The.THE", "x▁y", "llllosll ssss"] if t]
    machine = Transducer()
    got = [np.frombuffer(code, "<u4").tolist() for code in machine.encode(texts)]
    assert got == model.encode(texts)
    for text, ids in zip(texts, got):
        assert machine.decode(np.array(ids, np.uint32)) == text.replace("▁", " ")
    rows = encode_pieces(make_docs([None, "", "ab c", "ab c"]).withColumnRenamed("lang", "ids")).orderBy("doc_id").collect()
    assert [(r.n_ids, r.decoded) for r in rows] == [(0, ""), (0, ""), (rows[2].n_ids, "ab c"), (rows[2].n_ids, "ab c")]
    assert encode_pieces(make_docs([])).count() == 0
