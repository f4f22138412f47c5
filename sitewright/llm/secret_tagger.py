"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens decoded by Viterbi."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed_rank, text_slices

#: The base patterns (fixed values), and the least length of what counts in a match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "crf")
#: For the choice of learning texts; what it lets through is tagged by the patterns above.
LIKELY = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
#: A token with the white space after it; tokens cover a text.
TOKEN = re.compile(r"(?:[\w+/.-]+|[^\w\s+/.-])\s*|\s+")
OUTSIDE, BEGIN, INSIDE = range(3)
#: How far neighbours are looked at, and words that name a secret.
OFFSETS = (-3, -2, -1, 1)
NAMES = re.compile(r"(?i)passw|secret|token|api_?key|credential|auth|private|bearer|pwd")
CATEGORIES = ("edge", "name", "=", ":", "quote", "mark", "word", "capital", "number", "mixed", "space")
HEX_LETTERS = frozenset("abcdef")
#: Tokens of a learning window, characters of a learning text, tokens that are decoded as one block, tokens known to a worker.
WINDOW, LEARN_CHARS, BLOCK, KEPT_TOKENS = 24, 20_000, 128, 150_000


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) of the fixed patterns, by start, then kind as listed."""
    out = []
    lowered = text.lower()
    if any(word in lowered for word in KEYWORDS):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def category(token: str) -> int:
    if not token:
        return CATEGORIES.index("space")
    if NAMES.search(token) and len(token) < 24:
        name = "name"
    elif token in "=:":
        name = token
    elif token in "\"'`":
        name = "quote"
    elif not any(c.isalnum() for c in token):
        name = "mark"
    elif token.strip(".-").isdecimal():
        name = "number"
    elif any(c.isdigit() for c in token):
        name = "mixed"
    else:
        name = "capital" if token[0].isupper() else "word"
    return CATEGORIES.index(name)


def plain_word(token: str) -> tuple | None:
    """What the features of a word of letters, with or without a full stop, depend on; None for other tokens."""
    stop = token[-1:] == "."
    body = token[:-1] if stop else token
    if not (body.isalpha() and len(body) < 20) or NAMES.search(body):
        return None
    case = "a" if body.islower() else "A" if body.isupper() else "Aa" if body[0].isupper() else "aA"
    return case, len(body), body.isascii(), HEX_LETTERS.issuperset(body), stop


def own_features(token: str) -> list[str]:
    """Shape, length, alphabet and evenness of a token."""
    if word := plain_word(token):
        case, length, ascii_only, hexadecimal, stop = word
        letters = "hex" if hexadecimal else "upper" if case == "A" else "base64" if ascii_only else "other"
        bucket = next(b for b in (1, 3, 5, 8, 12, 16, 19) if length <= b)
        kind = "capital" if case[0] == "A" else "word"
        return [f"shape {case}", f"kind {kind}", f"length {bucket}", f"letters {letters} {bucket}", "entropy word", "turns word", "end ." if stop else "end "]
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"\d", "9", re.sub(r"[^\W\d_a-z]", "A", re.sub(r"[a-z]", "a", token[:64]))))
    kind = CATEGORIES[category(token)]
    length = len(token)
    bucket = next((b for b in (1, 3, 5, 8, 12, 16, 19, 24, 32, 40, 64) if length <= b), 99)
    counts = Counter(token[:256])
    total = sum(counts.values()) or 1
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    if re.fullmatch(r"[0-9a-f]+", token):
        letters = "hex"
    elif re.fullmatch(r"[A-Z0-9]+", token):
        letters = "upper"
    elif re.fullmatch(r"[A-Za-z0-9+/_-]+", token):
        letters = "base64"
    else:
        letters = "other"
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token[:64], token[1:64]))
    return [
        f"shape {shape[:12]}",
        f"kind {kind}",
        f"length {bucket}",
        f"letters {letters} {bucket}",
        f"entropy {round(entropy)} {bucket}",
        f"turns {min(turns, 8)} {letters}",
        f"start {token[:4]}" if kind == "mixed" else f"end {token[-1:] if not token[-1:].isalnum() else ''}",
    ]


def file_features(text: str) -> list[str]:
    """Of the whole text: its size, and whether it looks like code or settings."""
    marks = sum(map(text.count, "={}[]:\"'|"))
    return [f"size {len(text).bit_length()}", f"marks {min(6, round(200 * marks / (len(text) + 1)))}", f"names {bool(NAMES.search(text))}"]


@dataclass
class Tagger:
    """Weights of the field: per feature and label, per offset and category, between labels."""

    own: dict[str, np.ndarray]
    near: np.ndarray  # offset, category, label
    moves: np.ndarray  # from, to
    rows: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray = field(default_factory=lambda: np.zeros((1024, 3)), repr=False)
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(1024, np.int64), repr=False)
    words: dict[tuple, tuple] = field(default_factory=dict, repr=False)

    def score(self, features: list[str]) -> np.ndarray:
        return sum((self.own[f] for f in features if f in self.own), np.zeros(3))

    def known(self, tokens: list[str]) -> np.ndarray:
        """The row of each token in the tables of its own scores and category."""
        if len(self.rows) > KEPT_TOKENS:
            self.rows.clear()
        fresh = [token for token in set(tokens) if token not in self.rows]
        first = len(self.rows)
        if first + len(fresh) > len(self.table):
            room = 2 * (first + len(fresh))
            self.table, self.kinds = np.resize(self.table, (room, 3)), np.resize(self.kinds, room)
        for i, token in enumerate(fresh, first):
            self.rows[token] = i
            self.table[i], self.kinds[i] = self.described(token.rstrip())
        return np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))

    def described(self, core: str) -> tuple[np.ndarray, int]:
        """A token's own score and category; short words that are alike share them."""
        word = plain_word(core)
        if word is None:
            return self.score(own_features(core)), category(core)
        if word not in self.words:
            self.words[word] = self.score(own_features(core)), category(core)
        return self.words[word]


def split_tokens(text: str) -> tuple[list[str], np.ndarray]:
    tokens = TOKEN.findall(text)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    return tokens, np.concatenate([[0], ends])


def best_labels(scores: np.ndarray, moves: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The best labels of several texts' tokens at once, by Viterbi. The tokens are cut into blocks that are followed side
    by side for each label before them; blocks are then joined in order. ``firsts`` are the texts' first tokens: nothing
    leads there from the token before, and a text does not start inside a secret."""
    n = len(scores)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks * BLOCK, 3))
    padded[:n] = scores
    fresh = np.zeros(blocks * BLOCK, bool)
    fresh[firsts] = True
    fresh[n:] = True
    padded = padded.reshape(blocks, BLOCK, 3)
    fresh = fresh.reshape(blocks, BLOCK)
    start = np.array([0.0, 0.0, -1e9])
    # value[block, label before the block, label now]
    value = np.full((blocks, 3, 3), -1e9)
    value[:, range(3), range(3)] = 0
    back = np.empty((BLOCK, blocks, 3, 3), np.int8)
    for t in range(BLOCK):
        reach = value[:, :, :, None] + moves[None, None]
        came = reach.argmax(axis=2)
        best = np.take_along_axis(reach, came[:, :, None], 2)[:, :, 0]
        anew = fresh[:, t]
        if anew.any():
            came[anew] = value[anew].argmax(axis=2)[..., None]
            best[anew] = value[anew].max(axis=2)[..., None] + start
        value = best + padded[:, t][:, None]
        back[t] = came
    # the best way through the blocks in order
    total, entered = np.zeros(3), np.empty((blocks, 3), np.int8)
    total[1:] = -1e9  # the first token is a text's first, so what is before it does not count
    for b in range(blocks):
        reach = total[:, None] + value[b]
        entered[b] = reach.argmax(axis=0)
        total = reach.max(axis=0)
        total = total - total.max()
    last, left = np.empty(blocks, np.int64), np.empty(blocks, np.int64)
    label = int(total.argmax())
    for b in range(blocks - 1, -1, -1):
        last[b], left[b] = label, entered[b, label]
        label = int(left[b])
    out = np.empty((blocks, BLOCK), np.int8)
    here, each = last, np.arange(blocks)
    for t in range(BLOCK - 1, -1, -1):
        out[:, t] = here
        here = back[t, each, left, here]
    return out.ravel()[:n]


def emissions(model: Tagger, texts: list[str]):
    """Tokens of all texts in a row, where they begin, their places in their text, and their scores."""
    parts = [split_tokens(text) for text in texts]
    counts = np.array([len(tokens) for tokens, _ in parts])
    firsts = np.cumsum(counts) - counts
    tokens = list(chain.from_iterable(t for t, _ in parts))
    rows = model.known(tokens)
    kind, scores = model.kinds[rows], model.table[rows]
    text_of = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(tokens)) - firsts[text_of]
    for k, offset in enumerate(OFFSETS):
        there = np.clip(np.arange(len(tokens)) + offset, 0, max(0, len(tokens) - 1))
        inside = (place + offset >= 0) & (place + offset < counts[text_of])
        scores = scores + model.near[k][np.where(inside, kind[there], 0)]
    if len(tokens):
        scores = scores + np.array([model.score(file_features(text)) for text in texts])[text_of]
    return parts, tokens, counts, firsts, scores


def tagged_spans(model: Tagger, texts: list[str]) -> list[list[tuple[int, int]]]:
    """Per text the (start, end) of the runs that the field labels as secrets."""
    parts, tokens, counts, firsts, scores = emissions(model, texts)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not tokens:
        return out
    labels = best_labels(scores, model.moves, firsts[counts > 0])
    begins = np.flatnonzero(labels == BEGIN)
    ends_at = np.append(np.flatnonzero(labels != INSIDE), len(labels))
    text_of = np.repeat(np.arange(len(texts)), counts)
    for i in begins:
        text = int(text_of[i])
        stop = min(int(ends_at[np.searchsorted(ends_at, i, side="right")]), int(firsts[text] + counts[text]))
        ends, local = parts[text][1], i - firsts[text]
        start, end = int(ends[local]), int(ends[stop - firsts[text]])
        out[text].append((start, start + len(texts[text][start:end].rstrip())))
    return out


def learn(texts: list[str], rounds: int = 60, rate: float = 0.3, penalty: float = 1e-3) -> Tagger:
    """Largest penalised likelihood of the labels that the base patterns give to windows of tokens: those around secrets and
    as many evenly spaced others. Forward and backward sums run over all windows side by side."""
    names: dict[str, int] = {}
    own, near, labels = [], [], []
    for text in texts:
        tokens, ends = split_tokens(text)
        if not tokens:
            continue
        truth = np.zeros(len(tokens), np.int64)
        for _, end, _, start in base_spans(text):
            a, b = np.searchsorted(ends, start, side="right") - 1, np.searchsorted(ends, end, side="left")
            if not truth[a:b].any():
                truth[a:b] = INSIDE
                truth[a] = BEGIN
        cores = [t.rstrip() for t in tokens]
        kinds = np.array([category(c) for c in cores])
        hits = np.flatnonzero(truth == BEGIN)
        spaced = np.linspace(0, max(0, len(tokens) - WINDOW), 3).astype(int).tolist()
        whole = [names.setdefault(f, len(names)) for f in file_features(text)]
        for a in {max(0, min(h - WINDOW // 2, len(tokens) - WINDOW)) for h in hits.tolist()[:6]} | set(spaced):
            span = range(a, min(a + WINDOW, len(tokens)))
            own.append([[names.setdefault(f, len(names)) for f in own_features(cores[i])] + whole for i in span])
            near.append([[kinds[i + o] if 0 <= i + o < len(tokens) else 0 for o in OFFSETS] for i in span])
            labels.append(truth[a : a + WINDOW])
    if not labels:
        return Tagger({}, np.zeros((len(OFFSETS), len(CATEGORIES), 3)), np.zeros((3, 3)))
    n, per = len(labels), len(own[0][0])
    ids, kinds = np.full((n, WINDOW, per), len(names)), np.zeros((n, WINDOW, len(OFFSETS)), np.int64)
    truth, live = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), bool)
    for w, (o, k, y) in enumerate(zip(own, near, labels)):
        ids[w, : len(o)], kinds[w, : len(o)], truth[w, : len(y)], live[w, : len(y)] = o, k, y, True
    weights = [np.zeros((len(names) + 1, 3)), np.zeros((len(OFFSETS), len(CATEGORIES), 3)), np.zeros((3, 3))]
    squares = [np.full_like(w, 1e-8) for w in weights]
    for _ in range(rounds):
        scores = weights[0][ids].sum(axis=2)
        for k in range(len(OFFSETS)):
            scores += weights[1][k][kinds[:, :, k]]
        chance, pairs = marginals(scores, weights[2], live)
        wrong = (chance - np.eye(3)[truth]) * live[:, :, None]
        seen = np.zeros((3, 3))
        both = live[:, 1:] & live[:, :-1]
        np.add.at(seen, (truth[:, :-1][both], truth[:, 1:][both]), 1)
        grads = [np.empty_like(weights[0]), np.empty_like(weights[1]), (pairs - seen) / n]
        for y in range(3):
            spread = np.broadcast_to(wrong[:, :, y, None], ids.shape)
            grads[0][:, y] = np.bincount(ids.ravel(), spread.ravel(), len(names) + 1) / n
            for k in range(len(OFFSETS)):
                grads[1][k, :, y] = np.bincount(kinds[:, :, k].ravel(), wrong[:, :, y].ravel(), len(CATEGORIES)) / n
        for w, g, s in zip(weights, grads, squares):
            g += penalty * w
            s += g * g
            w -= rate * g / np.sqrt(s)
    own_weights = {name: weights[0][i] for name, i in names.items() if np.abs(weights[0][i]).max() > 1e-3}
    return Tagger(own_weights, weights[1], weights[2])


def marginals(scores: np.ndarray, moves: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each label at each token of each window, and summed chances of neighbouring labels."""

    def total(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    n, length, _ = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0] + np.array([0, 0, -1e9])
    for t in range(1, length):
        moved = total(forward[:, t - 1][:, :, None] + moves[None], 1) + scores[:, t]
        forward[:, t] = np.where(live[:, t, None], moved, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        moved = total(moves[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None], 2)
        backward[:, t] = np.where(live[:, t + 1, None], moved, backward[:, t + 1])
    whole = total(forward[:, -1], 1)
    chance = np.exp(forward + backward - whole[:, None, None])
    pairs = np.zeros((3, 3))
    for t in range(1, length):
        both = forward[:, t - 1][:, :, None] + moves[None] + (scores[:, t] + backward[:, t])[:, None] - whole[:, None, None]
        pairs += (np.exp(both) * live[:, t, None, None]).sum(axis=0)
    return chance, pairs


def fit_tagger(docs: DataFrame, with_secrets: int = 600, others: int = 300, id_column: str = "doc_id", text_column: str = "text", seed: int = 13) -> Tagger:
    """Learn from at most ``with_secrets`` texts that a base pattern may match and ``others`` of all texts (the bounds of
    the sample), chosen by a keyed order of ids, each cut around its middle to ``LEARN_CHARS``."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    cut = text.substr(F.greatest(F.lit(1), (F.length(text) / 2 - LEARN_CHARS / 2).cast("int")), F.lit(LEARN_CHARS))
    rows = docs.select(F.col(id_column).alias("id"), cut.alias("text"))
    order = [keyed_rank("id", seed), "id", "text"]
    likely = rows.filter(F.col("text").rlike(LIKELY)).orderBy(*order).limit(with_secrets)
    return learn([r.text for r in likely.union(rows.orderBy(*order).limit(others)).collect()])


RESULT = ("n_assign", "n_access", "n_hex", "base_spans", "spans")


def scan_secrets(docs: DataFrame, model: Tagger, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the number of base matches of each kind, ``base_spans`` and ``spans`` (these and
    the runs tagged by the field that overlap none of them), as ``kind:start:end`` in code points, joined by commas, by
    start, then kind as listed.

    Null and empty texts have no spans; repeated rows are scanned alike; an empty table gives no rows; further columns are
    not read. Nothing is shuffled; a text is scanned whole, whatever its length."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, _, texts in text_slices(batch.column(1), 1_500_000):
                for text, found in zip(texts, tagged_spans(model, texts)):
                    base = [s[:3] for s in base_spans(text)]
                    added = [(s, e, "crf") for s, e in found if not any(s < y and x < e for x, y, _ in base)]
                    both = sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))
                    kinds = Counter(k for _, _, k in base)
                    rows.append((kinds["assign"], kinds["access"], kinds["hex"], joined(base), joined(both)))
            columns = list(zip(*rows)) if rows else [()] * len(RESULT)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[id_column, *RESULT])

    kinds = [T.LongType()] * 3 + [T.StringType()] * 2
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), *(T.StructField(n, k) for n, k in zip(RESULT, kinds))])
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)
