"""Encoding and decoding by a weighted finite-state transducer over the pieces of a public vocabulary."""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices

#: The default vocabulary's file name, the sign for a blank, and what is kept by a worker (parts in two generations).
PIECE_MODEL = "piece_bpe_32k.model"
BLANK = "▁"
KEPT_PARTS, KEPT_PAIRS = 175_000, 400_000
FALLBACK, FALLBACK_COST = -1, 1e9


class Transducer:
    """Text to piece ids as a shortest path in the tropical semiring (weights add along a path, the least path wins).

    It is the composition of three machines, compiled once:
    the normaliser (a blank goes to its sign, one is put before the text, every other character to itself);
    the lexicon (a piece's characters to its id, at the cost of its rank; a character that is in no piece to its bytes' ids);
    and the acceptor of neighbouring pieces. In a vocabulary built by merges two pieces may stand side by side only if the
    merges, taken in their order, would not have joined across them sooner; other pairs weigh infinity. With it each prefix
    of an input has one piece of finite weight to end in, so the composed machine is followed with one state per
    position, and the least path is the only one."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECE_MODEL))
        size = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.cost = {i: -model.get_score(i) for i in plain}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.value = {i: b for b, i in self.bytes.items()}
        # the lexicon as states: every beginning of a piece, with the id that is complete there or -1
        self.lexicon = {p[:k]: self.ids.get(p[:k], -1) for p in self.ids for k in range(1, len(p) + 1)}
        self.split = self.last_merges()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # an input may be cut where no piece has the two characters side by side
        marks = [m for m in ".,;:!?" if not any(b[1] == m and b[0] != m and b[0].isalpha() for b in inner)]
        blanks = BLANK if not any(b[1] == BLANK and b[0] != BLANK for b in inner) else ""
        self.parts = re.compile(f"{blanks}*[^{blanks}\n]+|{blanks}+|\n" if blanks else r"[^\n]+|\n")
        self.marks = set(marks)

    def last_merges(self) -> dict[int, tuple[int, int] | None]:
        """The two pieces that were joined last to make a piece, when its own characters are merged in rank order; None
        for single characters."""
        out: dict[int, tuple[int, int] | None] = {}
        for text, i in self.ids.items():
            symbols = list(text)
            made = None
            while len(symbols) > 1:
                best = min(
                    ((self.cost.get(self.ids.get(a + b, -1), np.inf), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))),
                    default=(np.inf, 0),
                )
                if best[0] == np.inf:
                    break
                k = best[1]
                made = (symbols[k], symbols[k + 1])
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            out[i] = (self.ids[made[0]], self.ids[made[1]]) if len(symbols) == 1 and made else None
        return out

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the acceptor lets ``right`` stand after ``left``: going back in time, the piece of the two that was made
        later is parted into what it was made of; had what then faces each other across the border a merge that came before
        the parted one, it would have been taken."""
        if left == FALLBACK or right == FALLBACK:
            return True
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._may_follow(left, right)
        return found

    def _may_follow(self, left: int, right: int) -> bool:
        text, ids, cost, split = self.text, self.ids, self.cost, self.split
        # a merge across the border had to come before these: the merges that used its left and its right side
        until = np.inf
        while True:
            joined = ids.get(text[left] + text[right])
            # of equal ranks the leftmost goes first, so a merge within the left piece wins a tie, one in the right loses it
            if joined is not None and (cost[joined] < until or (cost[joined] == until and tie)):
                return False
            a, b = split[left], split[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and cost[left] > cost[right]):
                until, tie, left = cost[left], False, a[1]
            else:
                until, tie, right = cost[right], True, b[0]

    def shortest_path(self, part: str) -> list[int]:
        """The ids along the least path of a normalised input through the composed machine."""
        lexicon, cost, may_follow = self.lexicon, self.cost, self.may_follow
        n = len(part)
        weight, ended, begun = [0.0] + [np.inf] * n, [FALLBACK] * (n + 1), [0] * (n + 1)
        for begin in range(n):
            before, so_far = ended[begin], weight[begin]
            if lexicon.get(part[begin], -1) < 0 and weight[begin + 1] == np.inf:
                weight[begin + 1], ended[begin + 1], begun[begin + 1] = so_far + FALLBACK_COST, FALLBACK, begin
            for end in range(begin + 1, n + 1):
                piece = lexicon.get(part[begin:end])
                if piece is None:
                    break  # no piece starts so
                # the acceptor leaves a position one piece to end in: the first that it lets through
                if piece >= 0 and weight[end] == np.inf and (before == FALLBACK or may_follow(before, piece)):
                    weight[end], ended[end], begun[end] = so_far + cost[piece], piece, begin
        if n and weight[n] == np.inf:
            raise ValueError(f"no path of finite weight for {part!r}")
        out: list[int] = []
        while n:
            if ended[n] == FALLBACK:
                out += [self.bytes[b] for b in reversed(part[begun[n] : n].encode())]
            else:
                out.append(ended[n])
            n = begun[n]
        return out[::-1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers; an empty text has none."""
        parts = [self.parts.findall((" " + text).replace(" ", BLANK)) if text else [] for text in texts]
        if len(self.known) > KEPT_PARTS:
            self.known, self.older = {}, self.known
        for part in set(chain.from_iterable(parts)).difference(self.known):
            self.look_up(part)
        return [b"".join(map(self.known.__getitem__, row)) for row in parts]

    def look_up(self, part: str) -> bytes:
        """The ids of a part; one that ends in a mark is cut before it where that is exact."""
        ids = self.known.get(part) or self.older.get(part)
        if ids is None:
            if part[-1] in self.marks and part[-2:-1].isalpha():
                ids = self.look_up(part[:-1]) + self.look_up(part[-1])
            else:
                ids = np.array(self.shortest_path(part), "<u4").tobytes()
        self.known[part] = ids
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """The inverse machine: pieces to their characters, byte ids to bytes, signs to blanks, without the first blank."""
        out = bytearray()
        for i in ids.tolist():
            byte = self.value.get(i)
            if byte is None:
                out += self.text[i].encode()
            else:
                out.append(byte)
        return out.decode("utf-8", "replace").replace(BLANK, " ")[1:]


@cache
def transducer(path: str | None = None) -> Transducer:
    """The compiled machine of this worker process."""
    return Transducer(path)


def encode_pieces(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_ids``, ``ids`` (little-endian unsigned 32-bit) and ``decoded``.

    Null and empty texts have no ids and decode to an empty text; the sign for a blank in a text decodes to a blank, as
    the vocabulary has it; every other text comes back as it was. Repeated rows are encoded alike; an empty table gives no
    rows; further columns are not read. Nothing is shuffled."""

    def run(batches):
        machine = transducer(vocabulary)
        for batch in batches:
            codes = [code for _, _, texts in text_slices(batch.column(1), 2_000_000) for code in machine.encode(texts)]
            back = [machine.decode(np.frombuffer(code, "<u4")) for code in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array(codes, pa.binary()), pa.array(back, pa.string())],
                names=[id_column, "n_ids", "ids", "decoded"],
            )

    fields = [(id_column, docs.schema[id_column].dataType), ("n_ids", T.LongType()), ("ids", T.BinaryType()), ("decoded", T.StringType())]
    return docs.select(id_column, text_column).mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))
