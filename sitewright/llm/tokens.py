"""Token ids of whole texts by a public byte-level vocabulary."""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The default vocabulary's file name; a folder-independent path is looked up on the executor.
BYTE_BPE = "byte_bpe_50k.json"
#: Characters with the Unicode property White_Space (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space with what follows it. The vocabulary's own pre-splitting never joins a character and the white
#: space after it, so a text's ids are the ids of these parts in order.
PART = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Stand for a line end, and before a mark that ends a word, while a text is split at blanks.
MARK, JOINED = "\x01", "\x02"
#: A text with this is split by ``PART``: white space before a blank or line end, or one of the two signs.
UNEVEN = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n]|\x01|\x02"
#: What a part that can stand within a text begins with.
BLANKS = (" ", "\n")
#: A letter and a mark after it never share an id, so a mark that ends a word is a part of its own.
CLOSING = r"(\pL)([.,;:!?])( |$)"
#: Such parts encoded by one call.
GROUP = 64
#: Parts that a worker keeps, in each of two generations.
KEPT_PARTS = 175_000


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE)


@cache
def encoder(path: str | None = None) -> Encoder:
    """The encoder of this worker process: later tasks in it find the vocabulary loaded and common parts encoded."""
    return Encoder(path)


class Encoder:
    """Encodes texts with the tokenizers library; parts that return often are encoded once per worker."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # every character of a token of this vocabulary stands for one byte
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT_PARTS:
            self.known, self.older = {}, self.known
        column = pa.array(texts, pa.string())
        plain = pc.invert(pc.match_substring_regex(column, UNEVEN)).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        even = np.flatnonzero(plain)
        for i, ids in zip(even, self.even(column.take(pa.array(even)))):
            out[i] = ids
        for i in np.flatnonzero(~plain):
            parts = PART.findall(texts[i])
            out[i] = b"".join(self.look_up(parts))
        return out

    def even(self, column: pa.Array) -> list[bytes]:
        """Texts in which every white space that is a blank or line end stands alone: the columns of Arrow split them at
        those, number the distinct parts, and the parts' ids are laid out by number."""
        if not len(column):
            return []
        lines = pc.replace_substring(column, "\n", f" {MARK}")
        split = pc.split_pattern(pc.replace_substring_regex(lines, CLOSING, f"\\1 {JOINED}\\2\\3"), " ")
        counts = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        numbers, values = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        opening = [values[n] for n in numbers[firsts]]
        parts = [f" {v}" if v[:1] > JOINED else f"\n{v[1:]}" if v[:1] == MARK else v[1:] if v[:1] == JOINED else f" {v}" for v in values]
        # a text's first part has no blank before it; one that starts with a line end is an empty part and another
        numbers[firsts] = np.arange(len(parts), len(parts) + len(firsts))
        parts += opening
        ids = self.look_up(parts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        table = np.frombuffer(b"".join(ids), "<u4")
        lengths = sizes[numbers]
        ends = np.cumsum(lengths)
        laid = table[np.arange(ends[-1]) + np.repeat(starts[numbers] - (ends - lengths), lengths)]
        bounds = np.concatenate([[0], ends[firsts + counts - 1]])
        return [laid[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def look_up(self, parts: list[str]) -> list[bytes]:
        """The ids of parts, encoding those not known."""
        known, older = self.known, self.older
        out = list(map(known.get, parts))
        places = [i for i, ids in enumerate(out) if ids is None]
        need = {parts[i] for i in places}
        known.update((part, older[part]) for part in need if part in older)
        need = need.difference(older)
        inner = [part for part in need if part[:1] in BLANKS and not part[-1].isspace()]
        self.learn(inner, GROUP)
        self.learn(list(need.difference(inner)), 1)
        for i in places:
            out[i] = known[parts[i]]
        return out

    def learn(self, parts: list[str], group: int) -> None:
        """Encode parts, ``group`` of them at once: what begins with white space and ends without may follow another part
        in one text. Where a part's ids end is told by the number of bytes that each id stands for."""
        joined = ["".join(parts[a : a + group]) for a in range(0, len(parts), group)]
        encoded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(e.ids for e in encoded)), "<u4")
        ends = np.cumsum([len(part.encode()) for part in parts])
        bounds = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right").tolist()
        data, at = ids.tobytes(), 0
        for part, bound in zip(parts, bounds):
            self.known[part] = data[4 * at : 4 * bound]
            at = bound
