"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, keyed_rank, text_column_udf

UNDETERMINED = "und"
#: Letters and other signs that count as word characters, such as fractions and circled numbers.
LETTER = re.compile(r"[^\W\d_]")
DIMENSIONS = 1 << 13
#: ASCII bytes that are no lower-case letter count as a space.
PLAIN = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
#: Learning texts are cut to so many characters, and crops of these numbers of bytes calibrate the rejection.
LEARN_CHARS, CROPS = 20_000, (24, 48, 96, 192, 384, 768)
RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("rejected", T.BooleanType(), False),
    ]
)


def term_counts(text: str) -> np.ndarray:
    """Counts of the text's byte trigrams and 4-grams by hashed place; runs of other ASCII count as one space."""
    data = PLAIN[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    data = data[np.append(True, (data[1:] != 32) | (data[:-1] != 32))]
    if len(data) < 4:
        return np.zeros(DIMENSIONS)
    wide = data.astype(np.uint32)
    three = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
    four = three[:-1] | wide[3:] << 24
    codes = np.concatenate([three, four]) * np.uint32(2654435761) >> np.uint32(32 - 13)
    return np.bincount(codes, minlength=DIMENSIONS)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def size_class(counts: np.ndarray) -> int:
    return int(np.log2(1 + counts.sum()))


@dataclass
class LanguageModel:
    """``centroids``: unit rows; ``languages``: of each row; ``floor``: per size class the least accepted cosine."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    floor: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        values = np.log1p(counts) * self.idf
        return values / max(np.sqrt(values @ values), 1e-12)

    def identify(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        out = []
        for text in texts:
            if not self.languages or not has_letter(text):
                out.append((UNDETERMINED, 0.0, True))
                continue
            counts = term_counts(text)
            cosines = self.centroids @ self.vector(counts)
            best = int(cosines.argmax())  # of equal cosines the first language in order
            score = float(min(max(cosines[best], 0.0), 1.0))
            out.append((self.languages[best], score, not score or score < self.floor[min(size_class(counts), len(self.floor) - 1)]))
        return out


def spherical_clusters(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows; starts are spread by taking the row farthest from those taken."""
    picked = [rows.mean(0)]
    for _ in range(k - 1):
        picked.append(rows[np.argmin((rows @ np.array(picked).T).max(1))])
    centres = np.array(picked)
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(1)
        centres = np.array([rows[nearest == j].sum(0) if (nearest == j).any() else centres[j] for j in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit_languages(
    docs: DataFrame,
    per_language: int = 200,
    centroids: int = 3,
    reject: float = 0.4,
    folds: int = 4,
    held_out: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    seed: int = 11,
) -> LanguageModel:
    """Learn from at most ``per_language`` texts of each language (the bound of the sample) outside the held-out fold,
    chosen by a keyed order of ids. A text is rejected when its best cosine is below ``reject`` times the lowest one of
    learning texts, or crops of them, of its size class; texts of under 31 n-grams only at cosine 0. Null languages and texts without a letter teach nothing."""
    usable = docs.select(
        F.col(lang_column).alias("lang"), F.substring(text_column, 1, LEARN_CHARS).alias("text"), F.col(id_column).alias("id")
    ).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold("id", folds) != held_out))
    first = Window.partitionBy("lang").orderBy(keyed_rank("id", seed), "id", "text")
    rows = usable.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_language).collect()
    rows.sort(key=lambda r: (r.lang, r.place))
    counts = [term_counts(r.text) for r in rows]
    if not rows:
        return LanguageModel(np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS)), [], np.zeros(1))
    present = np.sum([c > 0 for c in counts], axis=0)
    model = LanguageModel(np.log((1 + len(rows)) / (1 + present)) + 1, np.zeros((0, DIMENSIONS)), [], np.zeros(1))
    vectors = np.array([model.vector(c) for c in counts])
    blocks = []
    for lang in sorted({r.lang for r in rows}):
        own = vectors[[i for i, r in enumerate(rows) if r.lang == lang]]
        centres = spherical_clusters(own, min(centroids, len(own)))
        blocks.append(centres)
        model.languages += [lang] * len(centres)
    model.centroids = np.vstack(blocks)
    # the accepted distance grows for shorter texts, so it is measured on crops too
    least = np.full(40, np.inf)
    for r in rows:
        of = [j for j, lang in enumerate(model.languages) if lang == r.lang]
        for crop in (r.text, *(r.text[len(r.text) // 3 :][:n] for n in CROPS)):
            c = term_counts(crop)
            if c.any():
                k = size_class(c)
                least[k] = min(least[k], float((model.centroids[of] @ model.vector(c)).max()))
    seen = np.flatnonzero(np.isfinite(least))
    nearest = seen[np.abs(np.arange(40)[:, None] - seen[None]).argmin(1)] if len(seen) else np.arange(40)
    model.floor = np.where(np.arange(40) < max(5, seen.min() if len(seen) else 40), 0.0, reject * least[nearest])
    return model


def language_of(model: LanguageModel, text: Column | str) -> Column:
    """Struct of ``lang_pred``, ``score`` (cosine to the nearest centroid) and ``rejected`` for a whole text. Null
    texts and texts without a letter are ``und`` with score 0, rejected."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def make():
        names = ("lang_pred", "score", "rejected")
        return lambda texts: pa.array([dict(zip(names, found)) for found in model.identify(texts)], kind)

    return text_column_udf(make, RESULT)(text)


def identify_languages(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``lang_pred``, ``score`` and ``rejected``. Null texts and texts without a letter
    are ``und`` with score 0, rejected; repeated rows give a row each, an empty table none; other columns are not read."""
    return docs.select(id_column, language_of(model, text_column).alias("found")).select(id_column, "found.*")
