"""Language identification with string kernels.

The kernel of two texts is the number of character 1- to 3-grams present in both, over the geometric mean
of their own numbers (a normalised blended-spectrum presence kernel). A bounded sample of labelled rows is
learned from: some of them are Nystroem landmarks, the rest are mapped to them, and one ridge regression for
each language separates it from the others. Because the kernel is linear in presence, landmarks, Nystroem
map and regressions fold into one matrix with a row for each n-gram of the landmarks and a column for each
language, and a batch of texts is scored by one product with its presence matrix.

Scores add up to 1 over the languages, so the best one says nothing about texts in none of them. The share of a
text's 3-grams that the landmarks hold does: a text fits if it has LEAST_PART of what 99 of 100 learned rows that are no
landmarks have.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from quillon.llm.blocks import carried, judged, remainder, trimmed

SIZES, FIT_ROWS, MOST_FIT_ROWS, LANDMARKS, FIT_CHARS, RIDGE = 3, 200, 20_000, 30, 20_000, 1e-2
MOST_CELLS = 1 << 26
LEAST_PART, LEAST_QUANTILE, THIRD = 0.85, 0.01, 1 << 42
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """For every code point, whether it is a letter; made once in a worker."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str, letter: np.ndarray, sizes: int = SIZES) -> np.ndarray | None:
    """Distinct n-grams of the lower-cased text, other characters as one space; None without a letter."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    good = letter[code]
    if not good.any():
        return None
    code = np.where(good, code, 32)
    found, gram = [np.unique(code)], code
    for n in range(1, sizes):
        gram = (gram[:-1] << 21) | code[n:]
        found.append(np.unique(gram))
    return np.concatenate(found)


class Landmarks:
    """The n-grams of the landmarks, each with the landmarks that hold it."""

    def __init__(self, rows: list[np.ndarray]):
        gram = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        order = np.argsort(gram, kind="stable")
        self.n, self.owner = len(rows), owner[order]
        self.vocabulary, self.start = np.unique(gram[order], return_index=True)
        self.size = np.diff(np.r_[self.start, len(gram)])

    def shared(self, grams: np.ndarray) -> np.ndarray:
        """Number of n-grams in common with each landmark."""
        at = np.searchsorted(self.vocabulary, grams)
        at[at == len(self.vocabulary)] = 0
        at = at[self.vocabulary[at] == grams]
        size = self.size[at]
        places = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owner[places], minlength=self.n)

    def folded(self, weights: np.ndarray, step: int = 1 << 14) -> np.ndarray:
        """For each n-gram the sum of the rows of weights of its landmarks."""
        out = np.empty((len(self.vocabulary), weights.shape[1]), np.float32)
        for i in range(0, len(out), step):
            j = min(len(out), i + step)
            low, high = self.start[i], self.start[j - 1] + self.size[j - 1]
            out[i:j] = np.add.reduceat(weights[self.owner[low:high]], self.start[i:j] - low)
        return out


def fitted(texts: list[str], langs: list[str], landmarks: int, ridge: float = RIDGE, sizes: int = SIZES, cells: int = MOST_CELLS) -> dict:
    """Learn from rows in a fixed order; of each language the first `landmarks` rows become landmarks, fewer where
    n-grams times languages would be more than `cells`, the bound of what is broadcast."""
    letter = letters()
    rows = [(g, lang) for t, lang in zip(texts, langs) if (g := ngrams(t, letter, sizes)) is not None]
    if not rows:
        return {"names": [], "vocabulary": np.zeros(1, np.int64), "matrix": np.zeros((1, 1), np.float32), "base": np.zeros(0), "least": 0.0, "sizes": sizes}
    names = sorted({lang for _, lang in rows})
    while True:
        seen: dict[str, int] = {}
        marks = []
        for i, (_, lang) in enumerate(rows):
            seen[lang] = seen.get(lang, 0) + 1
            if seen[lang] <= landmarks:
                marks.append(i)
        held = Landmarks([rows[i][0] for i in marks])
        if len(held.vocabulary) * (len(names) + 1) <= cells:
            break
        if landmarks == 1:
            raise ValueError(f"{len(names)} languages with {len(held.vocabulary)} n-grams are more than {cells} cells hold")
        landmarks = (landmarks + 1) // 2
    scale = np.sqrt([len(g) for g, _ in rows])
    kernel = np.stack([held.shared(g) for g, _ in rows]) / scale[:, None] / scale[marks]
    value, vector = np.linalg.eigh(kernel[marks])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    mapped = kernel @ root
    target = np.array([[lang == name for name in names] for _, lang in rows], np.float64)
    weight = 1 / np.sqrt(target.sum(0)[target.argmax(1)])[:, None]
    base = (target * weight**2).sum(0) / (weight**2).sum()
    left = (mapped * weight).T @ (mapped * weight)
    solved = np.linalg.solve(left + ridge * np.eye(len(left)), (mapped * weight).T @ ((target - base) * weight))
    # the last column counts the known 3-grams
    long = held.vocabulary >= THIRD
    matrix = np.column_stack([held.folded((root @ solved) / scale[marks][:, None]), long]).astype(np.float32)
    apart = [rows[i][0] for i in sorted(set(range(len(rows))) - set(marks))]
    known = [np.isin(g[g >= THIRD], held.vocabulary).mean() for g in apart if (g >= THIRD).any()]
    least = LEAST_PART * float(np.quantile(known, LEAST_QUANTILE)) if known else 0.0
    return {"names": names, "vocabulary": held.vocabulary, "matrix": matrix, "base": base, "least": least, "sizes": sizes}


def presence(rows: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, grams in enumerate(rows):
        at = np.searchsorted(vocabulary, grams)
        at[at == len(vocabulary)] = 0
        out[i, at[vocabulary[at] == grams]] = 1
    return out


FOUND = "lang_pred string, score double, fits boolean"
CELLS = 1 << 24


def predicted(model, carry: list[str]):
    def judge(texts: list[bytes]) -> list[tuple]:
        m, letter = model.value, letters()
        rows = [ngrams(t.decode(), letter, m["sizes"]) for t in texts]
        langs, scores, fits = [UNKNOWN] * len(rows), np.zeros(len(rows)), np.zeros(len(rows), bool)
        some = [i for i, g in enumerate(rows) if g is not None] if m["names"] else []
        batch = max(1, min(128, CELLS // len(m["vocabulary"])))
        for j in range(0, len(some), batch):
            part = some[j : j + batch]
            size = np.sqrt([len(rows[i]) for i in part])[:, None]
            sums = presence([rows[i] for i in part], m["vocabulary"]) @ m["matrix"]
            got = sums[:, :-1] / size + m["base"]
            fits[part] = sums[:, -1] >= m["least"] * np.array([(rows[i] >= THIRD).sum() for i in part])
            scores[part] = np.clip(got.max(1), 0, 1)
            for i, b in zip(part, got.argmax(1)):
                langs[i] = m["names"][b]
        return list(zip(langs, scores, fits))

    return judged(judge, carry, [pa.string(), pa.float64(), pa.bool_()], ["lang_pred", "score", "fits"])


def sample(labelled: DataFrame, fit_rows: int, most: int, longest: int) -> list[tuple[str, str]]:
    """(text, lang) of at most fit_rows rows of each language and `most` in all, in the order of a hash of doc_id; texts
    of more than `longest` characters, shortest first, only where a language has no others."""
    count = labelled.select("lang").distinct().count()
    if count > most:
        raise ValueError(f"{count} languages are more than {most} rows can show")
    each = max(1, min(fit_rows, most // max(1, count)))
    order = [F.greatest(F.length("text"), F.lit(longest)), F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ids = labelled.select("doc_id", "lang", F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    first = Window.partitionBy("lang").orderBy(F.greatest("n", F.lit(longest)), F.xxhash64("doc_id"), "doc_id", "h")
    chosen = ids.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= each).select("doc_id").distinct()
    # ids are at most `most` rows; ids that repeat are cut once more where the texts are at hand
    rows = labelled.join(F.broadcast(chosen), labelled.doc_id.eqNullSafe(chosen.doc_id), "left_semi").withColumn("r", place).filter(F.col("r") <= each)
    found = rows.select(F.xxhash64("doc_id").alias("k"), "text", "lang").collect()
    return [(r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["k"], r["text"], r["lang"]))]


def languages(docs: DataFrame, train: F.Column, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS, most: int = MOST_FIT_ROWS, longest: int = FIT_CHARS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Predict the language of each whole text: the columns `carry` of docs, lang_pred, score (0 to 1), fits (whether its
    3-grams are those of the learned languages).

    Learns from text and lang of at most `fit_rows` rows of each language where `train` holds (fewer where
    there are more than most / fit_rows languages; more than `most` languages are an error). Null text and text without
    a letter give `und`, 0 and false, as does everything if nothing could be learned. Of languages with equal
    scores the first by name is given. Rows repeat as they come; other columns are ignored.
    """
    labelled = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = sample(labelled, fit_rows, most, longest)
    model = docs.sparkSession.sparkContext.broadcast(fitted([t for t, _ in rows], [lang for _, lang in rows], landmarks))
    given = docs.select(*dict.fromkeys([*carry, "text"]))
    return given.mapInArrow(trimmed(predicted(model, list(carry))), carried(given, list(carry), FOUND))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score. Edge cases as in languages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = remainder("doc_id", 4) == 2
    return languages(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")
