"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score into grades:
P(grade > k) = sigmoid(score - threshold_k).  From these come the expected grade and the tail probability
by which documents are selected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import Remembered, boxed

#: Hashed features, and words remembered by a worker.
DIMENSIONS, REMEMBERED = 1 << 18, 120_000
#: Slots in front for word shapes and repetition, which say the same of short and long texts.
SHARES = 1 << 12
#: By so much at least a common word must shift the share of rows above some grade.
LEAST_SHIFT = 0.2
#: Letters of the word beginnings that are features.
BEGINNINGS = (4, 6)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_RUNS = re.compile(r"(.)\1+", re.DOTALL)


def _slot(kind: str, name: str) -> int:
    h = xxh32_intdigest(f"{kind}:{name}".encode("utf-8", "surrogatepass"), 7)
    return h % SHARES if kind in "sr" else SHARES + h % (DIMENSIONS - SHARES)


class _Classes(dict):
    """Letters to a or A, digits to 0, other characters to themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return out


_CLASSES = _Classes()


@lru_cache(maxsize=1 << 15)
def _shape_slot(classes: str) -> int:
    return _slot("s", _RUNS.sub(r"\1", classes)[:8])


def _word_slots(word: str) -> tuple[int, tuple[int, ...], int]:
    """Slots of the bare word, of its beginnings and of its shape."""
    bare = word.lower() if word[:1].isalnum() and word[-1:].isalnum() else _EDGES.sub("", word).lower()
    return _slot("w", bare), tuple([_slot("p", bare[:n]) for n in BEGINNINGS if len(bare) >= n]), _shape_slot(word[:64].translate(_CLASSES))


def _variety(n_words: int, n_distinct: int) -> int:
    """A slot for how often words repeat, by text length."""
    return _slot("r", f"{min(int(np.log2(n_words + 1)), 14)}:{int(10 * n_distinct / max(1, n_words))}")


def features(text: str | None) -> dict[int, float]:
    """Presence of each word, log(1 + times) of each word beginning, share of each word shape (times 8), and a slot for repetition."""
    counts = Counter((text or "").split())
    n = sum(counts.values())
    out: dict[int, float] = {}
    starts: Counter[int] = Counter()
    for word, times in counts.items():
        w, ps, s = _word_slots(word)
        out[w] = 1.0
        for p in ps:
            starts[p] += times
        out[s] = out.get(s, 0.0) + 8.0 * times / n
    for p, times in starts.items():
        out[p] = float(np.log1p(times))
    out[_variety(n, len(counts))] = 1.0
    return out


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and k (columns)."""
        return 1.0 / (1.0 + np.exp(-np.clip(np.asarray(score, float)[:, None] - self.thresholds[None, :], -60, 60)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, grades: np.ndarray, n_grades: int, l2: float = 0.002, least_rows: int = 5, least_z: float = 5.0, most_share: float = 1.0, steps: int = 300, rate: float = 0.1, balance: float = 0.0) -> OrdinalModel:
    """Fit to the features (row, col, val) and grades, by Adam on the mean negative log-likelihood plus an L2 term.  Features in fewer than ``least_rows`` rows, or
    within ``least_z`` standard deviations of chance, get no weight, nor do words and beginnings in over ``most_share`` of all rows
    that hardly shift the grades' shares: added up over a long text they would drown the few words that tell.  ``balance`` 1 weighs grades alike, 0 weighs rows alike.
    """
    y = np.asarray(grades, np.int64)
    # Screening: of the many rare words only those stay whose rows' grades differ from the rest beyond chance.
    n = np.bincount(col, minlength=DIMENSIONS)
    strongest, shift = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for k in range(n_grades - 1):
        p = float(np.mean(y > k))
        if 0 < p < 1:
            ups = np.bincount(col, (y > k)[row], minlength=DIMENSIONS)
            strongest = np.maximum(strongest, np.abs(ups - n * p) / np.sqrt(np.maximum(n, 1) * p * (1 - p)))
            shift = np.maximum(shift, np.abs(ups / np.maximum(n, 1) - p))
    common = (n > most_share * len(y)) & (shift < LEAST_SHIFT) & (np.arange(DIMENSIONS) >= SHARES)
    keep = ((n >= least_rows) & (strongest >= least_z) & ~common)[col]
    row, col, val = row[keep], col[keep], val[keep]
    used, col = np.unique(col, return_inverse=True)
    per = np.bincount(y, minlength=n_grades)
    weight = ((len(y) / max(1, np.count_nonzero(per)) / np.maximum(per, 1)) ** balance)[y] / len(y)
    # Thresholds are a first one and positive gaps, so they stay ordered.
    w, cut = np.zeros(len(used)), np.concatenate([[-1.0], np.full(n_grades - 2, 0.5)])
    m, v = np.zeros(len(w) + len(cut)), np.zeros(len(w) + len(cut))
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))
        score = np.bincount(row, val * w[col], minlength=len(y))
        up = 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - theta[None, :], -40, 40)))  # P(y > k)
        tail = np.column_stack([np.ones(len(y)), up, np.zeros(len(y))])
        slope = tail * (1 - tail)
        at = np.arange(len(y))
        p = np.maximum(tail[at, y] - tail[at, y + 1], 1e-12)
        d_score = -weight * (slope[at, y] - slope[at, y + 1]) / p
        d_theta = np.zeros(n_grades + 1)
        np.add.at(d_theta, y, weight * slope[at, y] / p)
        np.add.at(d_theta, y + 1, -weight * slope[at, y + 1] / p)
        d_theta = d_theta[1:-1]
        d_cut = np.cumsum(d_theta[::-1])[::-1].copy()
        d_cut[1:] *= np.exp(cut[1:])
        grad = np.concatenate([np.bincount(col, val * d_score[row], minlength=len(w)) + l2 * w / len(w) ** 0.5, d_cut])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, cut = w - move[: len(w)], cut - move[len(w) :]
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = w
    return OrdinalModel(weights, np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])])))


def grade_of(quality: Column, toxic: Column) -> Column:
    """Ratings as grades: 0 poor, 1 good but toxic, 2 good and clean; null where either rating is missing."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(quality == 0, 0).when(toxic == 1, 1).otherwise(2).cast("int")


def labelled_sample(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (row, col, val) and grades of at most ``rows`` labelled documents, chosen by a hash of their ids."""
    chosen = ratings.filter("grade IS NOT NULL AND rated_id IS NOT NULL").orderBy(F.xxhash64("rated_id", F.lit(seed)), "rated_id", "grade").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):  # features take far more memory than texts
                part = b.slice(at, 100)
                found = [features(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32())), part.column(2)], ["grade", "slots", "vals", "rated_id"])

    two = docs.select(F.col(f"`{id_col}`").alias("rated_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    own = two.join(F.broadcast(chosen), "rated_id").select("grade", "t", F.col("rated_id").cast("long").alias("rated_id"))
    got = own.mapInArrow(run, "grade int, slots array<int>, vals array<float>, rated_id bigint").orderBy("rated_id", "grade").toArrow()
    if not got.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    slots, vals = got.column(1).combine_chunks(), got.column(2).combine_chunks()
    row = np.repeat(np.arange(got.num_rows), slots.value_lengths().to_numpy(zero_copy_only=False))
    return row, slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64), vals.flatten().to_numpy(zero_copy_only=False).astype(float), got.column(0).to_numpy().astype(np.int64)


def score_quality(
    docs: DataFrame,
    ratings: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_grades: int = 3,
    train_rows: int = 8000,
    seed: int = 5,
    keep_above: int = 1,
    keep_probability: float = 0.5,
    most_share: float = 0.1,
    balance: float = 0.5,
) -> DataFrame:
    """Every row of ``docs`` as ``_row``, with ``expected_grade, tail_probability, kept``.

    ``ratings`` has rated_id and grade (0 to n_grades - 1).  The model is fitted on at most ``train_rows`` of them (the bound of the
    sample, of which the driver holds the features); every document is scored on its whole text.  ``tail_probability`` is P(grade > keep_above); rows with at least
    ``keep_probability`` are kept.  Null texts count as empty and are scored like any other.  Ratings without a grade or without a document are
    ignored; an id rated twice counts twice.  Without ratings of at least two grades nothing can be learned: all rows are kept, with null scores.
    An empty table gives an empty result; extra columns travel inside ``_row``.
    """
    row, col, val, grades = labelled_sample(docs, ratings, id_col, text_col, train_rows, seed)
    base = boxed(docs)
    if len(np.unique(grades)) < 2:
        null = F.lit(None).cast("double")
        return base.select("_row", null.alias("expected_grade"), null.alias("tail_probability"), F.lit(True).alias("kept"))
    model = fit_ordinal(row, col, val, grades, n_grades, most_share=most_share, balance=balance)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the input

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = sent.value.weights
        # Most words have no weight: remember those slots of a word that have one, and the weight of its shape; equal answers are one object.
        known, forms = Remembered(REMEMBERED), {}

        def look_up(word: str) -> tuple[tuple[int, ...], tuple[int, ...], float]:
            w, ps, s = _word_slots(word)
            got = ((w,) if weights[w] else (), tuple(x for x in ps if weights[x]), float(weights[s]))
            if len(word) <= 64:
                got = forms.setdefault(got, got)
                known.keep(word, got)
            return got

        def one(text: str | None) -> float:
            counts = Counter((text or "").split())
            n = sum(counts.values())
            present: set[int] = set()
            starts: Counter[int] = Counter()
            shapes = 0.0
            for word, times in counts.items():
                found, begun, shape = known[word] or look_up(word)
                if found:
                    present.update(found)
                for x in begun:
                    starts[x] += times
                shapes += times * shape
            total = float(sum(weights[x] for x in sorted(present))) + float(sum(weights[x] * np.log1p(k) for x, k in sorted(starts.items())))
            return total + 8.0 * shapes / max(1, n) + float(weights[_variety(n, len(counts))])

        for batch in texts:
            yield pa.array([one(t) for at in range(0, len(batch), 256) for t in batch.slice(at, 256).to_pylist()], pa.float64())

    cuts = [float(x) for x in model.thresholds]
    scored = base.withColumn("_score", score(F.col("_row").getField(text_col).cast("string")))
    above = [1 / (1 + F.exp(F.lit(c) - F.col("_score"))) for c in cuts]
    expected = sum(above[1:], above[0])
    return scored.select("_row", expected.alias("expected_grade"), above[keep_above].alias("tail_probability"), (above[keep_above] >= keep_probability).alias("kept"))
