"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (poor), 1 (readable but toxic) and 2 (good). One weight vector over hashed
features of the text is shared by all grades; ordered thresholds t0 < t1 on its score s
give P(grade <= k) = 1 / (1 + exp(s - t_k)), so every text gets an expected grade and
the probability of each tail. Features are the presence of words and the shares of
words with some shape (marks behind them, capitals, repeats).

The weights are fitted on a bounded sample: the SAMPLE_ROWS labelled rows whose hashed
ids are smallest, of which the driver gets the features that enough of them have. All documents are scored, whole texts each.

Defined cases: null text counts as empty and is scored like any text; a null id is
carried along and never in the sample; of several ratings of one document the lowest
counts, null ratings do not; repeated rows are scored each; without ratings of at least
two grades nothing is rejected and the probabilities are those of the ratings seen;
extra columns are ignored by :func:`graded` and kept by :func:`selected`.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, give_back, trimmed, written

SAMPLE_ROWS = 8_000
BUCKETS = 1 << 18
GRADES = 3
#: Least probability of the highest grade for a document to stay.
KEEP_FROM = 0.5
ROUNDS = 200
STEP = 0.05
RIDGE = 3e-3
#: Documents in the sample that a feature must have. The ridge penalty holds rare features down, not a
#: higher cut, which would drop the toxic words of the smaller languages.
LEAST_DOCS = 3
#: Documents of the sample whose share is added to both sides of a feature's log ratios.
SMOOTH = 2.0
#: Rows whose features are multiplied in one go.
BLOCK_ROWS = 500
#: Weight of a share against a word's presence.
SHARE = 20.0
#: Letters of a word's beginnings, which are features too.
STARTS = (4, 6)
#: Words whose buckets a worker remembers.
REMEMBERED = 50_000


class Features:
    """Buckets and values of a text's features."""

    def __init__(self):
        self.known: dict[str, tuple[tuple[int, ...], tuple[str, ...]]] = {}

    def _word(self, w: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
        """Buckets and shapes of one word, remembered for the next time."""
        core = w.strip(punctuation)
        low = core.lower()
        names = [low, *(f"start: {low[:k]}" for k in STARTS if len(low) > k)]
        shapes = []
        if marks := w[len(w.rstrip(punctuation)) :]:
            shapes.append("marks " + marks[:4])
        if not core:
            shapes.append("bare")
        elif len(core) > 1 and core.isupper():
            shapes.append("capitals")
        if any(c.isdigit() for c in core):
            shapes.append("digits")
        if len(self.known) > REMEMBERED:
            self.known.clear()
        got = self.known[w] = tuple(map(_bucket, names)), tuple(shapes)
        return got

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        counts, shapes, known = Counter(words), Counter(), self.known
        buckets: set[int] = set()
        for w, n in counts.items():
            own, shaped = known.get(w) or self._word(w)
            buckets.update(own)
            for x in shaped:
                shapes[x] += n
        shapes["again"] = sum(map(eq, words, words[1:]))
        shapes["repeats"] = len(words) - len(counts)
        shapes["most"] = max(counts.values())
        extra = [(_bucket(f"share: {k}"), SHARE * n / len(words)) for k, n in shapes.items() if n]
        idx = np.array([*sorted(buckets), *(b for b, _ in extra)], np.int64)
        return idx, np.array([1.0] * len(buckets) + [v for _, v in extra])


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _telling(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> np.ndarray:
    """For each bucket the square of the largest log ratio, either way, of its shares of documents above and below a threshold.

    Values are scaled by it, so the penalty weighs less on words that tell grades apart, in however few documents.
    """
    by_grade = np.zeros((GRADES, BUCKETS))
    for g in range(GRADES):
        for i in (i for (i, _), x in zip(rows, grades.tolist(), strict=True) if x == g):
            by_grade[g][i] += 1  # a row has a bucket once, but for clashes of shares with words
    n, out = np.bincount(grades, minlength=GRADES), np.zeros(BUCKETS)
    for k in range(1, GRADES):
        if 0 < n[:k].sum() < len(grades):
            below, above = by_grade[:k].sum(axis=0) / n[:k].sum(), by_grade[k:].sum(axis=0) / n[k:].sum()
            out = np.maximum(out, np.abs(np.log((above + SMOOTH / len(grades)) / (below + SMOOTH / len(grades)))))
    return out * out


def _block(rows: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, place and scaled value of the used features of some rows, and the number of rows."""
    idx = place[np.concatenate([i for i, _ in rows])]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i, _ in rows])
    stay = idx >= 0
    idx, val = idx[stay], np.concatenate([v for _, v in rows])[stay]
    return row[stay], idx, (val * scale[idx]).astype(np.float32), len(rows)


class Ordinal:
    """Cumulative-link model: weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, one column each."""
        return _sigmoid(scores[:, None] - self.thresholds)

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> Ordinal:
        """Adam on the mean negative log-likelihood with a ridge penalty, all rows at each step."""
        share = (np.bincount(grades, minlength=GRADES) + 0.5) / (len(grades) + 0.5 * GRADES)
        below = np.cumsum(share)[:-1]
        thresholds = np.log(below / (1 - below))
        weights = np.zeros(BUCKETS)
        if len(set(grades.tolist())) < 2:
            return cls(weights, thresholds)
        docs = np.zeros(BUCKETS, np.int32)
        for i, _ in rows:
            docs[i] += 1
        used = np.flatnonzero(docs >= LEAST_DOCS)
        scale = _telling(rows, grades)[used]
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used))
        blocks = [_block(rows[at : at + BLOCK_ROWS], place, scale) for at in range(0, len(rows), BLOCK_ROWS)]
        #  Parameters: the used weights, the first threshold, the logarithms of the gaps.
        gaps = np.log(np.maximum(np.diff(thresholds), 1e-3))
        p = np.concatenate([np.zeros(len(used)), thresholds[:1], gaps])
        m, v2 = np.zeros_like(p), np.zeros_like(p)
        n, k = len(rows), len(used)
        for t in range(1, ROUNDS + 1):
            w, cut = p[:k], np.cumsum(np.concatenate([p[k : k + 1], np.exp(p[k + 1 :])]))
            s = np.concatenate([np.bincount(row, w[idx] * val, size) for row, idx, val, size in blocks])
            edge = np.concatenate([[-np.inf], cut, [np.inf]])
            a, b = _sigmoid(edge[grades + 1] - s), _sigmoid(edge[grades] - s)
            ds = (1 - a - b) / n
            prob = np.maximum(a - b, 1e-12)
            hi, lo = -a * (1 - a) / prob / n, b * (1 - b) / prob / n
            dcut = np.bincount(grades, hi, GRADES)[: GRADES - 1] + np.bincount(grades, lo, GRADES)[1:]
            later = np.cumsum(dcut[::-1])[::-1]
            own = RIDGE * w
            for at, (row, idx, val, size) in enumerate(blocks):
                own += np.bincount(idx, ds[at * BLOCK_ROWS : at * BLOCK_ROWS + size][row] * val, k)
            g = np.concatenate([own, later[:1], later[1:] * np.exp(p[k + 1 :])])
            m, v2 = 0.9 * m + 0.1 * g, 0.999 * v2 + 0.001 * g * g
            p = p - STEP * (m / (1 - 0.9**t)) / (np.sqrt(v2 / (1 - 0.999**t)) + 1e-8)
        weights[used] = p[:k] * scale
        return cls(weights, np.cumsum(np.concatenate([p[k : k + 1], np.exp(p[k + 1 :])])))


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id and grade of each rated document: 0 if the quality is poor, else 1 if toxic, else 2."""
    rated = labels.where("doc_id is not null and quality is not null")
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    return rated.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Ordinal:
    """Fit on the labelled rows with the smallest hashed ids, ``sample`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            got = [features(t or "") for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), b.column("grade"), pa.array([i.tolist() for i, _ in got], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([v.tolist() for _, v in got], pa.list_(pa.float32()))], names=["doc_id", "grade", "idx", "val"])

    chosen = grades_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rated = base.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")  # ``sample`` rows at most
    rows = rated.mapInArrow(trimmed(run), "doc_id long, grade int, idx array<int>, val array<float>")
    rows = written(rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("idx", "val")).limit(sample), "features")
    #  Features of too few documents are left out where the rows are; the driver gets what the fit uses.
    used = rows.select(F.explode("idx").alias("bucket")).groupBy("bucket").count().where(F.col("count") >= LEAST_DOCS)
    known = np.zeros(BUCKETS, bool)
    known[used.select("bucket").toArrow().column(0).to_numpy()] = True

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, val = b.column("idx"), b.column("val")
            flat = idx.flatten().to_numpy()
            stay = known[flat]
            ends = np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], np.cumsum(idx.value_lengths().to_numpy())])]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[stay])) for x in (flat, val.flatten().to_numpy())]
            yield pa.RecordBatch.from_arrays([b.column("grade"), *lists], names=["grade", "idx", "val"])

    kept = rows.select("grade", "idx", "val").mapInArrow(trimmed(pruned), "grade int, idx array<int>, val array<float>").toArrow()
    dropped(rows)
    if not len(kept):
        return Ordinal(np.zeros(BUCKETS), np.full(GRADES - 1, -50.0))
    split = lambda c: [np.asarray(x.values) for x in kept.column(c)]
    model = Ordinal.fit(list(zip(split("idx"), split("val"), strict=True)), kept.column("grade").to_numpy().astype(np.int64))
    del kept
    give_back()
    return model


def _scores(docs: DataFrame, model: Ordinal, id_col: Column) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Features(), shared.value
        for b in batches:
            s = []
            for t in b.column("text"):
                idx, val = features(t.as_py() or "")
                s.append(float(weights[idx] @ val))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    base = docs.select(id_col.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.mapInArrow(trimmed(run), "doc_id long, score double")


def graded(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, sample: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, score, p_at_least_1, p_at_least_2, expected_grade and kept of each row."""
    model = fitted(docs, labels, sample)
    scored = _scores(docs, model, F.col("doc_id").cast("long"))
    flat = not model.weights.any()
    tails = [1 / (1 + F.exp(F.lit(float(t)) - F.col("score"))) for t in model.thresholds]
    scored = scored.withColumns({f"p_at_least_{k + 1}": p for k, p in enumerate(tails)})
    scored = scored.withColumn("expected_grade", F.col("p_at_least_1") + F.col("p_at_least_2"))
    return scored.withColumn("kept", F.lit(True) if flat else F.col("p_at_least_2") >= keep_from)


def selected(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, sample: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    model = fitted(docs, labels, sample)
    if not model.weights.any():
        return docs
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    cut = float(model.thresholds[-1]) + float(np.log(keep_from / (1 - keep_from)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), weights.value
        for b in batches:
            stay = []
            for t in b.column("text"):
                idx, val = features(t.as_py() or "")
                stay.append(float(w[idx] @ val) >= cut)
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
