"""Quality scores of texts: random Fourier features, ridge by summed normal equations, isotonic calibration.

1. One pass over the texts turns each into ``STATISTICS``: sizes, shares of kinds of characters, words and
   lines, entropy of bytes. They are written, and texts are not read again.
2. Labelled rows that may be learned from are standardised and mapped to ``features`` cosines at
   random frequencies, whose inner products approximate a Gaussian kernel over the statistics.
   Every task adds up the outer products of its rows, per fold; Spark sums the matrices in two levels.
   So fitting takes memory that does not grow with the rows.
3. The kernel width and the ridge penalty are those with the least squared error on folds left out,
   which follows from the summed matrices alone.
4. Scores of each fold by the model of the other folds are counted with their labels on a fixed
   grid, and the pooled-adjacent-violators fit over the grid maps ridge scores to
   probabilities: linear between the centres of its blocks, ties split by the ridge score.

A row may be learned from if crc32 of its id as text, modulo ``FOLDS``, is not 0; the remainder
is its fold. Ids serve for nothing else, and labels, lang and source are no input.

Defined results: a null text is empty and is scored as such; a null id is held out (its text
form is taken as empty); every row of documents is scored, repeated ones alike. Labels other than 0 and 1
and null ids of labels are ignored; several labels of one id count with their mean. Without any label
to learn from the score is 0.5; with labels of one kind it is that label. No rows give no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from keybalance.functions.keys import column_ref
from keybalance.llm import batches as B
from keybalance.workdir import written

FOLDS = 5
FEATURES = 256
SEED = 20_240
THRESHOLD = 0.3
#: Statistics beyond so many standard deviations count as that many.
FARTHEST = 5.0
#: Kernel widths to choose from, in typical distances of two rows.
WIDTHS = (0.5, 1.0, 2.0)
PENALTIES = tuple(10.0**e for e in range(-6, 1))
#: Ridge scores are counted on a grid of this many cells from LOW to HIGH.
CELLS, LOW, HIGH = 3000, -1.0, 2.0
#: Weight of the ridge score within ties of the calibrated one.
TIE = 1e-3
#: Matrices of tasks are summed in so many slots first.
SLOTS = 64
SHARD_BYTES = 4 << 20
SHARD_TEXTS = 2048

_KINDS = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "blank": (32, 9),
    "line": (10, 13),
    "stop": b".,;:'\"()-",
    "loud": b"!?",
    "beyond": range(128, 256),
}
_KIND = np.zeros((256, len(_KINDS) + 1), np.float64)
for _i, _chars in enumerate(_KINDS.values()):
    _KIND[list(_chars), _i] = 1
_KIND[:, -1] = _KIND[:, :-1].sum(1) == 0  # all other symbols
_LETTER = _KIND[:, [0, 1, 7]].any(1)
_UPPER = _KIND[:, 1] > 0
_SYMBOL = _KIND[:, -1] > 0
_LOUD = _KIND[:, 6] > 0
_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True

WORD_SUMS = ("words", "length", "square", "again", "unlettered", "shouted", "marked", "loud_word")
LINE_SUMS = ("lines", "line_again")
STATISTICS = (
    *("bytes", "words", "lines", "entropy", "word_length", "length_spread", "line_words", "upper_letters"),
    *[f"{k}_share" for k in (*_KINDS, "symbol")],
    *[f"{k}_share" for k in (*WORD_SUMS[3:], *LINE_SUMS[1:])],
)


# ------------------------------------------------------------ statistics of texts


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each text; ``first`` bounds them (n + 1)."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.float64)])[first])


def _same_as_before(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each part is probably the same as the one before it in its text."""
    value = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(B.SYMBOL[data], out=value[1:])
    size = end - start
    total = value[end] - value[start]
    again = np.zeros(len(start), bool)
    again[1:] = (size[1:] == size[:-1]) & (total[1:] == total[:-1])
    again[first[:-1][first[:-1] < len(start)]] = False
    return again


def sums(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: counts of the 256 bytes, and ``WORD_SUMS`` with ``LINE_SUMS``. Both add up over pieces."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    place = np.repeat(np.arange(n, dtype=np.int64) * 256, size) + data
    histogram = np.bincount(place, minlength=256 * n).reshape(n, 256).astype(np.float64)
    start, end, first = B.words(~B.BLANK[data], bounds)
    length = (end - start).astype(np.float64)

    def held(kind: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        return upto[end] - upto[start]

    letters, upper = held(_LETTER), held(_UPPER)
    words = [
        np.ones(len(start)),
        length,
        length * length,
        _same_as_before(data, start, end, first),
        letters == 0,
        (upper > 1) & (upper == letters),
        held(_SYMBOL) > 0,
        held(_LOUD) > 0,
    ]
    line_start, line_end, line_first = B.words(~_LINE_END[data], bounds)
    lines = [np.ones(len(line_start)), _same_as_before(data, line_start, line_end, line_first)]
    found = [_per_text(v, first) for v in words] + [_per_text(v, line_first) for v in lines]
    return histogram, np.stack(found, 1)


def statistics(histogram: np.ndarray, added: np.ndarray) -> np.ndarray:
    """``STATISTICS`` per text from its sums; all finite, also for no text at all."""
    words, length, square, *rest = added[:, : len(WORD_SUMS)].T
    lines, line_again = added[:, len(WORD_SUMS) :].T
    size = histogram.sum(1)
    share = lambda part, of: part / np.maximum(of, 1)
    part = histogram / np.maximum(size, 1)[:, None]
    entropy = -(part * np.log2(np.where(part > 0, part, 1))).sum(1)
    mean = share(length, words)
    kinds = histogram @ _KIND
    columns = [
        np.log1p(size),
        np.log1p(words),
        np.log1p(lines),
        entropy,
        np.log1p(mean),
        np.sqrt(np.maximum(share(square, words) - mean * mean, 0)) / np.maximum(mean, 1),
        np.log1p(share(words, lines)),
        share(kinds[:, 1], kinds[:, 0] + kinds[:, 1]),
        *[share(k, size) for k in kinds.T],
        *[share(r, words) for r in rest],
        share(line_again, lines),
    ]
    return np.stack(columns, 1)


def _of_shard(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if len(bounds) == 2 and len(data) > SHARD_BYTES:  # one long text, in pieces that begin with a blank
        cuts = [0]
        while cuts[-1] < len(data):
            a = min(cuts[-1] + SHARD_BYTES, len(data))
            step = np.flatnonzero(B.BLANK[data[a : a + SHARD_BYTES]])[:1]
            cuts.append(a + int(step[0]) if len(step) else min(a + SHARD_BYTES, len(data)))
        parts = [sums(data[a:b], np.array([0, b - a])) for a, b in zip(cuts, cuts[1:])]
        return statistics(sum(p[0] for p in parts), sum(p[1] for p in parts))
    found = [np.empty((0, len(STATISTICS)))]
    for a in range(0, len(bounds) - 1, SHARD_TEXTS):
        some = bounds[a : a + SHARD_TEXTS + 1]
        found.append(statistics(*sums(data[some[0] : some[-1]], some - some[0])))
    return np.concatenate(found)


def _measure(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: rows with the statistics of their text in its place."""
    for shard in B.shards(given, SHARD_BYTES):
        values = _of_shard(*B.flat(shard.column("text")))
        ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(STATISTICS))
        lists = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays(
            [shard.column("doc_id").combine_chunks(), shard.column("fold").combine_chunks(), lists],
            names=["doc_id", "fold", "x"],
        )


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text modulo ``FOLDS``; 0 is held out."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text), F.lit(FOLDS)).cast("int")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fold, x): the statistics of every text, written once."""
    rows = docs.select(
        column_ref(doc_id).alias("doc_id"),
        fold_of(column_ref(doc_id)).alias("fold"),
        column_ref(text).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    with B.small_batches(docs.sparkSession):
        return written(rows.mapInArrow(_measure, f"doc_id {kind}, fold int, x array<double>"), "statistics")


# ------------------------------------------------------------ features and the ridge


@dataclass
class Map:
    """Standardised statistics to cosines at random frequencies, and a constant."""

    mean: np.ndarray
    spread: np.ndarray
    width: float
    features: int = FEATURES
    frequency: np.ndarray = field(init=False)
    phase: np.ndarray = field(init=False)

    def __post_init__(self):
        random = np.random.default_rng(SEED)
        size = len(self.mean)
        apart = np.sqrt(2 * size)
        self.frequency = random.standard_normal((size, self.features)) / (self.width * apart)
        self.phase = random.uniform(0, 2 * np.pi, self.features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -FARTHEST, FARTHEST)
        waves = np.sqrt(2 / self.features) * np.cos(z @ self.frequency + self.phase)
        return np.concatenate([waves, np.ones((len(x), 1))], 1)


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _outer(mapping: Map):
    """For ``mapInArrow``: per fold, the summed outer products of (features, 1, label)."""

    def add(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in given:
            folds = batch.column("fold").to_numpy()
            z = np.column_stack([mapping(rows_of(batch.column("x"))), batch.column("y").to_numpy()])
            for f in np.unique(folds):
                own = z[folds == f]
                total[int(f)] = total.get(int(f), 0) + own.T @ own
        if total:
            yield pa.RecordBatch.from_pydict(
                {"fold": pa.array(list(total), pa.int32()), "m": [m.tobytes() for m in total.values()]}
            )

    return add


def _added(rows: pa.Table) -> pa.Table:
    """One group of matrices as their sum."""
    total = sum(np.frombuffer(m.as_py()) for m in rows.column("m"))
    return rows.slice(0, 1).set_column(
        rows.schema.get_field_index("m"), pa.field("m", pa.binary()), pa.array([total.tobytes()])
    )


def normal_equations(train: DataFrame, mapping: Map) -> dict[int, np.ndarray]:
    """Fold to its summed matrix: tasks, then slots of tasks, then folds."""
    size = mapping.features + 2
    by_task = train.mapInArrow(_outer(mapping), "fold int, m binary").withColumn(
        "slot", F.pmod(F.spark_partition_id(), F.lit(SLOTS)).cast("int")
    )
    by_slot = by_task.groupBy("slot", "fold").applyInArrow(_added, "fold int, m binary, slot int")
    by_fold = by_slot.groupBy("fold").applyInArrow(_added, "fold int, m binary, slot int")
    return {r["fold"]: np.frombuffer(r["m"]).reshape(size, size) for r in by_fold.collect()}


def solve(matrix: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights; the penalty is per row, and the constant goes without."""
    a, b = matrix[:-1, :-1], matrix[:-1, -1]
    rows = a[-1, -1]
    ridge = np.full(len(a), penalty * rows)
    ridge[-1] = 1e-9 * rows
    return np.linalg.solve(a + np.diag(ridge), b)


def _squared_error(matrix: np.ndarray, weights: np.ndarray) -> float:
    return matrix[-1, -1] - 2 * weights @ matrix[:-1, -1] + weights @ matrix[:-1, :-1] @ weights


def fit_folds(matrices: dict[int, np.ndarray]) -> tuple[float, np.ndarray, dict[int, np.ndarray]]:
    """At the best penalty: squared error on left-out folds, weights of all folds, and for each
    fold those of the others."""
    total = sum(matrices.values())
    others = {f: total - m if len(matrices) > 1 else m for f, m in matrices.items()}

    def error(penalty: float) -> float:
        return sum(_squared_error(m, solve(others[f], penalty)) for f, m in matrices.items())

    best = min(PENALTIES, key=error)
    return error(best), solve(total, best), {f: solve(m, best) for f, m in others.items()}


# ------------------------------------------------------------ calibration and scores


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and levels of the pooled blocks of the best non-decreasing fit; ``at`` ascends."""
    blocks: list[list[float]] = []  # centre, level, weight
    for x, y, w in zip(at, mean, weight):
        blocks.append([x, y, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            x2, y2, w2 = blocks.pop()
            x1, y1, w1 = blocks.pop()
            w3 = w1 + w2
            blocks.append([(x1 * w1 + x2 * w2) / w3, (y1 * w1 + y2 * w2) / w3, w3])
    centre, level, _ = (np.array(c) for c in zip(*blocks))
    return centre, level


def _cell(score: np.ndarray) -> np.ndarray:
    return np.clip((score - LOW) / (HIGH - LOW) * CELLS, 0, CELLS - 1).astype(np.int32)


def _cells(mapping: Map, weights: dict[int, np.ndarray]):
    """For ``mapInArrow``: per grid cell of the left-out score, rows and labels of the task."""

    def count(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, labels = np.zeros(CELLS), np.zeros(CELLS)
        for batch in given:
            folds, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
            z = mapping(rows_of(batch.column("x")))
            for f in np.unique(folds):
                own = folds == f
                cell = _cell(z[own] @ weights[int(f)])
                n += np.bincount(cell, minlength=CELLS)
                labels += np.bincount(cell, y[own], CELLS)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict(
            {"cell": pa.array(held, pa.int32()), "n": n[held], "y": labels[held]}
        )

    return count


@dataclass
class Model:
    mapping: Map
    weights: np.ndarray
    centre: np.ndarray
    level: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        ridge = self.mapping(x) @ self.weights
        calibrated = np.interp(ridge, self.centre, self.level)
        within = np.clip((ridge - LOW) / (HIGH - LOW), 0, 1)
        return np.round(np.clip((1 - TIE) * calibrated + TIE * within, 0, 1), 9)


def fit(rows: DataFrame, labels: DataFrame, features: int = FEATURES) -> Model | None:
    """A model of ``labels`` (doc_id, y) over measured ``rows``; None without anything to learn from."""
    y = labels.where(F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.avg("y").alias("y"))
    train = written(rows.where("fold > 0").join(y, "doc_id").select("fold", "x", "y"), "labelled")
    numbers = range(len(STATISTICS))
    moments = train.agg(
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in numbers],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in numbers],
    ).first()
    if moments["m0"] is None:
        return None
    mean = np.array([moments[f"m{i}"] for i in numbers])
    spread = np.array([moments[f"s{i}"] for i in numbers])
    spread = np.where(spread > 1e-12, spread, 1.0)
    mappings = [Map(mean, spread, width, features) for width in WIDTHS]
    fitted = [(*fit_folds(normal_equations(train, m)), m) for m in mappings]
    _, weights, left_out, mapping = min(fitted, key=lambda x: x[0])
    cells = train.mapInArrow(_cells(mapping, left_out), "cell int, n double, y double")
    grid = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("cell").collect()
    cell, n, y = (np.array(c) for c in zip(*grid))  # at most CELLS rows
    at = LOW + (cell + 0.5) * (HIGH - LOW) / CELLS
    return Model(mapping, weights, *isotonic(at, y / n, n))


def _score(model: Model | None, threshold: float, id_type: pa.DataType):
    def score(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            n = batch.num_rows
            found = model(rows_of(batch.column("x"))) if model and n else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(id_type),
                    pa.array(batch.column("fold").to_numpy() == 0),
                    pa.array(found),
                    pa.array((found >= threshold).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return score


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    threshold: float = THRESHOLD,
    features: int = FEATURES,
) -> DataFrame:
    """(doc_id, held_out, score, predicted): how likely label 1 is for each document's text."""
    rows = measured(docs, doc_id, text)
    given = labels.select(column_ref(label_id).alias("doc_id"), column_ref(label).alias("y"))
    model = fit(rows, given, features)
    kind = rows.schema["doc_id"].dataType
    return rows.mapInArrow(
        _score(model, threshold, to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, held_out boolean, score double, predicted int",
    )
