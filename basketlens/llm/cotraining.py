"""Quality classifier by co-training of a text view and a metadata view.

Two logistic classifiers look at one document each in its own way: the text view at hashed word
and character-shape features of the content, the metadata view at what is known about the page
(source, language, length, layout: characters, lines, mean line and word length, share of letters,
capitals, digits, marks). They start from the labelled sample. In each round each view scores all unlabelled documents and
hands its most confident ones, in the proportion of the labels, to the other view as pseudo-labels,
provided its balanced accuracy on held-back labels is above chance by ``min_skill``. At last each
view is calibrated on the held-back labels (Platt scaling) and the calibrated log-odds are added,
weighted by skill; a view without skill weighs nothing.

Only labelled rows are sampled: about MAX_LABELLED, one row an id, picked by a hash, fitted on the
driver. The features of all documents are computed once and written sparsely. A round is two
passes over them: a histogram of log-odds (BINS a view) gives the limits beyond which the wanted share of
all unlabelled documents lies, and the documents beyond are added up, exactly, to one mean vector for each
teacher, label and GROUPS of metadata values. A view is fitted on the labelled documents and these means, weighted by
their counts, at half the weight of the labelled documents together, whatever the corpus's size. What reaches the
driver is bounded by BINS and GROUPS. Scoring is one pass over whole texts without a shuffle.

Defined results: without labels of both kinds every score is 0.5 and every document is kept; null
or empty texts have no content features and are scored by metadata and bias alone; null metadata is
a value of its own; labels for unknown ids or with null quality are ignored, repeated labels for
one id count as one by majority, ties as good; equal rows get equal scores; a score equal to the
threshold is kept; other columns are left alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .common import ready, stored, structs, tidied, tidy

MAX_LABELLED = 4000
TEXT_BITS = 12  # size of the hashed text features
META_BITS = 8  # size of the hashed source and language features
ROUNDS = 4
FIT_COLUMNS = 256  # whose deviations are taken at a time
SHARE = 0.05  # of the unlabelled documents that a view labels, more in each round
BINS, SPAN = 4096, 32.0  # bins of log-odds between -SPAN and SPAN
GROUPS = 16  # mean vectors of a teacher and label
UNIT = 1 << 20  # features are added up as whole multiples of 1/UNIT, in any order
TRUST = 0.5  # weight of all pseudo-labels of a kind, the labels of that kind being 1
SUREST = 6.0  # log-odds; the held-back sample supports no more
KIND = pa.struct([("score", pa.float64()), ("text_score", pa.float64()), ("meta_score", pa.float64())])
MARKS = b"#*$%&|<>!"
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
ASCII_REST = bytes(c for c in range(128) if not chr(c).isalpha())


def shape(word: bytes) -> bytes:
    """What kind of word it is: letters, capitals, digits, and the mark at its end."""
    core = word.rstrip(b".,;:!?#*$%&|<>")
    kind = b"A" if core.isupper() and len(core) > 1 else b"0" if core.isdigit() else b"a" if core else b"-"
    return kind + word[len(core):][:3]


def text_features(text: str) -> np.ndarray:
    """Hashed counts as relative frequencies: words, word shapes, and repeated words and word pairs."""
    out = np.zeros(1 << TEXT_BITS, dtype=np.float32)
    words = text.encode().split()
    if not words:
        return out
    size = len(words)
    mask = (1 << TEXT_BITS) - 1
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    shapes: dict[bytes, int] = {}
    for w, n in counts.items():
        out[zlib.crc32(w.lower()) & mask] += math.sqrt(n / size)
        key = shape(w)
        shapes[key] = shapes.get(key, 0) + n
    for key, n in shapes.items():
        out[zlib.crc32(b"\0" + key) & mask] += 3 * n / size
    pairs = size - 1 and len(set(zip(words, words[1:]))) / (size - 1)
    for name, value in ((b"\1distinct", len(counts) / size), (b"\1pairs", pairs), (b"\1top", max(counts.values()) / size)):
        out[zlib.crc32(name) & mask] += 3 * value
        out[zlib.crc32(name + b"%d" % int(10 * value)) & mask] += 1
    return out


def meta_features(text: str, meta: list[str | None]) -> np.ndarray:
    """Layout numbers, and hashed values of the metadata columns."""
    raw = text.encode()
    size = max(1, len(text))
    lines = raw.split(b"\n")
    words = raw.split()
    without = lambda some: len(raw) - len(raw.translate(None, some))
    capitals, digits, marks = without(CAPITALS), without(DIGITS), without(MARKS)
    letters = len(raw) - without(ASCII_REST)
    ended = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    numbers = [math.log1p(size), math.log1p(len(lines)), math.log1p(size / len(lines)), len(raw) / max(1, len(words)) / 10, letters / len(raw or b"x"),
               5 * capitals / size, 5 * digits / size, 10 * marks / size, 10 * min(marks / size, 0.02), ended / len(lines), len(set(lines)) / len(lines), 1.0]
    hashed = np.zeros(1 << META_BITS)
    for i, value in enumerate(meta):
        hashed[zlib.crc32(f"{i}={value}".encode()) % len(hashed)] += 1
    return np.concatenate([numbers, hashed]).astype(np.float32)


class Logistic:
    """L2-regularised logistic regression with balanced classes, by full-batch Adam."""

    def __init__(self, penalty: float = 1e-2, steps: int = 150, rate: float = 0.02):
        self.penalty, self.steps, self.rate = penalty, steps, rate

    def fit(self, x: np.ndarray, y: np.ndarray, trust: np.ndarray | None = None) -> Logistic:
        """``x`` of 32-bit floats is overwritten: it is most of what the driver holds."""
        parts = max(1, x.shape[1] // FIT_COLUMNS)
        self.mean, self.scale = x.mean(axis=0), np.maximum(np.concatenate([p.std(axis=0) for p in np.array_split(x, parts, axis=1)]), 0.02)
        z = x if x.dtype == np.float32 else (x - self.mean).astype(np.float32)
        if z is x:
            z -= self.mean
        z /= self.scale
        np.clip(z, -5, 5, out=z)
        weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * (1 if trust is None else trust)
        weight = weight / weight.sum()
        self.w, self.b = np.zeros(x.shape[1], dtype=np.float32), 0.0
        m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
        for t in range(1, self.steps + 1):
            error = (self._sigmoid(z @ self.w + self.b) - y) * weight
            g = np.append(error.astype(np.float32) @ z + self.penalty * self.w, error.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = self.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            self.w -= step[:-1].astype(np.float32)
            self.b -= step[-1]
        return self

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = x - self.mean
        z /= self.scale
        return np.clip(z, -5, 5, out=z) @ self.w + self.b


def skill(odds: np.ndarray, y: np.ndarray) -> float:
    """Balanced accuracy above chance, 0 to 1."""
    if not y.any() or y.all():
        return 0.0
    return max(0.0, float((odds[y > 0] > 0).mean() + (odds[y == 0] <= 0).mean() - 1))


def platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and shift that make calibrated log-odds of held-back odds."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * odds * odds).sum() + 1e-3, (w * odds).sum()], [(w * odds).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([((p - target) * odds).sum(), (p - target).sum()]))
        a, b = a - float(step[0]), b - float(step[1])
        if abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def odds_bin(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((odds + SPAN) * (BINS / (2 * SPAN))), 0, BINS - 1).astype(np.int64)


def limits(histogram: np.ndarray, wanted: float, good: float) -> tuple[int, int]:
    """Bins (low, high): those up to ``low`` hold the surest bad documents, those from ``high`` on the
    surest good ones, ``wanted`` of them in all; a bin is taken whole, and never across log-odds of 0."""
    middle = BINS // 2
    above, below = np.cumsum(histogram[::-1]), np.cumsum(histogram)
    high = BINS - 1 - int(np.searchsorted(above, max(1.0, wanted * good)))
    low = int(np.searchsorted(below, max(1.0, wanted * (1 - good))))
    return min(low, middle - 1), max(high, middle)


def histograms(models: list[Logistic], views: list[np.ndarray]) -> np.ndarray:
    """Documents by view and bin of log-odds."""
    return np.stack([np.bincount(odds_bin(m.odds(x)), minlength=BINS) for m, x in zip(models, views)])


def slots(models: list[Logistic], views: list[np.ndarray], group: np.ndarray, cuts: list[tuple[int, int] | None]) -> dict[tuple[int, int, int], tuple[int, np.ndarray]]:
    """(teacher, label, group) -> how many documents, and the sum of the other view's features."""
    found = {}
    for me, cut in enumerate(cuts):
        if cut is None:
            continue
        at, student = odds_bin(models[me].odds(views[me])), views[1 - me]
        for label, chosen in ((0, at <= cut[0]), (1, at >= cut[1])):
            for g in np.unique(group[chosen]).tolist():
                rows = chosen & (group == g)
                found[me, label, g] = int(rows.sum()), np.rint(student[rows].astype(np.float64) * UNIT).astype(np.int64).sum(axis=0)
    return found


class Pool:
    """The unlabelled documents as a written table of sparse features. Every document takes part in every round."""

    def __init__(self, rows: DataFrame):
        self.rows, self.size = rows, rows.count()

    def histograms(self, models: list[Logistic]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, BINS), dtype=np.int64)
            for _, views, _ in dense_batches(batches):
                total += histograms(models, views)
            view, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(view), pa.array(at), pa.array(total[view, at])], names=["view", "bin", "n"])

        told = self.rows.mapInArrow(tidied(run), "view long, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((2, BINS), dtype=np.int64)
        out[told["view"].to_numpy(), told["bin"].to_numpy()] = told["n"].to_numpy()
        return out

    def slots(self, models: list[Logistic], cuts: list[tuple[int, int] | None]) -> dict:
        kind = "teacher long, label long, grp long, part long, n long, sums binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, total = TaskContext.get().partitionId(), {}
            for _, views, group in dense_batches(batches):
                for key, (n, sums) in slots(models, views, group, cuts).items():
                    have = total.get(key)
                    total[key] = (n, sums) if have is None else (have[0] + n, have[1] + sums)
            cols = list(zip(*[(*key, part, n, sums.tobytes()) for key, (n, sums) in total.items()])) or [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(cols)], names=["teacher", "label", "grp", "part", "n", "sums"])

        def add(rows: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in rows["sums"])
            first = rows.slice(0, 1).drop_columns(["n", "sums"])
            return first.append_column("n", pa.array([sum(rows["n"].to_pylist())], pa.int64())).append_column("sums", pa.array([sums.tobytes()], pa.binary()))

        each = self.rows.mapInArrow(tidied(run), kind)
        some = each.withColumn("part", F.col("part") % 64).groupBy("teacher", "label", "grp", "part").applyInArrow(add, kind)
        told = some.groupBy("teacher", "label", "grp").applyInArrow(add, kind).collect()
        return {(r.teacher, r.label, r.grp): (r.n, np.frombuffer(r.sums, dtype=np.int64)) for r in told}


def cotrain(views: list[np.ndarray], y: np.ndarray, pool, held: np.ndarray, rounds: int = ROUNDS, share: float = SHARE, min_skill: float = 0.2) -> dict:
    """Fit both views. ``views``: features of labelled documents by view; ``pool``: the unlabelled
    ones; ``held``: which labelled documents are held back for skill and calibration."""
    taught: list[dict] = [{}, {}]  # means each view was given: (label, group) -> count, vector
    models: list[Logistic] = []
    own = y[~held]
    good = own.mean()
    for turn in range(rounds + 1):
        models = []
        for x, given in zip(views, taught):
            keys = sorted(given)
            n = np.array([given[k][0] for k in keys], dtype=np.float64)
            ys = np.array([label for label, _ in keys], dtype=np.float64)
            trust = np.array([TRUST * (own == label).sum() * given[label, g][0] / n[ys == label].sum() for label, g in keys])
            rows = np.empty((len(own) + len(keys), x.shape[1]), dtype=np.float32)
            np.compress(~held, x, axis=0, out=rows[:len(own)])
            rows[len(own):] = np.array([given[k][1] for k in keys]).reshape(len(keys), x.shape[1])
            models.append(Logistic().fit(rows, np.concatenate([own, ys]), np.concatenate([np.ones(len(own)), trust])))
            del rows
        if turn == rounds or not pool.size:
            break
        able = [skill(m.odds(x[held]), y[held]) >= min_skill for m, x in zip(models, views)]
        if not any(able):
            break
        cuts = [limits(h, share * (turn + 1) * pool.size, good) if fit else None for h, fit in zip(pool.histograms(models), able)]
        given = pool.slots(models, cuts)
        for me in (0, 1):
            if able[me]:
                taught[1 - me] = {(label, g): (n, sums / (n * UNIT)) for (teacher, label, g), (n, sums) in given.items() if teacher == me}
    parts = []
    for model, x in zip(models, views):
        odds = model.odds(x[held])
        parts.append((model.mean, model.scale, model.w, model.b, *platt(odds, y[held]), skill(odds, y[held])))
    return {"views": parts, "rounds": turn, "pool": pool.size}


def view_features(row: dict) -> tuple[np.ndarray, np.ndarray]:
    text = row["text"] or ""
    return text_features(text), meta_features(text, [v for k, v in row.items() if k != "text"])


def packed(docs: DataFrame, text: str, meta: list[str]):
    return F.struct(F.col(text).cast("string").alias("text"), *[F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(meta)])


SPARSE = "id_hash long, y int, grp int, a_at binary, a binary, b_at binary, b binary"


def sparse(vector: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(vector)
    return at.astype(np.uint16).tobytes(), vector[at].astype(np.float32).tobytes()


def dense(at: list[bytes], values: list[bytes], size: int) -> np.ndarray:
    out = np.zeros((len(at), size), dtype=np.float32)
    row = np.repeat(np.arange(len(at)), [len(x) // 2 for x in at])
    out[row, np.frombuffer(b"".join(at), dtype=np.uint16)] = np.frombuffer(b"".join(values), dtype=np.float32)
    return out


SIZES = 1 << TEXT_BITS, len(meta_features("", []))
DENSE_ROWS = 250


def dense_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Labels, features by view, and groups of some documents at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, DENSE_ROWS):
            part = batch.slice(i, DENSE_ROWS)
            col = lambda name: part.column(name).to_pylist()  # noqa: B023, E731
            yield (part.column("y").to_numpy(zero_copy_only=False), [dense(col("a_at"), col("a"), SIZES[0]), dense(col("b_at"), col("b"), SIZES[1])],
                   part.column("grp").to_numpy(zero_copy_only=False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("row").to_pylist()
        coded = [(*sparse(a), *sparse(b)) for a, b in map(view_features, rows)]
        group = [zlib.crc32(repr([v for k, v in r.items() if k != "text"]).encode()) % GROUPS for r in rows]
        cols = list(zip(*coded)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("id_hash"), batch.column("y"), pa.array(group, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]],
                                         names=["id_hash", "y", "grp", "a_at", "a", "b_at", "b"])


def featured(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, meta: tuple[str, ...], max_labelled: int) -> DataFrame | None:
    """Sparse features of all documents, written; ``y`` is the label of those picked to be fitted, else -1."""
    place = lambda *c: F.pmod(F.xxhash64(F.lit(1), *c), F.lit(1 << 40)) / F.lit(float(1 << 40))
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y"))
    n_labels = known.count()
    if not n_labels:
        return None
    picked = known.filter(place("_id") < min(1.0, max_labelled / n_labels))  # about max_labelled rows
    rows = docs.select(F.col(id_col).alias("_id"), packed(docs, text, list(meta)).alias("row")).join(F.broadcast(picked), "_id", "left")
    return stored(rows.select(F.xxhash64("_id").alias("id_hash"), F.coalesce("y", F.lit(-1)).alias("y"), "row").mapInArrow(tidied(_features), SPARSE), "features")


def ordered(told: pa.Table) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """Labels and features by view of the labelled documents, sorted, or None unless the labels are of both kinds. Dense
    rows are made a few at a time, first to sort by, then each at its place, so that the driver holds them once."""
    sums = [(y, views[0].sum(axis=1), views[1].sum(axis=1)) for y, views, _ in dense_batches(iter(told.combine_chunks().to_batches()))]
    y, first, second = (np.concatenate(c) for c in zip(*sums)) if sums else [np.zeros(0)] * 3
    if not (y == 0).any() or not (y == 1).any():
        return None
    y = y.astype(np.float64)
    order = np.lexsort((first, second, y))
    views, at = [np.empty((len(y), n), dtype=np.float32) for n in SIZES], 0
    for part, both, _ in dense_batches(iter(told.take(pa.array(order)).combine_chunks().to_batches())):
        for view, rows in zip(views, both):
            view[at:at + len(part)] = rows
        at += len(part)
    return y[order], views


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", meta: tuple[str, ...] = ("source", "lang"),
          max_labelled: int = MAX_LABELLED) -> dict | None:
    """The fitted model, or None where the labels are not of both kinds."""
    ready(docs.sparkSession)
    rows = featured(docs, labels, id_col, text, label, meta, max_labelled)
    if rows is None:
        return None
    # One row an id, however often it repeats; sorted by content, as the order of delivery must not matter.
    one = rows.filter("y >= 0").groupBy("id_hash").agg(F.min(F.struct("y", "grp", "a_at", "a", "b_at", "b")).alias("r")).select("r.*")
    found = ordered(one.toArrow())
    if found is None:
        return None
    y, views = found
    model = cotrain(views, y, Pool(rows.filter("y < 0")), np.arange(len(y)) % 3 == 0)
    del found, views
    tidy()
    return model


def combine(model: dict, a: np.ndarray, b: np.ndarray) -> list[tuple[float, float, float]]:
    """(score, text score, metadata score) of documents: weighted sum of calibrated log-odds."""
    total, each, weight = 0.0, [], sum(v[6] for v in model["views"])
    for x, (mean, scale, w, bias, slope, shift, share) in zip((a, b), model["views"]):
        odds = np.clip(slope * (np.clip((x - mean) / scale, -5, 5) @ w + bias) + shift, -SUREST, SUREST)
        total = total + odds * (share / weight if weight else 0.5)
        each.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return list(zip((1 / (1 + np.exp(-np.clip(total, -30, 30)))).tolist(), each[0].tolist(), each[1].tolist()))


def score(docs: DataFrame, model: dict | None, text: str = "text", meta: tuple[str, ...] = ("source", "lang"), out: str = "quality_view", threshold: float = 0.5) -> DataFrame:
    """All rows and columns, and a struct ``out``: ``score, text_score, meta_score, kept``. An
    ``out`` that is there already is replaced."""
    ready(docs.sparkSession)
    if model is None:
        half = F.lit(0.5)
        return docs.withColumn(out, F.struct(half.alias("score"), half.alias("text_score"), half.alias("meta_score"), F.lit(True).alias("kept")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            for i in range(0, len(batch), 250):
                both = [view_features(r) for r in batch.slice(i, 250).to_pylist()]
                if both:
                    found += combine(shared.value, np.stack([a for a, _ in both]), np.stack([b for _, b in both]))
            yield structs(KIND, found)
        tidy()

    scored = docs.withColumn(out, F.arrow_udf(run, returnType=from_arrow_type(KIND)).asNondeterministic()(packed(docs, text, list(meta))))
    return scored.withColumn(out, F.col(out).withField("kept", F.col(f"{out}.score") >= threshold))
