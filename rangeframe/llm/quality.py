"""Quality classifier by co-training on two views of a document.

The *text view* sees what the words are like: variety, repeats, case, marks.  The
*metadata view* sees what surrounds them: source, language, declared length, and the
layout in lines.  Each view has a logistic model.  Both start from the labelled
rows; then, round by round, each model's confident verdicts on unlabelled rows
become training labels of the other, and both are fitted again.  At the end each
view is calibrated on labelled rows that no fit has used, and the calibrated
odds are combined, as for views that are independent given the class.

Features are taken once, some fifty numbers per document, and written.  A fit is
a handful of Newton steps; a step is one pass over those numbers in which every task
adds up its own rows to a small matrix.  All labelled and all confident rows take
part; nothing but the matrices and the coefficients passes through the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, quoted, text_digest, written
from .shingles import words

ROUNDS = 3
CONFIDENT = 0.98
CALIBRATION_ROWS = 50_000  # labelled rows that calibrate the views, at most
KEEP_FROM = 0.5
_FOLDS = 5  # one of them calibrates
_FIRST_STEPS, _LATER_STEPS = 7, 3
_RIDGE = 1.0
_SOURCES, _LANGS = 16, 8
N_TEXT, N_META = 13, 9 + _SOURCES + _LANGS


def text_features(text: str | None) -> list[float]:
    """What the words are like; zeros for a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").split()
    if not tokens:
        return [0.0] * N_TEXT
    n = len(tokens)
    raw = b" ".join(tokens)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    lowered = words(text)
    by_word = Counter(lowered)
    pairs = len(set(zip(lowered, lowered[1:]))) / max(1, n - 1)
    again = sum(a == b for a, b in zip(lowered, lowered[1:])) / max(1, n - 1)
    return [
        len(by_word) / n,
        by_word.most_common(1)[0][1] / n,
        pairs,
        again,
        min(len(raw) / n, 40.0) / 10.0,
        float(upper / max(1, upper + lower)),
        min(counts[33] / n, 2.0),
        min(counts[124] / n, 2.0),
        min((counts[46] + counts[44]) / n, 2.0),
        min(counts[48:58].sum() / len(raw), 1.0),
        counts[128:].sum() / len(raw),
        sum(len(t) == 1 and not t.isalnum() for t in tokens) / n,
        min(np.log1p(n), 15.0) / 5.0,
    ]


def meta_features(text: str | None, source: str | None, lang: str | None, n_chars: float | None) -> list[float]:
    """What surrounds the words; missing values have a place of their own."""
    lengths = np.array([len(line) for line in (text or "").split("\n")], dtype=float)
    lines, mean = np.log1p(len(lengths)), np.log1p(lengths.mean())
    declared = -1.0 if n_chars is None or n_chars != n_chars else float(n_chars)
    out = [
        np.log1p(max(declared, 0.0)) / 5.0,
        float(declared < 0),
        float(declared >= 0 and declared != lengths.sum() + len(lengths) - 1),
        lines / 3.0,
        mean / 5.0,
        np.log1p(lengths.max()) / 5.0,
        float((lengths < 20).mean()),
        lines * mean / 15.0,
        mean * mean / 25.0,
    ]
    for value, size in ((source, _SOURCES), (lang, _LANGS)):
        bins = [0.0] * size
        bins[0 if value is None else 1 + zlib.crc32(str(value).encode("utf-8", "surrogatepass")) % (size - 1)] = 1.0
        out += bins
    return out


def _featured(frame: pd.DataFrame) -> list[list[float]]:
    columns = (frame[c] for c in ("text", "source", "lang", "n_chars"))
    return [text_features(t) + meta_features(t, s, g, n) for t, s, g, n in zip(*columns)]


def _facts(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that features come from, under fixed names; a column that is missing is null."""
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "double"}
    have = set(docs.columns)
    return docs.select(
        quoted(names["doc_id"]).alias("doc_id"),
        *((quoted(names[n]) if names[n] in have else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()),
    )


def _views(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones((len(x), 1))
    return np.hstack([one, x[:, :N_TEXT]]), np.hstack([one, x[:, N_TEXT:]])


@dataclass(frozen=True)
class Model:
    """Coefficients of both views, their calibration (slope, shift), and the share of good labels."""

    text: tuple[float, ...]
    meta: tuple[float, ...]
    text_scale: tuple[float, float] = (1.0, 0.0)
    meta_scale: tuple[float, float] = (1.0, 0.0)
    good: float = 1.0
    fitted: bool = True

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = _views(x)
        return a @ np.array(self.text), b @ np.array(self.meta)

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of good quality by text, by metadata, and by both."""
        if not self.fitted:
            flat = np.full(len(x), self.good)
            return flat, flat, flat
        a, b = self.logits(x)
        a, b = self.text_scale[0] * a + self.text_scale[1], self.meta_scale[0] * b + self.meta_scale[1]
        prior = np.log(self.good / (1 - self.good))
        return _chance(a), _chance(b), _chance(a + b - prior)


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _newton_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the log-likelihood, side by side."""
    p = _chance(x @ beta)
    return np.hstack([(x.T @ (weight * (y - p)))[:, None], (x * (weight * p * (1 - p))[:, None]).T @ x])


def _newton_move(sums: np.ndarray, beta: np.ndarray) -> np.ndarray:
    ridge = np.full(len(beta), _RIDGE)
    ridge[0] = 1e-6
    step = np.linalg.solve(sums[:, 1:] + np.diag(ridge), sums[:, 0] - ridge * beta)
    length = np.abs(step).max()
    return np.round(beta + step * min(1.0, 5.0 / max(length, 1e-9)), 9)  # the order of sums does not show


def _fit_step(features: DataFrame, model: Model, teachers: Model | None, confident: float) -> Model:
    """One Newton step of both views over all training rows; ``teachers`` label the rest."""
    sizes = (1 + N_TEXT, 1 + N_META)
    bound = float(np.log(confident / (1 - confident)))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((d, d + 1)) for d in sizes]
        for part in parts:
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, N_TEXT + N_META)
            label = part.column("label").cast(pa.float64()).to_numpy(zero_copy_only=False)
            known = ~np.isnan(label)
            views = _views(x)
            said = teachers.logits(x) if teachers else None
            for view, beta in enumerate((model.text, model.meta)):
                weight, y = known.astype(float), np.where(known, label, 0.0)
                if said:
                    other = said[1 - view]
                    sure = ~known & (np.abs(other) >= bound)
                    weight[sure], y[sure] = 1.0, (other[sure] > 0).astype(float)
                use = weight > 0
                totals[view] += _newton_sums(views[view][use], y[use], weight[use], np.array(beta))
        values = np.concatenate([t.ravel() for t in totals])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["place", "value"])

    training = features.filter("NOT held")
    rows = training.select("label", "x").mapInArrow(batches, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(sum(d * (d + 1) for d in sizes))
    for row in rows:
        flat[row["place"]] = row["value"]
    cut = sizes[0] * (sizes[0] + 1)
    sums = flat[:cut].reshape(sizes[0], -1), flat[cut:].reshape(sizes[1], -1)
    moved = [_newton_move(s, np.array(b)) for s, b in zip(sums, (model.text, model.meta))]
    return Model(tuple(moved[0].tolist()), tuple(moved[1].tolist()), good=model.good)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn a view's logit into log-odds; a weak pull holds them finite."""
    x, beta = np.column_stack([np.ones(len(z)), np.clip(z, -30, 30)]), np.array([0.0, 1.0])
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(25):
        sums = _newton_sums(x, target, np.ones(len(z)), beta)
        step = np.linalg.solve(sums[:, 1:] + 1e-3 * np.eye(2), sums[:, 0] - 1e-3 * (beta - [0.0, 1.0]))
        beta = beta + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return round(float(beta[1]), 9), round(float(beta[0]), 9)


_NAMES = {"doc_id": "doc_id", "text": "text", "source": "source", "lang": "lang", "n_chars": "n_chars"}


def featured(docs: DataFrame, labels: DataFrame, *, label: str = "quality", label_id: str = "doc_id", **names: str) -> DataFrame:
    """``(doc_id, mark, label, held, x)`` for every row, written.

    Labels of one id are averaged, one half counting as good; null labels are none.
    """
    facts = _facts(docs, _NAMES | names)
    rows = facts.select("*", text_digest(F.col("text")).alias("mark"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "mark": frame["mark"], "x": _featured(frame)})

    made = map_frames(rows, batches, f"doc_id {kind}, mark bigint, x array<float>")
    given = (
        labels.select(quoted(label_id).alias("l_id"), quoted(label).cast("double").alias("given"))
        .filter("given IS NOT NULL AND l_id IS NOT NULL")
        .groupBy("l_id")
        .agg((F.avg("given") >= 0.5).cast("int").alias("label"))
    )
    met = made.join(given, made["doc_id"] == given["l_id"], "left").drop("l_id")
    held = F.col("label").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(_FOLDS)) == 0)
    return written(met.select("doc_id", "mark", "label", held.alias("held"), "x"), "quality-features")


def co_train(features: DataFrame, *, rounds: int = ROUNDS, confident: float = CONFIDENT, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """The model of both views.

    Without labels of both classes nothing can be learnt: every document then gets
    the share of good labels, or 1 without any.
    """
    counts = {r["label"]: r["n"] for r in features.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    model = Model((0.0,) * (1 + N_TEXT), (0.0,) * (1 + N_META), good=(n_good + 1) / (n_good + n_bad + 2))
    if not n_good or not n_bad:
        return Model(model.text, model.meta, good=n_good / (n_good + n_bad) if counts else 1.0, fitted=False)
    labelled = features.filter("label IS NOT NULL")
    for _ in range(_FIRST_STEPS):
        model = _fit_step(labelled, model, None, confident)
    for _ in range(rounds):
        teachers = model
        for _ in range(_LATER_STEPS):
            model = _fit_step(features, model, teachers, confident)
    sample = labelled.filter("held").orderBy(F.xxhash64("doc_id", "mark")).limit(calibration_rows).select("label", "x").toPandas()
    if sample["label"].nunique() < 2:
        return model
    z = model.logits(np.array(sample["x"].tolist(), dtype=float))
    y = sample["label"].to_numpy(float)
    return Model(model.text, model.meta, _platt(z[0], y), _platt(z[1], y), model.good)


def score_features(features: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """``(doc_id, mark, text_score, meta_score, score, keep)`` of every row of ``featured``."""
    kind = features.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, N_TEXT + N_META)
            scores = [pa.array(np.round(s, 6)) for s in model.scores(x)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), *scores], names=names)

    names = ["doc_id", "mark", "text_score", "meta_score", "score"]
    scored = features.select("doc_id", "mark", "x").mapInArrow(
        batches, f"doc_id {kind}, mark bigint, text_score double, meta_score double, score double"
    )
    return scored.select("*", (F.col("score") >= keep_from).alias("keep"))


def score_documents(docs: DataFrame, labels: DataFrame, *, keep_from: float = KEEP_FROM, **options: str) -> DataFrame:
    """``(doc_id, mark, text_score, meta_score, score, keep)`` for every row of ``docs``.

    ``mark`` tells rows of one id apart.  Null and empty texts are scored like others, by
    features that are all zero in the text view.  Empty tables give an empty result.
    """
    features = featured(docs, labels, **options)
    return score_features(features, co_train(features), keep_from)


def good_documents(docs: DataFrame, labels: DataFrame, *, keep_from: float = KEEP_FROM, **options: str) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns; texts are not shuffled."""
    names = _NAMES | {k: v for k, v in options.items() if k in _NAMES}
    model = co_train(featured(docs, labels, **options))

    def score(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.Series:
        frame = pd.DataFrame({"text": text, "source": source, "lang": lang, "n_chars": n_chars})
        return pd.Series(np.round(model.scores(np.array(_featured(frame), dtype=np.float32).astype(float).reshape(-1, N_TEXT + N_META))[2], 6))

    have = set(docs.columns)
    columns = [(quoted(names[n]) if names[n] in have else F.lit(None)).cast(k) for n, k in
               (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "double"))]
    return docs.filter(F.pandas_udf(score, "double")(*columns) >= keep_from)
