"""Text quality from compression: a Zstandard dictionary of good texts and one of bad texts; a text that compresses better
with the good one is likelier good. The normalised size difference becomes a calibrated score."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The dictionary of no texts.
NOTHING = b"\n" * 8


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample, and of what is built from it.

    The sample is the `rows` labelled training rows with the smallest hash of their id, for each label. Whole texts are cut into
    pieces of `piece` bytes; of each text the `pieces` ones with the smallest hash, wherever they lie, feed the dictionaries.
    The sample falls into `folds` parts by hash: whole texts of a part, measured with dictionaries of the other parts, set the
    calibration; the dictionaries of the model are built from all parts. `dictionary_bytes` is the size of one dictionary.
    """

    rows: int = 2000
    pieces: int = 8
    dictionary_bytes: int = 112_640
    piece: int = 4096
    folds: int = 3
    level: int = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    level: int


def _compressors(good: bytes, bad: bytes, level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in (good, bad):
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def evidence(text: str, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, window: int = 256, soft: int = 64) -> tuple[float, float]:
    """(bad - good compressed bytes, text bytes), each over text bytes + `soft`. The text is compressed in windows, each alone, so
    that what a text repeats itself does not hide what the dictionaries know. An empty text has no evidence: (0, 0)."""
    data = text.encode()
    difference = sum(len(bad.compress(data[i : i + window])) - len(good.compress(data[i : i + window])) for i in range(0, len(data), window))
    return difference / (len(data) + soft), len(data) / (len(data) + soft)


def _dictionary(pieces: list[bytes], cfg: Training) -> bytes:
    try:
        return zstandard.train_dictionary(cfg.dictionary_bytes, pieces, level=cfg.level).as_bytes()
    except zstandard.ZstdError:  # too few texts for the builder: use them as they are
        return b"".join(pieces)[: cfg.dictionary_bytes] or NOTHING


def _spread_pieces(cfg: Training):
    """Pieces of whole texts: a row per piece that has one of the `pieces` smallest hashes of its text, and per model that
    learns from it, which are those of the other parts and the last one."""

    def run(batches):
        for batch in batches:
            out = []
            for key, label, part, text in zip(*[c.to_pylist() for c in batch.columns]):
                data = text.encode()
                cut = [data[i : i + cfg.piece] for i in range(0, len(data), cfg.piece)]
                ranked = sorted((xxhash.xxh64_intdigest(c, seed=i), i) for i, c in enumerate(cut))[: cfg.pieces]
                out.extend((m, label, key, i, cut[i]) for m in range(cfg.folds + 1) if m != part for _, i in ranked)
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["model", "label", "id", "at", "data"])

    return run


def _measured(dictionaries: dict[tuple[int, int], bytes], level: int):
    """(label, evidence) of whole texts, each by the dictionaries that have not seen its part."""

    def run(batches):
        ready = {}
        for batch in batches:
            rows = []
            for label, part, text in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                if part not in ready:
                    ready[part] = _compressors(dictionaries.get((part, 1), NOTHING), dictionaries.get((part, 0), NOTHING), level)
                rows.append((label, *evidence(text, *ready[part])))
            labels, first, second = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(first, pa.float64()), pa.array(second, pa.float64())], names=["label", "a", "b"])

    return run


def calibration(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, bias first, by Newton steps with shrunken targets and a weak prior."""
    positive, negative = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    design = np.concatenate([np.ones((len(x), 1)), x.reshape(len(x), -1)], axis=1)
    weights = np.zeros(design.shape[1])
    weights[0] = np.log((positive + 1) / (negative + 1))
    prior = np.full(len(weights), 1e-4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - target) + prior * weights
        curvature = (design * (p * (1 - p))[:, None]).T @ design + np.diag(prior)
        step = np.linalg.solve(curvature, gradient)
        weights = weights - np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return weights


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", cfg: Training = Training()) -> Model:
    """Build both dictionaries and the calibration from labelled rows that `usable` (on the id column) allows.

    Only ids and labels choose the sample; language and source are never seen. Pieces are cut and texts measured where
    they lie; a dictionary is built in one task from at most `rows` x `pieces` pieces.
    The calibration is set to the labels' shares among all usable rows. A row that repeats an id is used once.
    Without labels the model scores everything 0.5.
    """
    known = labels.select(F.col(f"`{id_column}`").cast("long").alias(id_column), F.col(f"`{label_column}`").cast("int").alias("label"))
    known = known.where(F.col(id_column).isNotNull() & F.col("label").isin(0, 1))
    if usable is not None:
        known = known.where(usable)
    known = known.dropDuplicates([id_column])
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two numbers
    parts = [known.where(F.col("label") == value).orderBy(F.xxhash64(id_column), id_column).limit(cfg.rows) for value in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 x rows ids
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias(id_column), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), id_column).dropDuplicates([id_column])
    sample = texts.select(F.col(id_column).alias("id"), "label", F.pmod(F.xxhash64(id_column), F.lit(cfg.folds)).cast("int").alias("part"), "text")

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["id"].to_pylist(), table["at"].to_pylist(), table["data"].to_pylist()))
        return pa.table({"model": table["model"][:1], "label": table["label"][:1], "data": pa.array([_dictionary([r[2] for r in rows], cfg)], pa.binary())})

    pieces = sample.mapInArrow(_spread_pieces(cfg), "model int, label int, id long, at long, data binary")
    built = pieces.groupBy("model", "label").applyInArrow(build, "model int, label int, data binary").collect()  # groups and results are bounded
    dictionaries = {(r["model"], r["label"]): bytes(r["data"]) for r in built}
    good, bad = (dictionaries.get((cfg.folds, value), NOTHING) for value in (1, 0))
    measured = sample.mapInArrow(_measured(dictionaries, cfg.level), "label int, a double, b double").collect()  # three numbers a row, at most 2 x rows
    if not measured:
        return Model(good, bad, (0.0, 0.0, 0.0), cfg.level)
    measured.sort()  # sums in one order, whatever task came first
    x, y = np.array([(r["a"], r["b"]) for r in measured]), np.array([float(r["label"]) for r in measured])
    weights = calibration(x, y)
    if 0 < y.sum() < len(y):  # the sample is even over the labels; the corpus is not
        weights[0] += float(np.log(totals[1] / totals[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return Model(good, bad, tuple(weights.tolist()), cfg.level)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every row: the calibrated probability that the text is good. Null counts as empty; an empty text has
    no evidence and gets the score of none. Rows that repeat an id are scored on their own."""

    def run(batches):
        good, bad = _compressors(model.good, model.bad, model.level)
        for batch in batches:
            x = np.array([evidence(t.as_py() or "", good, bad) for t in batch.column(1)], np.float64).reshape(-1, 2)
            z = np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -500, 500)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], names=[id_column, "score"])

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias(id_column), F.col(f"`{text_column}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_column}` long, score double")
