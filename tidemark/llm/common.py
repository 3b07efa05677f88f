"""Shared tables, ranks without a global sort, and word arithmetic over Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one vectorised step looks at; longer texts make a step of their own.
STEP_BYTES = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or the checkpoint folder already set.
    Only a local session without either gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts lineage, allows column pruning, and gives Spark the real
    size, so that it broadcasts only what is small."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_defaults(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the columns in `names` (old name to new name); a missing column becomes null."""
    return df.select(*[(F.col(f"`{old}`") if old in df.columns else F.lit(None)).alias(new) for old, new in names.items()])


def chunked_rank(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], rank: str) -> DataFrame:
    """Exact 0-based rank within `keys` along (`chunk`, `order`), never with a whole key in one task.

    `chunk` is a non-null number that does not decrease along the order. Each chunk is numbered on its own; the sizes of
    earlier chunks, one small row per chunk, are added.
    """
    spare = [c for c in ("__chunk", "__local", "__base", "__n") if c in df.columns]
    if spare:
        raise ValueError(f"columns {spare} are reserved")
    by = [*keys, "__chunk"]
    cut = df.withColumn("__chunk", chunk)
    sizes = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(by)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = cut.withColumn("__local", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    on = [F.col(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(by)]
    joined = local.join(bases, on).withColumn(rank, (F.col("__base") + F.col("__local")).cast("long"))
    return joined.drop("__chunk", "__local", "__base", *[f"__r{i}" for i in range(len(by))])


# ---------------------------------------------------------------------------------------------------------
# Arrow text columns as word arrays. Words are `[^\x20\x09-\x0D]+`.

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_PRIME, _INVERSE)):
            steps = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts: `starts`/`ends` (bytes in `data`), `doc` (row of each word), `first` (first word of each
    row, one more at the end), `hashes` (64 bits each)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        if lower:
            data = data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)
        self.data, self.offsets = data, offsets
        rows = len(offsets) - 1
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        opens = solid.copy()
        opens[1:] &= ~solid[:-1] | edge[1:-1]
        closes = solid
        closes[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        """Equal words have equal hashes in every task."""
        if self._hashes is None:
            up, down = _powers(len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
            self._hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        return self._hashes

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of all runs of `k` words that stay in their row."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = total * _PRIME + self.hashes[j : j + n]
        return at, mix(total[at] + np.uint64(k))

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def text_slices(batch: pa.RecordBatch, column: int, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into (first row, end row, bytes, offsets) steps of at most `limit` text bytes, or one row. Null is empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_slices(batch: pa.RecordBatch, column: int, lower: bool = False, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, Words]]:
    for at, end, data, offsets in text_slices(batch, column, limit):
        yield at, end, Words(data, offsets, lower)
