"""Token ids as flat binary files with 64-bit offsets.

A data set is a folder of shards in ascending id order. Shard k has three flat little-endian files: `tokens` (unsigned 16- or
32-bit ids, by the size of the vocabulary), `docs` (signed 64-bit id and unsigned 64-bit token count per document) and
`offsets` (unsigned 64-bit place of each document's first id in the whole data set, and one more for the end). A Parquet
manifest lists the shards with their bases, which are prefix sums over the shards' counts. A reader maps `offsets` and
`tokens` into memory and slices.
"""

from __future__ import annotations

import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import _powers, mix, shared_table
from tidemark.llm.files import read_mapped, write_stream

#: The id that stands for null in `docs`.
NULL_ID = -(1 << 63)
_TWO_SPACES = re.compile(r" \s* ")
#: Kinds of bytes: letters (ASCII here; two-byte Latin ones are found in their place), stops, a line end, others.
_LETTER, _STOP, _LINE = 1, 2, 3
_KIND = np.zeros(256, np.int64)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[ord(c) for c in ".,;:!?"]] = _STOP
_KIND[10] = _LINE
#: Orders of kinds in which every run of a kind is encoded apart, as numbers to the base 4, the first digit lowest.
_APART = np.array(sorted(sum(k * 4**i for i, k in enumerate(kinds)) for kinds in ([1], [1, 2], [1, 2, 3], [1, 3], [1, 3, 1], [1, 2, 3, 1], [1, 3, 1, 2], [1, 2, 3, 1, 2])))


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the parts of some texts that byte-level tokenizers encode independently.

    A text is cut before every space (it must not have two in one run of white space). A piece of a space and letters, with
    stops or one line end and letters behind, is cut between these runs too; any other piece stays whole, and so does the
    first one of a text, which has no space."""
    n = len(data)
    opens = data == 32
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    kind = _KIND[data]
    two = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)  # U+00C0 to U+00FF; two of them are no letters
    two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
    kind[two] = kind[two + 1] = _LETTER
    spaced = opens & (data == 32)
    kind[spaced] = _LETTER
    first = opens.copy()
    first[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(first)
    if not len(runs):
        return runs, runs
    sizes, kinds = np.diff(runs, append=n), kind[runs]
    heads = np.flatnonzero(opens[runs])
    count = np.diff(heads, append=len(runs))
    piece = np.repeat(np.arange(len(heads)), count)
    place = np.arange(len(runs)) - heads[piece]
    odd = (kinds == 0) | (place > 4) | ((kinds == _LINE) & (sizes > 1))
    code = np.add.reduceat(np.where(odd, 1 << 40, kinds << (2 * np.minimum(place, 5))), heads)
    apart = np.isin(code, _APART) & spaced[runs[heads]] & (sizes[heads] > 1)
    starts = runs[(place == 0) | apart[piece]]
    return starts, np.append(starts[1:], n)


class Encoder:
    """Token ids of whole texts. Texts are cut into units that are encoded independently (see `units`); each distinct unit goes
    through the tokenizer once, and a batch of units is looked up at once by two 64-bit hashes. A text with two spaces in one
    run of white space, or with a special token's name, is encoded as a whole. The table is emptied when it is full; it changes
    speed only, and stays with the Python process for later tasks."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str, size: int = 1_500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content})
        self.random = np.random.default_rng(11).integers(1, 1 << 62, (2, 256)).astype(np.uint64)
        self.most = size
        self._clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _clear(self) -> None:
        self.keys, self.checks, self.at, self.many = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids if text else [], self.dtype)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = _powers(len(data) + 1)
        out = []
        for table in self.random:
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * up[: len(data)], out=sums[1:])
            out.append(mix((sums[ends] - sums[starts]) * down[starts]))
        return out[0], out[1]

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted keys stand in the table, and whether they do."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, texts: list[str]) -> None:
        lists = []
        for b in range(0, len(texts), 5000):
            lists.extend(e.ids for e in self.tokenizer.encode_batch_fast(texts[b : b + 5000], add_special_tokens=False))  # without character offsets
        many = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(many.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.dtype)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), self.dtype, total)
        at = self.used + np.concatenate([[0], np.cumsum(many)[:-1]])
        self.used += total
        into = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, into, keys), np.insert(self.checks, into, checks)
        self.at, self.many = np.insert(self.at, into, at), np.insert(self.many, into, many)

    def _looked_up(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(place in the table of every unit, first unit of every text and the end); None if two units share a hash."""
        starts, ends = units(data, offsets)
        hashes, checks = self._hashes(data, starts, ends)
        if len(self.keys) > self.most:
            self._clear()
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        at, known = self._places(distinct)
        if not (checks[first][where] == checks).all() or not (self.checks[at[known]] == checks[first][known]).all():
            return None
        if not known.all():
            new, raw = first[~known], data.tobytes()
            self._learn(distinct[~known], checks[new], [raw[b:e].decode() for b, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at, _ = self._places(distinct)
        return at[where], np.searchsorted(starts, offsets)

    def _encoded(self, texts: list[str], ids: bool) -> list:
        """Per text its ids, or their number."""
        plain = [not (_TWO_SPACES.search(t) or any(s in t for s in self.special)) for t in texts]
        raw = [t.encode() for t, p in zip(texts, plain, strict=True) if p]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))]).astype(np.int64)
        found = self._looked_up(data, offsets)
        if found is None:
            return [w if ids else len(w) for w in map(self._whole, texts)]
        at, first = found
        many = self.many[at]
        ends = np.concatenate([[0], np.cumsum(many)])[first]
        if ids:
            flat = self.pool[np.arange(ends[-1]) + np.repeat(self.at[at] - np.concatenate([[0], np.cumsum(many)[:-1]])[: len(many)], many)]
            own = iter([flat[b:e] for b, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        else:
            own = iter(np.diff(ends).tolist())
        return [next(own) if p else (w if ids else len(w)) for t, p in zip(texts, plain, strict=True) for w in [None if p else self._whole(t)]]

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, packed."""
        return [x.tobytes() for x in self._encoded(texts, True)]

    def counts(self, texts: list[str]) -> list[int]:
        """How many ids every text has."""
        return self._encoded(texts, False)


def _steps(texts: list[str], limit: int = 2_000_000):
    """Runs of texts of at most `limit` characters, or one text."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield at, i
            at, size = i, 0
        size += len(text)
    if texts:
        yield at, len(texts)


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens): ids of the text and one end id. Null texts count as empty."""

    def run(batches):
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            counts = [n + 1 for b, e in _steps(texts) for n in encoder.counts(texts[b:e])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_tokens long").withColumnRenamed("id", id_column)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the data set and return its manifest: (shard, docs, tokens, base_doc, base_token, width, tokens_file, docs_file, offsets_file).

    Order is by id, then text; null ids come first, null texts are empty, rows that repeat are written each time. An empty
    table gives an empty manifest. A lost task is run again under new file names, and the manifest names only the files of
    the attempt that ended.
    """
    schema = "shard long, docs long, tokens long, width int, tokens_file string, docs_file string"

    def write(batches):
        shard, mark = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        encoder, files, docs_seen, tokens_seen = None, None, 0, 0
        names = [f"{folder}/{kind}-{shard:06d}-{mark}.bin" for kind in ("tokens", "docs")]
        for batch in batches:
            if not len(batch):
                continue
            if encoder is None:
                encoder = Encoder.of(tokenizer)
                end = np.array([end_id], encoder.dtype).tobytes()
                files = [write_stream(n) for n in names]
            texts = [t.as_py() or "" for t in batch.column(1)]
            ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            for b, e in _steps(texts):
                packed = encoder.batch(texts[b:e])
                rows = np.empty((e - b, 2), "<i8")
                rows[:, 0], rows[:, 1] = ids[b:e], [len(p) // encoder.dtype.itemsize + 1 for p in packed]
                files[0].write(b"".join(part for p in packed for part in (p, end)))
                files[1].write(rows.tobytes())
                docs_seen, tokens_seen = docs_seen + e - b, tokens_seen + int(rows[:, 1].sum())
        if files:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "docs": docs_seen, "tokens": tokens_seen, "width": encoder.dtype.itemsize, "tokens_file": names[0], "docs_file": names[1]}],
                                             schema=pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("width", pa.int32()), ("tokens_file", pa.string()), ("docs_file", pa.string())]))

    def offsets(batches):
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                name = row["docs_file"].replace("/docs-", "/offsets-")
                at = row["base_token"]
                with read_mapped(row["docs_file"]) as source, write_stream(name) as out:
                    while piece := source.read_buffer(1 << 24):
                        ends = at + np.cumsum(np.frombuffer(piece, "<i8").reshape(-1, 2)[:, 1])
                        out.write(np.concatenate([[at], ends[:-1]]).astype("<u8").tobytes())
                        at = int(ends[-1])
                    out.write(np.array([at], "<u8").tobytes())
                names.append(name)
            yield batch.append_column("offsets_file", pa.array(names, pa.string()))

    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    parts = source.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text").mapInArrow(write, schema)
    parts = shared_table(parts, "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    based = parts.withColumns({f"base_{k}": F.coalesce(F.sum(f"{k}s").over(before), F.lit(0)) for k in ("doc", "token")})
    columns = ["shard", "docs", "tokens", "base_doc", "base_token", "width", "tokens_file", "docs_file"]
    fields = "shard long, docs long, tokens long, base_doc long, base_token long, width int, tokens_file string, docs_file string, offsets_file string"
    shards = parts.count()
    return shared_table(based.select(*columns).repartition(max(shards, 1)).mapInArrow(offsets, fields), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, step: int = 4096) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files: its place in the data set, its ids with the end
    id, and the checksum of those ids as unsigned 32-bit numbers. Each task maps one shard and reads `step` documents at a time."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with read_mapped(row["docs_file"]) as docs, read_mapped(row["offsets_file"]) as offsets, read_mapped(row["tokens_file"]) as tokens:
                    for at in range(0, row["docs"], step):
                        n = min(step, row["docs"] - at)
                        ids = np.frombuffer(docs.read_at(16 * n, 16 * at), "<i8").reshape(-1, 2)[:, 0]
                        places = np.frombuffer(offsets.read_at(8 * (n + 1), 8 * at), "<u8").astype(np.int64)
                        sums = []
                        for b, e in zip(places[:-1] - row["base_token"], places[1:] - row["base_token"], strict=True):
                            part = np.frombuffer(tokens.read_at(int(e - b) * row["width"], int(b) * row["width"]), f"<u{row['width']}")
                            sums.append(zlib.crc32(part.astype("<u4").tobytes()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(places[:-1]), pa.array(np.diff(places)), pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"]
                        )

    return manifest.repartition(max(manifest.count(), 1)).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
