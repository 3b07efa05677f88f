"""Benchmark passages in training texts, found with spaced seeds and tolerant of substituted words.

A mask reads some positions of a run of tokens and ignores the rest, so a substituted token in an ignored position leaves
the hash unchanged. Hashes of all benchmark positions under all masks meet the hashes of all text positions; around each hit
benchmark and text are laid side by side, and the longest stretch that agrees well enough is accepted if it is long enough.

The benchmark is taken in blocks of bounded size, and every block is a hash table that meets all texts where they lie:
nothing is shuffled, and a passage that a third of all texts contain is ordinary work for every task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mix, shared_table

_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Seeds:
    """`masks`: 1 reads a token, 0 ignores it. Each has weight six within eight to eleven tokens, and six equal tokens by chance
    are rare. One of them is whole in every stretch of 13 to 25 tokens of which four in five agree (enumerated), and so in every
    longer one, as one of its halves agrees as well. Items below `least` tokens are looked up in parts, one of which is whole.
    A stretch is accepted with at least `least` tokens, or the whole item if it is shorter, of which `percent` agree.
    `block` tokens of the benchmark are held by a task at a time."""

    masks: tuple[str, ...] = ("11101011", "1101100101", "11010010111", "11111100", "1110001011")
    least: int = 13
    percent: int = 80
    block: int = 500_000


def tokens(text: str | None) -> list[str]:
    """Letters and digits, lower case; everything else separates."""
    return _TOKEN.findall(text.lower()) if text else []


def longest_stretch(agree: np.ndarray, least: int, percent: int) -> tuple[int, int]:
    """[start, end) of the longest stretch of which `percent` agree, the first one on ties; (0, 0) if it has fewer than `least`
    positions. Positions at its ends that do not agree are left off as long as `least` remain."""
    score = np.concatenate([[0], np.cumsum(np.where(agree, 100, 0) - percent)])
    start = np.searchsorted(-np.minimum.accumulate(score), -score)  # the first place that is no higher
    end = int(np.argmax(np.arange(len(score)) - start))
    start = int(start[end])
    if end - start < least:
        return 0, 0
    while end - start > least and not agree[end - 1]:
        end -= 1
    while end - start > least and not agree[start]:
        start += 1
    return start, end


class Block:
    """Hash table of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], cfg: Seeds) -> None:
        self.cfg = cfg
        split = [(i, tokens(t)) for i, t in items]
        words = sorted({w for _, t in split for w in t})
        self.codes = {w: n + 1 for n, w in enumerate(words)}  # 0: a word that no item has
        self.items = [(i, np.array([self.codes[w] for w in t], np.int64)) for i, t in split if t]
        self.masks = [np.flatnonzero(np.array(list(m)) == "1") for m in cfg.masks]
        keys, item, at = [], [], []
        short = set()
        for n, (_, codes) in enumerate(self.items):
            if len(codes) < cfg.least:  # one part more than words that may differ: one of them is whole
                edges = np.linspace(0, len(codes), len(codes) * (100 - cfg.percent) // 100 + 2).astype(int).tolist()
                for b, e in zip(edges, edges[1:]):
                    keys.append(self._whole(codes[b:e], e - b))
                    item.append(np.array([n]))
                    at.append(np.array([b]))
                    short.add(e - b)
                continue
            for k, (mask, text) in enumerate(zip(self.masks, cfg.masks, strict=True)):
                found = self._hash(codes, mask, len(text), k)
                keys.append(found)
                item.append(np.full(len(found), n))
                at.append(np.arange(len(found)))
        self.short = sorted(short)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item, self.at = (np.concatenate(x)[order] if len(keys) else np.zeros(0, np.int64) for x in (item, at))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _hash(self, codes: np.ndarray, mask: np.ndarray, span: int, k: int) -> np.ndarray:
        n = len(codes) - span + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.full(n, k + 1, np.uint64)
        for j in mask:
            total = total * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n].astype(np.uint64)
        return mix(total)

    def _whole(self, codes: np.ndarray, n: int) -> np.ndarray:
        return self._hash(codes, np.arange(n), n, 100 + n)

    def hits(self, codes: np.ndarray) -> set[tuple[int, int]]:
        """(item, offset of the item's first token in the text) of every equal hash."""
        found: set[tuple[int, int]] = set()
        looks = [self._hash(codes, mask, len(text), k) for k, (mask, text) in enumerate(zip(self.masks, self.cfg.masks, strict=True))]
        looks += [self._whole(codes, n) for n in self.short]
        for hashes in looks:
            maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            low, high = np.searchsorted(self.keys, hashes[maybe]), np.searchsorted(self.keys, hashes[maybe], "right")
            for position, b, e in zip(maybe[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                found.update((int(self.item[r]), position - int(self.at[r])) for r in range(b, e))
        return found

    def overlaps(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """Accepted (item id, first token in the text, end, equal tokens, tokens of the item): the best one per item and offset, not nested."""
        split = tokens(text)
        codes = np.array([self.codes.get(w, 0) for w in split], np.int64)
        if not codes.any():
            return []
        out = {}
        for n, offset in self.hits(codes):
            name, item = self.items[n]
            b, e = max(offset, 0), min(offset + len(item), len(codes))
            agree = item[b - offset : e - offset] == codes[b:e]
            start, end = longest_stretch(agree, min(self.cfg.least, len(item)), self.cfg.percent)
            if end > start:
                key = (name, b + start)
                out[key] = max(out.get(key, (0, 0, 0)), (int(agree[start:end].sum()), b + end, len(item)))
        return [(name, start, end, equal, size) for (name, start), (equal, end, size) in sorted(out.items())]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", cfg: Seeds = Seeds()) -> DataFrame:
    """(id, item_id, first_token, end_token, equal_tokens, item_tokens): every verified overlap of a row of `docs` with a benchmark item.

    Rows without one do not appear. Null and empty texts or items overlap with nothing; a null id is carried as null; rows
    and items that repeat are each reported. An empty benchmark or table gives no rows. Benchmark columns: item_id, text.
    """
    spark = docs.sparkSession
    schema = "id long, item_id long, first_token long, end_token long, equal_tokens long, item_tokens long"
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # Blocks: bins of the item hash, one row per bin and a running size over the bins; a bin is far smaller than a block.
    sized = items.withColumn("bin", F.pmod(F.xxhash64("item_id", "text"), F.lit(4096)))
    bins = sized.groupBy("bin").agg(F.sum(F.length("text") / 2 + 1).alias("size"))
    running = F.sum("size").over(Window.orderBy("bin"))
    placed = shared_table(sized.join(bins.select("bin", F.floor(running / cfg.block).cast("int").alias("block")), "bin").select("block", "item_id", "text"), "seed-items")
    found = None
    for (number,) in placed.select("block").distinct().orderBy("block").collect():
        rows = [(r["item_id"], r["text"]) for r in placed.where(F.col("block") == number).orderBy("item_id", "text").collect()]  # one block, of bounded size

        def run(batches, rows=rows):
            block = Block(rows, cfg)
            for batch in batches:
                out = [[] for _ in range(6)]
                for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                    for overlap in block.overlaps(text.as_py()):
                        for column, value in zip(out, (doc.as_py(), *overlap), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in schema.split(", ")])

        part = shared_table(source.mapInArrow(run, schema), "seed-overlaps")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumnRenamed("id", id_column)
