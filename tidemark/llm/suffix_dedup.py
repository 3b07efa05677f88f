"""Removal of repeated passages with prefix-partitioned, sparse suffix trees.

Only some suffixes are needed: in every run of `window` words the smallest hash of a short gram marks an anchor, and equal
windows have equal anchors. A suffix starts at an anchor; the words before it that its windows reach are kept with it.

1. Prefixes: the gram at an anchor is its suffix's prefix. Prefixes that occur in one text only head a lone leaf and are pruned.
2. Groups: suffixes with the same prefix form a group. Where a prefix is crowded, the windows are dealt out by their whole
   length instead, the longest prefix there is; so a group stays small.
3. Trees: sorting a group's windows lists the leaves of its tree, cut at `window` words, depth first. Neighbours meet in a
   node `window` words deep if they are equal; a node with leaves of two documents is a repeat. Longer repeats are chains of
   such nodes, joined again in the documents.

Each task keeps for every distinct stretch the document that comes first; later documents of the same task are repeats
already and take no further part. So a passage that a third of all documents share costs one leaf per task, not one per
document.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Words, shared_path, shared_table, word_slices


@dataclass(frozen=True)
class Trees:
    """`anchor` words per prefix; suffixes wanted in a group; table size of the prefix counts (with more than slots x group
    suffixes all prefixes count as crowded, which costs space but stays right); rows that a task gathers before it combines them."""

    window: int = 13
    anchor: int = 6
    group: int = 50_000
    slots: int = 1 << 20
    gather: int = 400_000


def anchors(words: Words, cfg: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows' first words, index of each window's anchor in the gram list, the grams' first words and hashes)."""
    at, hashes = words.grams(cfg.anchor)
    span = cfg.window - cfg.anchor + 1
    if len(at) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), at, hashes
    views = np.lib.stride_tricks.sliding_window_view(hashes, span)
    whole = at[span - 1 :] - at[: len(at) - span + 1] == span - 1  # grams of one text follow each other
    starts = np.flatnonzero(whole)
    chosen = np.empty(len(starts), np.int64)
    for b in range(0, len(starts), 65_536):
        part = starts[b : b + 65_536]
        chosen[b : b + 65_536] = views[part].argmin(axis=1) + part
    return at[starts], chosen, at, hashes


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _short(digest: bytes) -> int:
    """40 bits that stand for a text while anchors are counted: if two texts share them, some windows are looked at for nothing."""
    return int.from_bytes(digest[:5], "little")


def _base(batches):
    """Per row: id, number of words, digest of the words, and its short form."""
    for batch in batches:
        counts, digests = [], []
        for text in batch.column(1):
            split = (text.as_py() or "").encode().split()
            counts.append(len(split))
            digests.append(_digest(split))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array([_short(d) for d in digests], pa.int64())], names=["id", "n_words", "digest", "tid"]
        )


def _own_text(batches):
    """Rows (id, text, digest, ..) whose text is the one that the digest stands for."""
    for batch in batches:
        own = [_digest(t.as_py().encode().split()) == d.as_py() for t, d in zip(batch.column(1), batch.column(2), strict=True)]
        yield batch.filter(pa.array(own, pa.bool_())).drop_columns(["digest"])


def _anchor_rows(cfg: Trees):
    """(hash, text, known): one row per anchor that the gathered texts hold; texts that share an anchor inside the task are
    known to share it, so that no anchor piles up."""

    def combine(hashes, texts):
        order = np.lexsort((texts, hashes))
        hashes, texts = hashes[order], texts[order]
        new_hash = np.ones(len(hashes), bool)
        new_hash[1:] = hashes[1:] != hashes[:-1]
        new = new_hash.copy()
        new[1:] |= texts[1:] != texts[:-1]
        hashes, texts, new_hash = hashes[new], texts[new], new_hash[new]
        group = np.cumsum(new_hash) - 1
        shared = np.bincount(group)[group] > 1
        known = np.repeat([False, True], [int(new_hash.sum()), int(shared.sum())])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([c[new_hash], c[shared]])) for c in (hashes, texts)] + [pa.array(known)], names=["hash", "text", "known"])

    def run(batches):
        gathered, count = [], 0
        for batch in batches:
            texts = np.array([_short(_digest((t.as_py() or "").encode().split())) for t in batch.column(0)], np.int64)
            for at, _, words in word_slices(batch, 0):
                _, chosen, grams, hashes = anchors(words, cfg)
                chosen = np.unique(chosen)
                gathered.append((hashes[chosen].view(np.int64), texts[at + words.doc[grams[chosen]]]))
                count += len(chosen)
                if count > cfg.gather:
                    yield combine(*[np.concatenate([g[i] for g in gathered]) for i in range(2)])
                    gathered, count = [], 0
        if gathered:
            yield combine(*[np.concatenate([g[i] for g in gathered]) for i in range(2)])

    return run


def _shared_anchors(batches):
    """Rows sorted by (known, hash): those known, and those whose hash two texts have. A hash that goes on in the next batch is kept."""
    kept = None
    for batch in batches:
        hashes, texts, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if kept is not None:
            hashes, texts, known = (np.concatenate(x) for x in zip(kept, (hashes, texts, known), strict=True))
        if not len(hashes):
            continue
        other = np.flatnonzero((hashes != hashes[-1]) | (known != known[-1]))
        last = int(other[-1]) + 1 if len(other) else 0
        kept = tuple(c[last:] for c in (hashes, texts, known))
        yield _several(hashes[:last], texts[:last], known[:last])
    if kept is not None:
        yield _several(*kept)


def _several(hashes, texts, known):
    begins = np.ones(len(hashes), bool)
    begins[1:] = (hashes[1:] != hashes[:-1]) | (known[1:] != known[:-1])
    at = np.flatnonzero(begins)
    if len(at):
        differ = np.minimum.reduceat(texts, at) < np.maximum.reduceat(texts, at)
        keep = known.astype(bool) | differ[np.cumsum(begins) - 1]
        hashes, texts = hashes[keep], texts[keep]
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(hashes, pa.int64())], names=["tid", "hash"])


def _stretches(batch: pa.RecordBatch, cfg: Trees):
    """For rows (id, text, dup, hashes): (row, its words, first window of each stretch, windows in it, anchor hash). A stretch is
    the windows that have one shared anchor; they follow each other."""
    for at, end, words in word_slices(batch, 1):
        starts, chosen, _, hashes = anchors(words, cfg)
        cut = np.searchsorted(words.doc[starts], np.arange(end - at + 1))
        for row in range(at, end):
            b, e = cut[row - at], cut[row - at + 1]
            begins = np.flatnonzero(np.concatenate([[True], chosen[b + 1 : e] != chosen[b : e - 1]])) if e > b else np.zeros(0, np.int64)
            own = hashes[chosen[b:e][begins]]
            shared = np.isin(own, np.array(batch.column(3)[row].as_py(), np.int64).view(np.uint64))
            sizes = np.diff(np.concatenate([begins, [e - b]]))
            yield row, batch.column(1)[row].as_py().encode().split(), (starts[b:e][begins] - words.first[row - at])[shared], sizes[shared], own[shared]


def _slot(hashes: np.ndarray, cfg: Trees) -> np.ndarray:
    return ((hashes >> np.uint64(17)) % np.uint64(cfg.slots)).astype(np.int64)


def _prefix_counts(cfg: Trees):
    def run(batches):
        found, counts = [], []
        for batch in batches:
            for _, _, _, _, own in _stretches(batch, cfg):
                found.append(_slot(own, cfg))
            slots, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            found = []
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(n, pa.int64())], names=["slot", "n"])

    return run


def crowded_prefixes(leads: DataFrame, cfg: Trees) -> np.ndarray:
    """Which slots of prefix hashes hold more than `group` suffixes: at most `slots` numbers."""
    counts = leads.mapInArrow(_prefix_counts(cfg), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > cfg.group)
    crowded = np.zeros(cfg.slots, bool)
    crowded[[r["slot"] for r in counts.select("slot").collect()]] = True
    return crowded


_LEAVES = "group long, words binary, n int, doc long, dup int, pos int, known boolean"


def _leaves(cfg: Trees, crowded: np.ndarray):
    """(group, words, n, doc, dup, pos, known): n windows from `pos` on in `words`, for the tree of `group`; or, without words,
    windows that are known to repeat."""
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())

    def combine(leaves):
        out = [[] for _ in kinds]
        for (group, n, words), found in leaves.items():
            low = min(found)[0]
            for doc, dup, pos in found:
                known = doc > low
                for column, value in zip(out, (doc if known else group, None if known else words, n, doc, dup, pos, known), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[f.split()[0] for f in _LEAVES.split(", ")])

    def run(batches):
        leaves, count = {}, 0
        for batch in batches:
            docs, dups = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, split, firsts, sizes, own in _stretches(batch, cfg):
                full = crowded[_slot(own, cfg)].tolist()
                for pos, n, group, many in zip(firsts.tolist(), sizes.tolist(), own.view(np.int64).tolist(), full, strict=True):
                    if not many:
                        leaves.setdefault((group, n, b" ".join(split[pos : pos + n - 1 + cfg.window])), []).append((docs[row], dups[row], pos))
                        count += 1
                        continue
                    for p in range(pos, pos + n):  # the longest prefix: the window itself
                        words = b" ".join(split[p : p + cfg.window])
                        leaves.setdefault((int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True), 1, words), []).append((docs[row], dups[row], p))
                        count += 1
                if count > cfg.gather:
                    yield combine(leaves)
                    leaves, count = {}, 0
        if leaves:
            yield combine(leaves)

    return run


def deep_nodes(leaves: list[tuple[bytes, int, int, int]]):
    """The leaves (suffix, doc, dup, pos) of one tree in depth-first order: of every node at full depth, those of later
    documents than its first."""
    node, first = None, None
    for suffix, doc, dup, pos in sorted(leaves):
        if suffix != node:
            node, first = suffix, doc
        elif doc > first:
            yield doc, dup, pos


def _repeats(cfg: Trees):
    """Rows sorted by group: (doc, dup, pos, mask) with a bit for every repeated window from `pos` on."""

    def masks(found):
        out = {}
        for doc, dup, pos in found:
            key = (doc, dup, pos // 32)
            out[key] = out.get(key, 0) | 1 << pos % 32
        return [(doc, dup, 32 * block, mask) for (doc, dup, block), mask in out.items()]

    def run(batches):
        group, leaves = None, []
        for batch in batches:
            rows, known = [], []
            for g, words, n, doc, dup, pos, repeat in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if repeat:
                    known.extend((doc, dup, p) for p in range(pos, pos + n))
                    continue
                if g != group:
                    rows += deep_nodes(leaves)
                    group, leaves = g, []
                split = words.split()
                leaves.extend((b" ".join(split[i : i + cfg.window]), doc, dup, pos + i) for i in range(n))
            yield _table(masks(rows + known))
        yield _table(masks(deep_nodes(leaves)))

    def _table(rows):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["id", "dup", "pos", "mask"])

    return run


def _cut(cfg: Trees):
    """Rows (id, dup, text, [(dup, pos, mask)]): how many words the repeated windows cover, and the text without them."""

    def run(batches):
        for batch in batches:
            removed, kept = [], []
            for dup, text, blocks in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                split = text.as_py().encode().split()
                at = np.array(sorted({b["pos"] + i for b in blocks.as_py() if b["dup"] == dup for i in range(32) if b["mask"] >> i & 1}), np.int64)
                edge = np.bincount(at, minlength=len(split) + 1) - np.bincount(at + cfg.window, minlength=len(split) + 1)
                keep = np.cumsum(edge)[:-1] == 0
                removed.append(int((~keep).sum()))
                kept.append(b" ".join([w for w, k in zip(split, keep.tolist(), strict=True) if k]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "dup", "removed", "kept"])

    return run


def _by_id(df: DataFrame, name: str) -> DataFrame:
    """A shared table in buckets of `id`, as `df` lies already: a later join on `id` reads it in place."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").option("path", shared_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only; the files stay with the frame that reads them
    return out


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cfg: Trees = Trees()) -> DataFrame:
    """(id, n_words, digest, copy, removed, kept) of every row: how many of its words repeat a smaller id's passage.

    `kept` is the text that stays, its words joined by one space, for rows that lose some of their words; it is null for
    rows that lose none and for a `copy`, a row with all words of a row with a smaller id, which loses everything if it is
    at least a window long. Windows are judged on the input. Null texts have no words. Rows with a null id neither lose
    words nor take any. Rows that repeat an id take nothing from each other.
    """
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    base = shared_table(source.mapInArrow(_base, "id long, n_words long, digest binary, tid long"), "suffix_base")
    able = F.col("id").isNotNull() & (F.col("n_words") >= cfg.window)
    first = base.where(able).groupBy("digest", "tid").agg(F.min("id").alias("id"))
    # `dup` tells apart different texts under one id; it is 0 almost everywhere.
    first = shared_table(first.withColumn("dup", F.row_number().over(Window.partitionBy("id").orderBy("digest")) - 1), "suffix_first")
    marked = base.drop("tid").join(first.select("id", "digest", "dup"), ["id", "digest"], "left")
    rows = marked.select("id", "n_words", "digest", "dup", (able & F.col("dup").isNull()).alias("copy"))

    # Prefixes in two different texts; copies of a text count as one.
    sparse = source.where("id IS NOT NULL").select("text").mapInArrow(_anchor_rows(cfg), "hash long, text long, known boolean")
    dealt = sparse.repartition(F.when(F.col("known"), F.col("text")).otherwise(F.col("hash"))).sortWithinPartitions("known", "hash")
    per_text = dealt.mapInArrow(_shared_anchors, "tid long, hash long").groupBy("tid").agg(F.collect_set("hash").alias("hashes"))
    wanted = per_text.join(first, "tid").select("id", "digest", "dup", "hashes")
    leads = source.join(wanted, "id").select("id", "text", "digest", "dup", "hashes").mapInArrow(_own_text, "id long, text string, dup int, hashes array<long>")
    leads = _by_id(leads, "suffix_leads")

    leaves = leads.mapInArrow(_leaves(cfg, crowded_prefixes(leads, cfg)), _LEAVES)
    repeats = leaves.repartition("group").sortWithinPartitions("group").mapInArrow(_repeats(cfg), "id long, dup int, pos int, mask long")
    per_id = repeats.groupBy("id").agg(F.collect_list(F.struct("dup", "pos", "mask")).alias("blocks"))
    cut = leads.join(per_id, "id").select("id", "dup", "text", "blocks").mapInArrow(_cut(cfg), "id long, dup int, removed long, kept string").dropDuplicates(["id", "dup"])
    joined = rows.join(cut, ["id", "dup"], "left")
    return joined.select("id", "n_words", "digest", "copy", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("removed"), "kept")
