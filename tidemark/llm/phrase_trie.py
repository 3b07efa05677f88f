"""Phrases whose words occur together more often than their parts do, counted with a burstable hash trie.

A task walks its texts and counts phrases in a trie over word ids that is a few digits deep. Its leaves are hash containers;
one that is too full bursts into sixteen by the next digit of the first word. When the trie holds too many phrases, its
largest subtree is spilled whole, as a run sorted by words. Runs meet in prefix partitions (the first word, or two or three
where that prefix is very common), where they are merged in order, so equal phrases are neighbours.

Counting goes from short to long. Words come first, then pairs of words that are frequent themselves, then longer phrases of
frequent pairs: a phrase cannot occur more often than its parts. Tasks know the frequent ones from a bit table of bounded size
with one bit per hash. A wrong "frequent" costs a row in a run and nothing else, as the merge keeps exact counts only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Words, mix, shared_table, text_slices
from tidemark.llm.common import _powers as powers

#: Fixed by definition: pieces end at these characters; words inside them are split at blanks and tabs.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in PIECE_ENDS]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Mining:
    """Phrases of 2 to `longest` words that occur `least` times or more; the first `top` of each language. `hold` phrases in a
    task's trie make it spill, `burst` phrases make a container burst, down to `levels` digits. Prefixes that begin more than
    one in `common` of all words are lengthened. The bit tables have `bits` (log2) bits at most."""

    longest: int = 4
    least: int = 30
    percent: int = 80
    top: int = 2000
    hold: int = 800_000
    burst: int = 65_536
    levels: int = 2
    common: int = 1024
    bits: int = 26
    slice_bytes: int = 2_000_000


def _tables(seed: int) -> np.ndarray:
    """A random number for every byte, twice: for ids and for the check of ids."""
    return np.random.default_rng(seed).integers(1, 1 << 63, (2, 256), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Pieces(Words):
    """Words of lower-cased texts, with `piece` (equal inside one piece of one text) and `ids`, which tell languages apart."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, language: np.ndarray, tables: np.ndarray) -> None:
        low = data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)
        ends = _ENDS[low]
        super().__init__(np.where(ends, np.uint8(32), low), offsets)
        before = np.zeros(len(low) + 1, np.int64)
        np.cumsum(ends, out=before[1:])
        self.piece = before[self.starts] + self.doc
        self.language, self.tables = language, tables

    def numbers(self, which: int) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(self.tables[which][self.data] * up[: len(self.data)], out=sums[1:])
        found = mix(mix((sums[self.ends] - sums[self.starts]) * down[self.starts]) ^ self.language[self.doc])
        return np.maximum(found, np.uint64(1))  # 0 stands for no word

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at these places."""
        sizes = (self.ends - self.starts)[at]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        bytes_at = np.arange(offsets[-1]) + np.repeat(self.starts[at] - offsets[:-1], sizes)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(self.data[bytes_at].tobytes()))


def _language_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For every row a 64-bit number of its language and its place in the list of languages; null is `und`."""
    coded = pc.fill_null(column.cast(pa.string()), "und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    numbers = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64)
    places = coded.indices.to_numpy()
    return numbers[places] if len(names) else np.zeros(0, np.uint64), places, names


def _pieces(batch: pa.RecordBatch, tables: np.ndarray, cfg: Mining):
    """(pieces, place of each row's language, names) of a batch with the columns text and lang."""
    numbers, places, names = _language_numbers(batch.column(1))
    for at, end, data, offsets in text_slices(batch, 0, cfg.slice_bytes):
        pieces = Pieces(data, offsets, numbers[at:end], tables)
        if len(pieces.starts):
            yield pieces, places[at:end], names


def _count_words(tables: np.ndarray, cfg: Mining):
    """(id, lang, word, n). Words are counted by id in the task; should two words of the task have one id, both are emitted."""

    def rows(part):
        ids, counts, _, lang, word = part
        return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), lang, word.cast(pa.string()), pa.array(counts)], names=["id", "lang", "word", "n"])

    def merged(part):
        """Equal ids once, and the rows of ids that are another word's."""
        ids, counts, check, lang, word = part
        unique, first, where = np.unique(ids, return_index=True, return_inverse=True)
        clash, take = np.flatnonzero(check != check[first][where]), pa.array(first)
        again = (ids[clash], np.zeros(len(clash), np.int64), None, lang.take(pa.array(clash)), word.take(pa.array(clash)))
        return (unique, np.bincount(where, weights=counts).astype(np.int64), check[first], lang.take(take), word.take(take)), again

    def joined(parts):
        return (*[np.concatenate([p[k] for p in parts]) for k in range(3)], *[pa.concat_arrays([p[k] for p in parts]) for k in (3, 4)])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for pieces, places, names in _pieces(batch, tables, cfg):
                ids, check, language = pieces.numbers(0), pieces.numbers(1), pa.array(names)
                unique, first, where, counts = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
                for at in (first, np.flatnonzero(check != check[first][where])):  # the second is empty, or clashes
                    if len(at):
                        parts.append((ids[at], counts if at is first else np.zeros(len(at), np.int64), check[at], language.take(pa.array(places[pieces.doc[at]])), pieces.strings(at)))
                        held += len(at)
                if held > cfg.hold:
                    kept, again = merged(joined(parts))
                    parts, held = [kept], len(kept[0])
                    if len(again[0]):
                        yield rows(again)
                    if held > cfg.hold // 2:
                        yield rows(kept)
                        parts, held = [], 0
        if parts:
            for part in merged(joined(parts)):
                if len(part[0]):
                    yield rows(part)

    return run


# ---------------------------------------------------------------------------------------------------------
# The trie.


def path_hash(paths: np.ndarray) -> np.ndarray:
    """64 bits of every row of word ids, never 0 (an empty slot)."""
    total = np.zeros(len(paths), np.uint64)
    for j in range(paths.shape[1]):
        total = mix(total * _STEP + paths[:, j] + np.uint64(j + 1))
    return total | np.uint64(1)


class Container:
    """A hash table of phrases with open addressing; one numpy step looks up a whole batch."""

    def __init__(self, width: int, capacity: int = 1024) -> None:
        self.width, self.used = width, 0
        self.keys, self.paths, self.counts = np.zeros(capacity, np.uint64), np.zeros((capacity, width), np.uint64), np.zeros(capacity, np.int64)

    def add(self, keys: np.ndarray, paths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Count a batch; returns the places of phrases whose hash is another phrase's (they are counted elsewhere)."""
        while 2 * (self.used + len(keys)) > len(self.keys):
            self._grow()
        mask = np.uint64(len(self.keys) - 1)
        slot, open_ = ((keys >> np.uint64(20)) & mask).astype(np.int64), np.arange(len(keys))
        while len(open_):
            at, key = slot[open_], keys[open_]
            found = self.keys[at]
            free = found == 0
            if free.any():
                self.keys[at[free]] = key[free]  # of several that want a slot, the last has it
                mine = free & (self.keys[at] == key)
                self.paths[at[mine]] = paths[open_[mine]]
                self.used += len(np.unique(at[mine]))
                found = self.keys[at]
            open_ = open_[found != key]
            slot[open_] = (slot[open_] + 1) & int(mask)
        same = (self.paths[slot] == paths).all(axis=1)
        if same.all():
            np.add.at(self.counts, slot, counts)
            return np.zeros(0, np.int64)
        np.add.at(self.counts, slot[same], counts[same])
        return np.flatnonzero(~same)

    def _grow(self) -> None:
        keys, paths, counts = self.entries()
        self.__init__(self.width, 2 * len(self.keys))
        if len(keys):
            self.add(keys, paths, counts)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = np.flatnonzero(self.keys)
        return self.keys[full], self.paths[full], self.counts[full]


class Trie:
    """Digits of the first word lead to containers; `spill` takes the largest subtree out, sorted."""

    def __init__(self, width: int, cfg: Mining) -> None:
        self.cfg, self.width, self.children = cfg, width, [Container(width) for _ in range(16)]
        self.clashes: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _digit(paths: np.ndarray, level: int) -> np.ndarray:
        return ((paths[:, 0] >> np.uint64(60 - 4 * level)) & np.uint64(15)).astype(np.int64)

    def add(self, paths: np.ndarray, counts: np.ndarray) -> None:
        self._into(self.children, 0, path_hash(paths), paths, counts)

    def _into(self, children: list, level: int, keys: np.ndarray, paths: np.ndarray, counts: np.ndarray) -> None:
        digit = self._digit(paths, level)
        order = np.argsort(digit, kind="stable")
        edges = np.searchsorted(digit[order], np.arange(17))
        for d in range(16):
            part = order[edges[d] : edges[d + 1]]
            if not len(part):
                continue
            child = children[d]
            if isinstance(child, list):
                self._into(child, level + 1, keys[part], paths[part], counts[part])
                continue
            clash = part[child.add(keys[part], paths[part], counts[part])]
            if len(clash):
                self.clashes.append((paths[clash], counts[clash]))
            if child.used > self.cfg.burst and level + 1 < self.cfg.levels:
                children[d] = [Container(self.width) for _ in range(16)]
                self._into(children[d], level + 1, *child.entries())

    def _size(self, child) -> int:
        return sum(map(self._size, child)) if isinstance(child, list) else child.used

    def __len__(self) -> int:
        return sum(map(self._size, self.children))

    def _taken(self, child) -> list[tuple[np.ndarray, np.ndarray]]:
        return [x for c in child for x in self._taken(c)] if isinstance(child, list) else [child.entries()[1:]]

    def _sorted(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        paths, counts = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.lexsort(paths.T[::-1])
        return paths[order], counts[order]

    def spill(self, down_to: int):
        """Sorted runs of whole subtrees, the largest first, until `down_to` phrases are left."""
        sizes = [self._size(c) for c in self.children]
        left = sum(sizes)
        for d in np.argsort(sizes)[::-1].tolist():
            if left <= down_to:
                break
            if sizes[d]:
                yield self._sorted(self._taken(self.children[d]))
                self.children[d] = Container(self.width)
                left -= sizes[d]
        if self.clashes:
            yield self._sorted(self.clashes)
            self.clashes = []


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set; the number of bits is a power of two."""
    shift = np.uint64(64 - (len(bits) * 64 - 1).bit_length())
    at = hashes >> shift
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _prefix(paths: np.ndarray, common: list[np.ndarray]) -> np.ndarray:
    """The number of the prefix that a phrase belongs to: its first word, more words while that is a common one."""
    out, todo = paths[:, 0].copy(), np.arange(len(paths))
    for j, known in enumerate(common):
        if j + 1 >= paths.shape[1]:
            break
        todo = todo[np.isin(out[todo], known)]
        out[todo] = path_hash(paths[todo, : j + 2])
    return out


def _count_phrases(tables: np.ndarray, sizes: tuple[int, ...], word_bits, pair_bits, common: list[np.ndarray], cfg: Mining):
    """Sorted runs (prefix, w0.., n) of the phrases of these sizes; a shorter phrase has 0 for the words it lacks."""
    width = max(sizes)

    def rows(run):
        paths, counts = run
        prefix = _prefix(paths, common)
        for b in range(0, len(paths), 65_536):
            part = slice(b, b + 65_536)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (prefix[part].view(np.int64), *[np.ascontiguousarray(paths[part, j]).view(np.int64) for j in range(width)], counts[part])], names=["prefix", *[f"w{j}" for j in range(width)], "n"]
            )

    def run(batches):
        words, pairs = word_bits.value, pair_bits.value if pair_bits is not None else None
        trie = Trie(width, cfg)
        for batch in batches:
            for pieces, _, _ in _pieces(batch, tables, cfg):
                ids = pieces.numbers(0)
                n = len(ids)
                solid = _known(words, ids)
                joined = (pieces.piece[1:] == pieces.piece[:-1]) & solid[1:] & solid[:-1]
                if pairs is not None:
                    at = np.flatnonzero(joined)
                    joined[at] = _known(pairs, path_hash(np.column_stack([ids[at], ids[at + 1]])))
                for size in sizes:
                    if n < size:
                        continue
                    whole = joined[: n - size + 1].copy()
                    for j in range(1, size - 1):
                        whole &= joined[j : n - size + 1 + j]
                    at = np.flatnonzero(whole)
                    paths = np.zeros((len(at), width), np.uint64)
                    for j in range(size):
                        paths[:, j] = ids[at + j]
                    trie.add(paths, np.ones(len(at), np.int64))
                if len(trie) > cfg.hold:
                    for part in trie.spill(cfg.hold // 2):
                        yield from rows(part)
        for part in trie.spill(0):
            yield from rows(part)

    return run


def _merge(width: int, least: int):
    """Sums of equal phrases, which are neighbours; those with `least` or more, as keys of eight bytes a word."""

    def out(paths: np.ndarray, counts: np.ndarray):
        keep = counts >= least
        paths, counts = paths[keep], counts[keep]
        sizes = (paths != 0).sum(axis=1)
        for size in np.unique(sizes).tolist():
            of = sizes == size
            keys = np.ascontiguousarray(paths[of, :size]).astype(">u8").tobytes()
            column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * size), int(of.sum()), [None, pa.py_buffer(keys)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([column, pa.array(np.full(int(of.sum()), size, np.int32)), pa.array(counts[of])], names=["key", "size", "n"])

    def run(batches):
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            paths = np.column_stack([batch.column(1 + j).to_numpy().view(np.uint64) for j in range(width)])
            counts = batch.column(1 + width).to_numpy()
            if kept is not None:
                paths, counts = np.concatenate([kept[0], paths]), np.concatenate([kept[1], counts])
            starts = np.concatenate([[0], np.flatnonzero((paths[1:] != paths[:-1]).any(axis=1)) + 1])
            paths, counts = paths[starts], np.add.reduceat(counts, starts)
            kept = (paths[-1:], counts[-1:])
            yield from out(paths[:-1], counts[:-1])
        if kept is not None:
            yield from out(*kept)

    return run


def _bit_table(keys: DataFrame, cfg: Mining):
    """A bit for every key, in a table of 16 bits a key, 2^`bits` at most; it is small enough for the driver and every task."""
    entries = keys.count()
    log = min(max(int(16 * entries).bit_length(), 10), cfg.bits)

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_pylist()
            if not values:
                continue
            paths = np.frombuffer(b"".join(values), ">u8").reshape(len(values), -1).astype(np.uint64)
            at = (path_hash(paths) if paths.shape[1] > 1 else paths[:, 0]) >> np.uint64(64 - log)
            slot, where = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    table = keys.select("key").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log - 6), np.uint64)
    out[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def _key(word_id: Column) -> Column:
    return F.unhex(F.lpad(F.hex(word_id), 16, "0"))


def _hashes(rows: list) -> np.ndarray:
    """The prefix numbers of common keys."""
    keys = [np.frombuffer(bytes(r["key"]), ">u8").astype(np.uint64).reshape(1, -1) for r in rows]
    return np.array([k[0, 0] if k.shape[1] == 1 else path_hash(k)[0] for k in keys], np.uint64)


def phrase_counts(docs: DataFrame, cfg: Mining = Mining(), text_column: str = "text", lang_column: str = "lang", seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: words (key, lang, word, n) and phrases (key, size, n), words included, that occur `least` times or more,
    and languages (lang, n). A key is eight bytes a word. Ids are hashes; should two words of the table have one, another
    hash is taken, so counts are exact."""
    source = docs.select(F.col(f"`{text_column}`").cast("string").alias("text"), F.col(f"`{lang_column}`").cast("string").alias("lang"))
    while True:
        tables = _tables(seed)
        every = source.mapInArrow(_count_words(tables, cfg), "id long, lang string, word string, n long").groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))
        every = shared_table(every, "phrase-words")
        if not every.groupBy("id").agg(F.count(F.lit(1)).alias("words")).where("words > 1").limit(1).count():
            break
        seed += 1
    languages = shared_table(every.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-languages")
    words = shared_table(every.where(F.col("n") >= cfg.least).select(_key(F.col("id")).alias("key"), "lang", "word", "n"), "phrase-frequent")
    total = languages.agg(F.sum("n").alias("n")).first()["n"] or 0
    found = words.select("key", F.lit(1).alias("size"), "n")
    common = [_hashes(words.where(F.col("n") * cfg.common > total).select("key").collect())]  # at most `common` words
    word_bits, pair_bits = _bit_table(words, cfg), None
    for sizes in ((2,), tuple(range(3, cfg.longest + 1))):
        if not sizes or sizes[-1] > cfg.longest:
            continue
        columns = [f"w{j}" for j in range(sizes[-1])]
        schema = ", ".join(f"{c} long" for c in ("prefix", *columns, "n"))
        runs = source.mapInArrow(_count_phrases(tables, sizes, word_bits, pair_bits, common, cfg), schema)
        merged = runs.repartition("prefix").sortWithinPartitions("prefix", *columns).mapInArrow(_merge(len(columns), cfg.least), "key binary, size int, n long")
        counted = shared_table(merged, "phrase-counts")
        found = found.unionByName(counted)
        if sizes == (2,):
            pair_bits = _bit_table(counted, cfg)
            common = [*common, _hashes(counted.where(F.col("n") * cfg.common > total).select("key").collect())]
    return words, shared_table(found, "phrase-all"), languages


def _part(key: str, first: Column, size: Column) -> Column:
    return F.substring(F.col(key), 8 * first + 1, 8 * size)


def collocations(docs: DataFrame, cfg: Mining = Mining(), text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of every language.

    Texts are lower-cased (A-Z), cut into pieces and those into words; a null text is empty, a null language is `und`. a is
    the number of a phrase's occurrences, n that of all words of the language. A phrase is cut after each of its first words;
    l and r are the counts of both parts, and floor(2000000 a / (l + r)) is the score. The lowest-scoring cut counts, of equal
    ones the first. A phrase of which `percent` of the occurrences lie inside one longer phrase is left out. Ranks go by score
    and a, from large to small, then by the bytes of the phrase. Rows that repeat count each time. An empty table gives no rows.
    """
    words, phrases, languages = phrase_counts(docs, cfg, text_column, lang_column)
    found = phrases.where("size > 1").select("key", "size", F.col("n").alias("a"))
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("key", "size", "a", "k", _part("key", F.lit(0), F.col("k")).alias("head"), _part("key", F.col("k"), F.col("size") - F.col("k")).alias("rest"))
    counts = phrases.select("key", "n")
    cut = cut.join(counts.select(F.col("key").alias("head"), F.col("n").alias("l")), "head").join(counts.select(F.col("key").alias("rest"), F.col("n").alias("r")), "rest")
    score = F.expr("(CAST(2000000 AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(20, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cut.groupBy("key", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = found.where("size > 2").withColumn("part", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("part"))))
    inner = inner.select(_part("key", F.col("at"), F.col("part")).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cfg.percent * F.col("a"))).select("key", "size", "a", "cut")
    kept = shared_table(kept, "phrase-kept")
    spelled = kept.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).select("key", "a", "cut", "at", _part("key", F.col("at"), F.lit(1)).alias("one"))
    spelled = spelled.join(words.select(F.col("key").alias("one"), "lang", "word"), "one")
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]))
    named = spelled.groupBy("key", "lang", "a", "cut").agg(text.alias("phrase"))
    flat = named.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.top)  # tasks send `top` rows of a language at most
    return ranked.join(languages, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
