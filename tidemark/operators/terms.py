"""Terms of texts: n-gram counts, document frequency, distinctive terms, embeddings by feature hashing."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions import text as tx
from tidemark.operators.chunked import join_same
from tidemark.operators.stepwise import by_piece, whole_pieces

_LATIN, _FILLERS, _GENERIC = re.compile(tx.LATIN), frozenset(tx.FILLER_PHRASES), frozenset(tx.GENERIC_TERMS)

def text_units(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per key with its texts, nearly always one: `__g` (the key as one struct, so that null keys are equal) and `__texts`.

    Everything that concerns one text is then done inside its row. The texts are the only thing that is shuffled for it."""
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    return texts.groupBy(key.alias("__g")).agg(F.collect_list(F.struct(F.col(text).alias("t"))).alias("__texts"))


def batched_units(texts: DataFrame, keys: Sequence[str], text: str, batches: int) -> DataFrame:
    """`text_units` with the number `__batch` of their batch, the units of a batch side by side."""
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    rows = texts.select(key.alias("__g"), F.col(text).alias("t")).withColumn("__batch", F.pmod(F.xxhash64("__g"), F.lit(batches)))
    units = rows.repartition("__batch").groupBy("__batch", "__g").agg(F.collect_list(F.struct("t")).alias("__texts"))
    return units.sortWithinPartitions("__batch")


def counted_terms(texts: list[dict]) -> Counter:
    """Terms of the texts of one key with their counts; the same texts always give the same order."""
    out = Counter()
    for text in texts:
        words = " ".join(_LATIN.findall(text["t"] or "")).lower().split()
        lemmas = [*map(tx.content_lemma, words)]
        out.update([x for x in lemmas if x is not None])
        # Zipped lists end with the shortest: no phrase runs over the end.
        out.update([f"{a} {b}" for a, b, x, y in zip(words, words[1:], lemmas, lemmas[1:]) if x is not None and y is not None])  # noqa: B905
        out.update([f"{a} {b} {c}" for a, b, c, x, y in zip(words, words[1:], words[2:], lemmas, lemmas[2:]) if x is not None and y is not None])  # noqa: B905
    for phrase in _FILLERS.intersection(out):
        del out[phrase]
    return out


def pieces(batches, rows: int = 64):
    """Batches cut into a few texts each, so that Python holds the terms of a few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unit_terms(units: DataFrame) -> DataFrame:
    """`__g`, `term`, its place `at` in its text's list of terms, and its `frequency`, from `text_units`."""
    kind = units.schema["__g"].dataType.simpleString()
    schema = f"__g {kind}, term string, at long, frequency long"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def count(batches):
        for batch in pieces(batches):
            counts = [counted_terms(texts) for texts in batch.column("__texts").to_pylist()]
            sizes = np.array([len(c) for c in counts], dtype=np.int64)
            owner = pa.array(np.repeat(np.arange(len(counts)), sizes))
            places = np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else sizes
            terms, numbers = [t for c in counts for t in c], [n for c in counts for n in c.values()]
            yield pa.RecordBatch.from_arrays([batch.column("__g").take(owner).cast(arrow.field("__g").type), pa.array(terms, pa.string()), pa.array(places, pa.int64()), pa.array(numbers, pa.int64())], schema=arrow)

    return units.mapInArrow(count, schema)


def term_counts(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Lemmas of content words, and two- and three-word phrases between content words, with their counts.

    The terms of a text are counted where the text lies (see `text_units`); no term is shuffled.
    """
    counts = unit_terms(text_units(texts, keys, text))
    return counts.select(*[F.col(f"__g.k{i}").alias(k) for i, k in enumerate(keys)], "term", "frequency")


def document_frequency(counts: DataFrame, corpus: Sequence[str]) -> DataFrame:
    """Texts of a corpus that contain each term. `counts` has one row per text and term, so counting rows is enough."""
    return counts.groupBy(*corpus, "term").agg(F.count(F.lit(1)).alias("document_frequency"))


TERM = "struct<term:string,score:double,frequency:bigint,document_frequency:bigint,distribution:double>"


def apart(ranked: list[tuple], maximum: int) -> list[tuple]:
    """Ranked terms in order, leaving out each one that contains or is contained in a term already taken."""
    taken: list[tuple] = []
    for item in ranked:
        if len(taken) >= maximum:
            break
        if not any(item[2] in t[2] or t[2] in item[2] for t in taken):
            taken.append(item)
    return taken


def settled_terms(quarters: list[str], counted: Iterable[tuple], maximum: int) -> list[tuple]:
    """The best `maximum` terms of one text, as (-score, -frequency, term, score, document frequency, share).

    `counted` has (best possible score, term, frequency, document frequency), the best first. The share of quarters that a
    term occurs in only lowers its score. A phrase lies in no more quarters than there are neighbouring words that its first two words
    could come from: the first word ends, and the second begins, with the same four letters (content words have four at least). So
    terms are looked up in the order of what they can reach, and once the last of the best comes before all that is still to come,
    they are final: a few dozen searches, whatever the length of the text."""
    words = "".join(quarters).split(" ")
    found = Counter([a[-4:] + " " + b[:4] for a, b in zip(words, words[1:])]).get  # noqa: B905
    tested: list[tuple] = []
    waiting: list[tuple] = []
    look = maximum  # then at twice as many each time: texts with thousands of equally good terms are not sorted for every few of them
    counted = iter(counted)
    coming, top, reach = next(counted, None), None, []
    while coming or waiting:
        while coming:
            highest, term, frequency, documents = coming
            if highest != top:  # what terms of this score reach in no quarter, in one, and so on
                top, reach = highest, [-round(highest * (0.65 + 0.35 * (n / 4)), 9) for n in range(5)]
            if waiting and reach[4] > waiting[0][0]:
                break
            plain = tx.term_normal(term)
            parts = plain.split(" ")
            most = min(found(parts[0][-4:] + " " + parts[1][:4], 0), 4) if len(parts) > 1 else 4
            heappush(waiting, (reach[most], -frequency, term, highest, documents, plain))
            coming = next(counted, None)
        if len(tested) == look:
            look *= 2
            best = apart(sorted(tested), maximum)
            if len(best) >= maximum and best[-1][:3] < waiting[0][:3]:
                return best
        _, frequency, term, highest, documents, plain = heappop(waiting)
        share = sum([plain in part for part in quarters]) / len(quarters)
        score = highest * (0.65 + 0.35 * share)
        tested.append((-round(score, 9), frequency, term, score, documents, share))
    return apart(sorted(tested), maximum)


def term_hashes(corpus: tuple, terms: list[str]) -> np.ndarray:
    """The terms of a corpus as 64-bit numbers."""
    return pd.util.hash_array(np.array(terms, dtype=object), hash_key=hashlib.md5(repr(corpus).encode()).hexdigest()[:16], categorize=False)


class BatchTerms:
    """The terms of a batch of texts, and the distinct hashes among them in rising order: `hashes`, `held` (texts that hold each).

    The empty term stands for the corpus and counts all rows of texts. The same texts always give the same hashes."""

    def __init__(self, groups: list[dict], texts: list[list[dict]], corpus: Sequence[int]) -> None:
        self.counts = [counted_terms(t) for t in texts]
        found = [term_hashes(tuple(g[f"k{i}"] for i in corpus), ["", *c]) for g, c in zip(groups, self.counts, strict=True)]
        self.ends = np.cumsum([len(f) for f in found])
        weights = np.ones(self.ends[-1], dtype=np.int64)
        weights[self.ends - [len(f) for f in found]] = [len(t) for t in texts]
        self.hashes, self.place = np.unique(np.concatenate(found), return_inverse=True)
        self.held = np.bincount(self.place, weights).astype(np.int64)

    def of_text(self, values: np.ndarray, i: int) -> np.ndarray:
        """Those of the values per hash that belong to a text: its corpus first, then its terms in order."""
        return values[self.place[self.ends[i] - len(self.counts[i]) - 1 : self.ends[i]]]


def corpus_counts(units: DataFrame, corpus: Sequence[int], ranges: int) -> DataFrame:
    """How many texts of its corpus hold each term of a batch: `__batch`, `term_range` and the counts, in the order of the hashes.

    A task gives the hashes of a batch as one array per range of hashes, so a term costs eight bytes on its way, once a batch. The
    arrays of a range meet in one task, which adds them up; `ranges` bounds what it holds."""
    names = "__batch long, term_range long, hashes binary, held binary"

    def give(batches):
        for table, starts in whole_pieces(batches, ["__batch"]):
            for at, end in zip(starts[:-1], starts[1:], strict=True):
                piece = table.slice(at, end - at)
                terms = BatchTerms(piece.column("__g").to_pylist(), piece.column("__texts").to_pylist(), corpus)
                of = (terms.hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
                rows = [(terms.hashes[x:y].tobytes(), terms.held[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([piece.column("__batch")[0].as_py()] * len(rows), pa.int64()), pa.array(of[cuts[:-1]].astype(np.int64)),
                    pa.array([h for h, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.binary())], ["__batch", "term_range", "hashes", "held"])

    def add(table: pa.Table, starts: np.ndarray) -> pa.Table:
        out = []
        for at, end in zip(starts[:-1], starts[1:], strict=True):
            hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").slice(at, end - at).to_pylist()]
            held = np.concatenate([np.frombuffer(n, np.int64) for n in table.column("held").slice(at, end - at).to_pylist()])
            place = np.unique(np.concatenate(hashes), return_inverse=True)[1]
            totals = np.bincount(place, held).astype(np.int64)[place]
            out += [part.tobytes() for part in np.split(totals, np.cumsum([len(h) for h in hashes])[:-1])]
        return table.select(["__batch", "term_range"]).append_column("totals", pa.array(out, pa.binary()))

    return by_piece(units.mapInArrow(give, names), ["term_range"], ["__batch"], "__batch long, term_range long, totals binary", add)


def distinctive_terms(
    texts: DataFrame, keys: Sequence[str], corpus: Sequence[str], text: str = "text", maximum: int = 8, own_corpus: bool = False, batch: int = 1_000_000, spread: int = 8_000_000
) -> DataFrame:
    """Best terms per text: array `terms` of (term, score, frequency, document_frequency, distribution).

    `corpus` keys are part of `keys`. With `own_corpus` every text is its own corpus. Else texts go in batches of about `batch`
    characters, chosen by the hash of their key, and the terms of a batch are counted per corpus as hashes (see `corpus_counts`, with
    a range of hashes for every `spread` characters). The counts return to the batch. A task then looks terms up in the quarters of
    its texts, from the best possible score down, until the best ones are settled (see `settled_terms`).
    """
    kind = texts.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("__g")).schema["__g"].dataType.simpleString()
    schema = f"__g {kind}, terms array<{TERM}>"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def best(counts: Counter, heard: list[dict], total: int, documents: np.ndarray) -> list[list[dict]]:
        """The best terms of every text of one key; `documents` holds the texts of the corpus with each term."""
        names, frequency = [*counts], [*counts.values()]
        scores = np.log1p(np.array(frequency, dtype=float)) * (np.log((1 + total) / (1 + documents)) + 1)
        scores[np.array([" " in t for t in names])] *= 1.35
        scores[[i for i, t in enumerate(names) if t in _GENERIC]] *= 0.35
        order, out = np.argsort(-scores, kind="stable"), []
        highest, order, documents = scores[order].tolist(), order.tolist(), documents.tolist()
        for text in heard:
            if text["t"] is None:
                continue
            normal = tx.text_normal(text["t"])
            quarters = [normal[len(normal) * i // 4 : len(normal) * (i + 1) // 4] for i in range(4)]
            ranked = ((top, names[i], frequency[i], documents[i]) for top, i in zip(highest, order, strict=True))
            out.append([{"term": t, "score": s, "frequency": -f, "document_frequency": d, "distribution": x} for _, f, t, s, d, x in settled_terms(quarters, ranked, maximum)])
        return out

    def table(groups: pa.Array, out: list[list]) -> pa.RecordBatch:
        owner = pa.array(np.repeat(np.arange(len(out)), [len(x) for x in out]), pa.int64())
        return pa.RecordBatch.from_arrays([groups.take(owner).cast(arrow.field("__g").type), pa.array([t for x in out for t in x], arrow.field("terms").type)], schema=arrow)

    def settle_alone(batches):
        for rows in pieces(batches):
            heard = rows.column("__texts").to_pylist()
            yield table(rows.column("__g"), [best(c, t, 1, np.ones(len(c), dtype=np.int64)) if c else [] for c, t in zip(map(counted_terms, heard), heard, strict=True)])

    def settle(batches):
        for rows, starts in whole_pieces(batches, ["__batch"]):
            for at, end in zip(starts[:-1], starts[1:], strict=True):
                piece = rows.slice(at, end - at).combine_chunks()
                answers = piece.filter(pc.is_valid(piece.column("totals"))).sort_by("term_range")
                piece = piece.filter(pc.is_null(piece.column("totals")))
                totals = np.concatenate([np.frombuffer(t, np.int64) for t in answers.column("totals").to_pylist()])
                groups = piece.column("__g")
                texts = piece.column("__texts").to_pylist()
                terms, out = BatchTerms(groups.to_pylist(), texts, places), []
                for i, heard in enumerate(texts):
                    held = terms.of_text(totals, i)
                    out.append(best(terms.counts[i], heard, int(held[0]), held[1:]) if terms.counts[i] else [])
                yield table(groups.combine_chunks(), out)

    if own_corpus:
        found = text_units(texts, keys, text).mapInArrow(settle_alone, schema)
    else:
        places = [list(keys).index(c) for c in corpus]
        size = texts.agg(F.sum(F.length(F.col(text)))).first()[0] or 0
        units = batched_units(texts, keys, text, -(-size // batch) or 1)
        counts = corpus_counts(units, places, -(-size // spread) or 1)
        both = units.unionByName(counts, allowMissingColumns=True).repartition("__batch").sortWithinPartitions("__batch")
        found = both.select("__batch", "__g", "__texts", "term_range", "totals").mapInArrow(settle, schema)
    return found.select(*[F.col(f"__g.k{i}").alias(k) for i, k in enumerate(keys)], "terms")


def keyword_quality(terms: Column, normal_text: Column, text_lemmas: Column) -> Column:
    hits = F.size(F.filter(terms, lambda t: tx.holds(tx.prepared_term(tx.normalize(t["term"])), normal_text, text_lemmas)))
    spread = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.least(F.lit(1.0), t["distribution"] * 2))
    n = F.size(terms)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.65 * hits / n + 0.35 * spread / n))


def semantic_coherence(parent: Column, terms: Column) -> Column:
    first = F.slice(terms, 1, 5)
    lasting = F.size(F.filter(first, lambda t: t["distribution"] >= 0.5)) / F.greatest(F.lit(1), F.size(first))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.65 * parent + 0.35 * lasting))


def hash_features(texts: DataFrame, keys: Sequence[str], text: str = "text", dimensions: int = 384) -> DataFrame:
    """Sparse hashed embedding: one row per text and non-zero dimension, weights of unit length per text."""
    heard = texts.select(*keys, tx.words(F.col(text)).alias("__w"))
    follow = F.slice(F.col("__w"), 2, F.greatest(F.size("__w"), F.lit(1)))
    pairs = heard.select(*keys, F.inline(F.arrays_zip(F.col("__w").alias("a"), follow.alias("b"))))
    features = pairs.select(*keys, F.explode(F.array("a", F.concat("a", F.lit("_"), "b"))).alias("f")).where("f IS NOT NULL")
    value = F.conv(F.substring(F.md5("f"), 1, 15), 16, 10).cast("long")
    sums = features.select(*keys, (value % dimensions).alias("dim"), F.when(value % 2 == 1, 1.0).otherwise(-1.0).alias("s"))
    sums = sums.groupBy(*keys, "dim").agg(F.sum("s").alias("total")).where("total <> 0")
    lengths = sums.groupBy(*keys).agg(F.sqrt(F.sum(F.col("total") * F.col("total"))).alias("length"))
    return join_same(sums, lengths, keys).select(*keys, "dim", (F.col("total") / F.col("length")).alias("weight"))


def hash_embedding(texts: DataFrame, keys: Sequence[str], text: str = "text", dimensions: int = 384) -> DataFrame:
    """The same embedding as a dense array column."""
    sparse = hash_features(texts, keys, text, dimensions).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("dim").cast("int"), "weight"))).alias("m")
    )
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    blank = F.array_repeat(F.lit(0.0), dimensions)
    return join_same(texts.select(*keys), sparse, keys, "left").select(
        *keys, F.when(F.col("m").isNull(), blank).otherwise(dense).alias("embedding")
    )


def rank_sentences(texts: DataFrame, keys: Sequence[str], text: str, terms: str, maximum: int = 6) -> DataFrame:
    """Sentences of at least six words, repeats dropped, best `maximum` by grounded terms and filler, in text order.

    `terms` is an array of strings. Result: array `sentences`, for texts that have such sentences. Texts are shuffled once, to meet
    others of their key (nearly always none); the rest is done inside their row, and terms are prepared once a text.
    """
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    units = texts.groupBy(key.alias("__g")).agg(F.collect_list(F.struct(F.col(text).alias("t"), F.col(terms).alias("w"))).alias("__texts"))
    # In order of their keys repeats lie side by side, the first one first.
    found = F.transform("__texts", lambda x, of: F.filter(
        F.transform(tx.sentences(x["t"]), lambda s, at: F.struct(tx.sentence_key(s).alias("key"), at.alias("at"), of.alias("of"), s.alias("s"))), lambda c: F.size(tx.plain_words(c["s"])) >= 6))
    firsts = tx.bind(F.sort_array(F.flatten(F.filter(found, lambda x: x.isNotNull()))), lambda every: F.filter(every, lambda c, i: (i == 0) | (F.get(every, i - 1)["key"] != c["key"])))

    def chosen(asked: Column) -> Column:
        def scored(c: Column) -> Column:
            hits = tx.bind(tx.normalize(c["s"]), lambda n: tx.bind(tx.lemmas_of(n), lambda l: F.size(F.filter(F.get(asked, c["of"]), lambda t: tx.holds(t, n, l)))))
            return F.struct((-F.round(hits * 2 + 1 - tx.filler_ratio(c["s"]), 9)).alias("o"), (-c["at"]).alias("p"), c["s"].alias("s"))

        best = F.slice(F.sort_array(F.transform(firsts, scored)), 1, maximum)
        return F.transform(F.sort_array(F.transform(best, lambda x: F.struct((-x["p"]).alias("p"), x["s"].alias("s")))), lambda x: x["s"])

    ordered = tx.bind(F.transform("__texts", lambda x: F.transform(x["w"], lambda t: tx.prepared_term(tx.normalize(t)))), chosen)
    # Exploded, not filtered: a filter would be pushed below and find the sentences a second time.
    kept = F.explode(F.filter(F.array(ordered), lambda x: F.size(x) > 0)).alias("sentences")
    return units.select(*[F.col(f"__g.k{i}").alias(k) for i, k in enumerate(keys)], kept)
