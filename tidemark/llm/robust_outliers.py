"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Counts of a text give a vector of transformed statistics. For every language and source the minimum-covariance-determinant
estimate of centre and spread is found by concentration steps: keep the rows nearest to the present estimate, estimate anew
from them, repeat. Small groups have theirs shrunk towards the language's, and that of a small language towards that of all
rows. Rows that lie far away by Mahalanobis distance are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_table

#: Split at this; words are what is between.
SPACE = r"[\x20\x09-\x0D]+"
DIMENSIONS = 4


@dataclass(frozen=True)
class Outliers:
    """`share` of the rows that the estimate rests on, in sixteenths. `consistency` makes its spread that of normal rows: for
    four dimensions and three quarters, 0.75 / P(chi2 with 6 degrees < 5.385). `ridge` is added to each variance: differences
    below it never reject. `cutoff` is the squared distance that rejects. Groups below `least` rows count n/`least` in
    their centre and the square of it in their spread, in which few rows would hide the outlier among them; the next larger group
    counts the rest.
    `bins` per unit cut values for quantiles."""

    share: int = 12
    consistency: float = 1.486
    ridge: tuple[float, ...] = (0.5, 0.15, 0.15, 0.1)
    cutoff: float = 60.0
    least: int = 30
    steps: int = 3
    bins: int = 64


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols and n_dup_lines of a text; null is empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0)
    return {
        "words": words,
        "word_chars": F.length(F.regexp_replace(whole, SPACE, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
        "lines": lines,
    }


def _repeated_words(windows: str) -> Column:
    """Words in windows of eight that occur twice or more, from the windows' hashes in order. Texts without a repeated window
    are told by a count of distinct hashes; for others the (hash, place) pairs are sorted and equal neighbours are kept."""

    def covered(pairs: Column) -> Column:
        def repeats(pair, i):
            before, after = F.when(i > 0, F.get(pairs, i - 1)["h"]), F.get(pairs, i + 1)["h"]
            return F.coalesce(before == pair["h"], F.lit(False)) | F.coalesce(after == pair["h"], F.lit(False))

        places = F.sort_array(F.transform(F.filter(pairs, repeats), lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda s, p: F.struct((p + 8).alias("end"), (s["n"] + p + 8 - F.greatest(p, s["end"])).alias("n")), lambda s: s["n"])

    pairs = F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    bound = F.transform(F.array(pairs), covered)  # names the sorted pairs, so that they are made once
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.get(bound, F.lit(0))).otherwise(F.lit(0)).cast("long")


def counted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    base = base_counts(F.col(f"`{text_column}`").cast("string"))
    first = docs.withColumns({"__words": base["words"], "word_chars": base["word_chars"], "n_symbols": base["n_symbols"], "__lines": base["lines"]})
    hashes = F.transform(F.col("__words"), lambda w: F.xxhash64(w))
    second = first.withColumns({"n_words": F.size("__words").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__hashes": hashes}).drop("__lines", "__words")
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 8), lambda i: F.xxhash64(*[F.get(F.col("__hashes"), i + j) for j in range(8)]))
    third = second.withColumn("__windows", F.when(F.col("n_words") >= 8, windows).otherwise(F.array().cast("array<bigint>"))).drop("__hashes")
    fourth = third.withColumn("n_repeat_words", _repeated_words("__windows")).drop("__windows")
    return fourth.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def statistics() -> list[Column]:
    """The transformed vector: length, word length, symbols per word, repeated lines."""
    words = F.col("n_words") + 1
    return [
        F.log(words), 2 * F.log((F.col("word_chars") + 1) / words), F.log((F.col("n_symbols") + 1) / words + 0.05), F.log1p(F.col("n_dup_lines").cast("double")) / F.log(words + 2),
    ]


def _cholesky(cov: dict[tuple[int, int], str]) -> list[tuple[str, Column]]:
    """Columns l_ij of the lower triangle, in an order in which each needs only earlier ones."""
    out = []
    for i in range(DIMENSIONS):
        for j in range(i + 1):
            rest = F.col(cov[i, j]) - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out.append((f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}")))
    return out


def _factored(estimates: DataFrame, keys: list[str], cfg: Outliers) -> DataFrame:
    """keys, centre m0.., lower triangle l00.. and the determinant's logarithm, from m0.. and c00..; the ridge is added here."""
    out = estimates
    for i in range(DIMENSIONS):
        out = out.withColumn(f"c{i}{i}", F.col(f"c{i}{i}") + cfg.ridge[i] ** 2)
    for name, column in _cholesky({(i, j): f"c{i}{j}" for i in range(DIMENSIONS) for j in range(i + 1)}):
        out = out.withColumn(name, column)
    return out.select(
        *keys, *[f"m{i}" for i in range(DIMENSIONS)], *[f"l{i}{j}" for i in range(DIMENSIONS) for j in range(i + 1)], sum((2 * F.log(f"l{i}{i}") for i in range(DIMENSIONS)), F.lit(0.0)).alias("logdet")
    )


def _distance(rows: DataFrame) -> DataFrame:
    """Adds `d`, the squared distance, by forward substitution."""
    for i in range(DIMENSIONS):
        rows = rows.withColumn(f"y{i}", (F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return rows.withColumn("d", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIMENSIONS)), F.lit(0.0)))


def _quantiles(binned: DataFrame, keys: list[str], parts: dict[str, tuple[int, int]]) -> DataFrame:
    """Smallest bin that reaches each share (numerator, denominator) of a key's rows; `binned` has keys and `bin`. Counts per
    bin are combined in the tasks; a key has a few hundred bins."""
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranked = counts.withColumns({"upto": upto, "total": total})
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") * d >= F.col("total") * n, F.col("bin"))).alias(name) for name, (n, d) in parts.items()])


def _moments(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Centre and covariance of the rows of a key, in one pass with partial sums."""
    sums = [F.avg(f"x{i}").alias(f"m{i}") for i in range(DIMENSIONS)]
    products = [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in range(DIMENSIONS) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(*sums, *products)
    return out.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * scale for i in range(DIMENSIONS) for j in range(i + 1)})


def estimates(rows: DataFrame, keys: list[str], cfg: Outliers = Outliers()) -> DataFrame:
    """Minimum-covariance-determinant estimate per key for rows with x0..: two starts (medians with quartile widths, and plain
    moments) each take `steps` concentration steps; the smaller determinant wins. All keys are worked on together; estimates
    are one row per key and start, written and read again, so that Spark knows whether they are small enough to broadcast."""
    rows = rows.select(*keys, *[f"x{i}" for i in range(DIMENSIONS)])
    long = rows.select(*keys, F.posexplode(F.array(*[f"x{i}" for i in range(DIMENSIONS)])).alias("dim", "x")).withColumn("bin", F.floor(F.col("x") * cfg.bins))
    quarters = _quantiles(long, [*keys, "dim"], {"q1": (1, 4), "q2": (1, 2), "q3": (3, 4)})
    wide = quarters.groupBy(*keys).agg(*[F.max(F.when(F.col("dim") == i, F.col(q))).alias(f"{q}_{i}") for i in range(DIMENSIONS) for q in ("q1", "q2", "q3")])
    zero = F.lit(0.0)
    robust = wide.select(
        *keys, F.lit(0).alias("start"), *[((F.col(f"q2_{i}") + 0.5) / cfg.bins).alias(f"m{i}") for i in range(DIMENSIONS)],
        *[(F.pow((F.col(f"q3_{i}") - F.col(f"q1_{i}")) / cfg.bins / 1.349, F.lit(2.0)) if i == j else zero).alias(f"c{i}{j}") for i in range(DIMENSIONS) for j in range(i + 1)],
    )
    plain = _moments(rows, keys, 1.0).withColumn("start", F.lit(1))
    by = [*keys, "start"]
    now = shared_table(_factored(robust.unionByName(plain.select(*robust.columns)), by, cfg), "mcd-estimates")
    for _ in range(cfg.steps):
        near = _distance(_joined(rows, now, keys)).withColumn("bin", F.floor(F.log2(F.col("d") + 1e-6) * 32))
        limit = shared_table(_quantiles(near, by, {"limit": (cfg.share, 16)}), "mcd-limits")
        inside = _joined(near, limit, by).where("bin <= limit")
        now = shared_table(_factored(_moments(inside, by, cfg.consistency), by, cfg), "mcd-estimates")
    best = now.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in now.columns if c not in keys]), F.struct("logdet", "start")).alias("e"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return shared_table(_joined(counts, best.select(*keys, "e.*").drop("start"), keys), "mcd-best")


def _shrunk(groups: DataFrame, wider: DataFrame, keys: list[str], by: list[str], cfg: Outliers) -> DataFrame:
    """Estimates of `groups` (one row per `keys`, with `rows`), those below `least` rows mixed with the one of `wider` for the same `by`."""
    names = [c for c in wider.columns if c not in (*by, "rows", "logdet")]
    share = F.least(F.col("rows") / cfg.least, F.lit(1.0))
    both = _joined(groups, wider.select(*by, *[F.col(c).alias(f"w_{c}") for c in names]), by).withColumn("share", share)

    def product(prefix: str, i: int, j: int) -> Column:
        return sum((F.col(f"{prefix}l{i}{k}") * F.col(f"{prefix}l{j}{k}") for k in range(j + 1)), F.lit(0.0))

    def mixed(share: Column, own: Column, other: Column) -> Column:
        return share * own + (1 - share) * other

    centre = [mixed(F.col("share"), F.col(f"m{i}"), F.col(f"w_m{i}")).alias(f"m{i}") for i in range(DIMENSIONS)]
    spread = [mixed(F.col("share") * F.col("share"), product("", i, j), product("w_", i, j)).alias(f"c{i}{j}") for i in range(DIMENSIONS) for j in range(i + 1)]
    return _factored(both.select(*keys, *centre, *spread), keys, replace(cfg, ridge=(0.0,) * DIMENSIONS))  # both hold the ridge


def _joined(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the one row per key of `small`; null keys match null keys. Spark broadcasts `small` if it is; otherwise both sides are dealt anew and a hot key can be split."""
    renamed = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    condition = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(renamed, condition).drop(*[f"__{k}" for k in keys])


def judged(docs: DataFrame, carry: list[str], text_column: str = "text", groups: tuple[str, str] = ("lang", "source"), prefix: str = "", cfg: Outliers = Outliers()) -> DataFrame:
    """The columns `carry` of every row, and, with names that start with `prefix`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance (null where the row failed the base rules) and kept. Every row that passes the base rules is judged, however small its group.

    Null and empty texts have no words and fail. Null languages or sources are groups of their own; a missing group column
    counts as null. Rows that repeat are judged alike, each. An empty table gives an empty result. Statistics are taken over
    all rows that pass the base rules. Texts are read once; what follows reads a narrow table.
    """
    inner = docs.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry)], F.col(f"`{text_column}`").cast("string").alias("t"),
        *[(F.col(f"`{g}`").cast("string") if g in docs.columns else F.lit(None).cast("string")).alias(n) for g, n in zip(groups, ("g0", "g1"), strict=True)],
    )
    rows = counted(inner, "t").drop("t")
    table = shared_table(rows.withColumns({f"x{i}": x for i, x in enumerate(statistics())}), "mcd-rows")
    null = F.lit(None).cast("string")
    levels = F.array(*[F.struct(F.lit(n).alias("level"), x.alias("g0"), y.alias("g1")) for n, (x, y) in enumerate(((null, null), (F.col("g0"), null), (F.col("g0"), F.col("g1"))))])
    passed = table.where("NOT base_failed").select(F.explode(levels).alias("k"), *[f"x{i}" for i in range(DIMENSIONS)]).select("k.*", *[f"x{i}" for i in range(DIMENSIONS)])
    found = estimates(passed, ["level", "g0", "g1"], cfg)  # of all rows, of each language, and of each language and source
    overall, languages, sources = (found.where(F.col("level") == n) for n in range(3))
    languages = _shrunk(languages.drop("g1"), overall.drop("g0", "g1").withColumn("level", F.lit(1)), ["level", "g0"], ["level"], cfg)
    best = shared_table(_shrunk(sources.drop("level"), languages.drop("level"), ["g0", "g1"], ["g0"], cfg), "mcd-judges")
    renamed = best.select(F.col("g0").alias("h0"), F.col("g1").alias("h1"), *[c for c in best.columns if c not in ("g0", "g1")])
    joined = _distance(table.join(renamed, [F.col("g0").eqNullSafe(F.col("h0")), F.col("g1").eqNullSafe(F.col("h1"))], "left"))
    distance = F.when(~F.col("base_failed"), F.col("d"))
    return joined.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(carry)], *[F.col(c).alias(prefix + c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        distance.alias(f"{prefix}distance"), (~F.col("base_failed") & F.coalesce(distance <= cfg.cutoff, F.lit(True))).alias(f"{prefix}kept"),
    )
