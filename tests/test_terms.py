"""Terms are counted inside the row of their text, and only counts above 1 go back to a text."""

import math

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import terms as tm

SCHEMA = "corpus string, id int, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_of_a_text_are_not_shuffled(spark):
    texts = spark.createDataFrame([("a", 1, "energía solar barata")], SCHEMA)
    assert "Exchange hashpartitioning" in plan(tm.term_counts(texts, ["id"])) and "Generate" not in plan(tm.term_counts(texts, ["id"]))
    alone = plan(tm.distinctive_terms(texts, ["id"], [], own_corpus=True))
    assert alone.count("Exchange hashpartitioning") == 1
    shared = [line for line in plan(tm.distinctive_terms(texts, ["corpus", "id"], ["corpus"])).splitlines() if "Exchange hashpartitioning" in line and "term" in line]
    assert len(shared) == 1


def test_counts_merge_repeated_and_null_keys(spark):
    rows = [("a", None, "Energía solar"), ("a", None, "energía solar"), ("a", 2, None), ("a", 3, "y de la")]
    counts = {(r.id, r.term): r.frequency for r in tm.term_counts(spark.createDataFrame(rows, SCHEMA), ["id"]).collect()}
    assert counts == {(None, "energia"): 2, (None, "solar"): 2, (None, "energía solar"): 2}


def test_document_frequency_reaches_the_terms(spark):
    rows = [(None, 1, "planetas lejanos"), (None, 2, "planetas rojos rojos"), ("b", 1, "planetas azules")]
    out = tm.distinctive_terms(spark.createDataFrame(rows, SCHEMA), ["corpus", "id"], ["corpus"])
    found = {(r.corpus, r.id, t.term): (t.score, t.frequency, t.document_frequency) for r in out.collect() for t in r.terms}
    assert {k: v[1:] for k, v in found.items() if k[2] == "planetas lejanos"} == {(None, 1, "planetas lejanos"): (1, 1)}
    assert {k[:2] for k in found} == {(None, 1), (None, 2), ("b", 1)}
    # A phrase longer than a quarter lies in none.
    assert abs(found[None, 1, "planetas lejanos"][0] - math.log1p(1) * (math.log(3 / 2) + 1) * 1.35 * 0.65) < 1e-9
    alone = tm.distinctive_terms(spark.createDataFrame([("a", i, "planetas") for i in range(3)], SCHEMA), ["corpus", "id"], ["corpus"])
    assert sorted((r.id, r.terms[0].document_frequency) for r in alone.collect()) == [(0, 3), (1, 3), (2, 3)]


def test_plain_lemma_equals_the_column(spark):
    tokens = ["artistas", "gestores", "pensamientos", "mente", "realmentes", "meses", "luces", "tras", "casas", "rapidamente", "adoradores", "es", "s"]
    frame = spark.createDataFrame([(t,) for t in tokens], "t string")
    for row in frame.select("t", tx.lemma(F.col("t")).alias("l"), F.when(tx.is_content(F.col("t")), tx.lemma(F.col("t"))).alias("c")).collect():
        assert (row.l, row.c) == (tx.plain_lemma(row.t), tx.content_lemma(row.t))


def test_terms_of_a_corpus_are_counted_as_hashes(spark):
    """No row per term of a text is shuffled (F3), and batches and ranges of any size give the same terms."""
    words = ["energía", "solar", "viento", "barata", "planeta", "rojo", "lejano", "mares", "fríos", "bosque"]
    rows = [(None if i % 5 == 0 else "ab"[i % 2], i // 2, " ".join(words[(i * j) % 7 + j % 4] for j in range(1, 3 + i % 9))) for i in range(60)]
    rows += [("a", 1, None), ("a", None, "energía solar"), ("b", 3, rows[3][2])]
    texts = spark.createDataFrame(rows, SCHEMA)
    assert "Window" not in plan(tm.distinctive_terms(texts, ["corpus", "id"], ["corpus"]))
    units = {}
    for corpus, number, text in rows:
        units.setdefault((corpus, number), []).append({"t": text})
    holding = {}
    for (corpus, _), held in units.items():
        for term in tm.counted_terms(held):
            holding[corpus, term] = holding.get((corpus, term), 0) + 1
    results = []
    for batch, spread in ((1_000_000, 8_000_000), (50, 20), (300, 10_000)):
        out = tm.distinctive_terms(texts, ["corpus", "id"], ["corpus"], batch=batch, spread=spread).collect()
        results.append(sorted((str(r.corpus), str(r.id), str(r.terms)) for r in out))
        for r in out:
            total = sum(c == r.corpus for c, _, _ in rows)
            for t in r.terms:
                assert t.document_frequency == holding[r.corpus, t.term]
                score = math.log1p(t.frequency) * (math.log((1 + total) / (1 + t.document_frequency)) + 1) * (1.35 if " " in t.term else 1.0)
                assert abs(t.score - score * (0.65 + 0.35 * t.distribution)) < 1e-9
    assert results[0] == results[1] == results[2] and len(results[0]) > 50


def test_few_of_many_equally_good_phrases_are_looked_up(monkeypatch):
    words = [f"{a}{b}{c}palabra" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    counts = tm.counted_terms([{"t": " ".join(words)}])
    rows = sorted([(1.35 if " " in t else 0.7, t, n, 1) for t, n in counts.items()], key=lambda r: -r[0])
    text = tx.text_normal(" ".join(words))

    class Quarter(str):
        looked = 0

        def __contains__(self, term):
            Quarter.looked += 1
            return str.__contains__(self, term)

    quarters = [Quarter(text[len(text) * i // 4 : len(text) * (i + 1) // 4]) for i in range(4)]
    found = tm.settled_terms(quarters, rows, 8)
    every = sorted((-round(h * (0.65 + 0.35 * s), 9), -n, t, h * (0.65 + 0.35 * s), d, s) for h, t, n, d in rows for s in [sum(str(t) in str(q) for q in quarters) / 4])
    assert found == tm.apart(every, 8)
    assert Quarter.looked < 4 * len(rows) / 4  # all 1,000 phrases before


def test_normal_text_outside_spark_is_the_same(spark):
    texts = ["", "Straße ẞ İstanbul", "Árbol año ĐÐ ǆ Kelvin K", "ΑΣ ﬁn ① x̀y", "".join(chr(c) for c in range(1, 0x250)), "".join(f"a{chr(c)}b" for c in range(0x250, 0x2200))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize(F.col("t")).alias("n")).collect()
    assert [tx.text_normal(r.t) for r in rows] == [r.n for r in rows]
