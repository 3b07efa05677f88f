"""Terms that meet many sentences or texts are prepared once; sentences are ranked inside the row of their text."""

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import candidates as cd
from tidemark.operators import terms as tm

LONG = "la energía solar llega hoy a todas las casas."


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sentences_are_ranked_without_further_shuffles(spark):
    rows = spark.createDataFrame([(1, LONG, ["solar"])], "id int, text string, terms array<string>")
    ranked = tm.rank_sentences(rows, ["id"], "text", "terms")
    assert plan(ranked).count("Exchange hashpartitioning") == 1
    assert plan(ranked).count("(?<=[.!?])") == 1  # texts are split once


def test_repeats_and_null_keys_of_sentences(spark):
    other = "una frase distinta sin nada del tema."
    rows = [(None, f"{LONG} {other} LA ENERGÍA solar llega hoy a todas las casas!", ["solar"]), (None, LONG, ["solar"]), (2, None, ["solar"]), (3, "corta.", ["solar"]), (4, LONG, None)]
    out = {r.id: r.sentences for r in tm.rank_sentences(spark.createDataFrame(rows, "id int, text string, terms array<string>"), ["id"], "text", "terms", 1).collect()}
    assert out[None] == [LONG] and set(out) <= {None, 4}


def test_terms_of_a_summary_are_prepared_once(spark):
    rows = spark.createDataFrame([([LONG, "otra frase que no dice nada aquí.", "casas con energía para toda la vida."], ["energía", "casas"])], "s array<string>, c array<string>")
    summary = cd.extractive_summary(F.col("s"), F.col("c"), 2)
    assert rows.select(summary.alias("x")).first().x == f"{LONG} casas con energía para toda la vida."
    # one normalisation of the concepts, one of a sentence
    assert plan(rows.select(summary.alias("x"))).split("Project", 1)[1].count("regexp_extract_all") == 2


def test_grounding_of_null_and_border_words(spark):
    rows = spark.createDataFrame([(t, x) for t in ("sol", "luz sol", "gatos", "ia", "", None) for x in ("sol y luna", "la luz sol", "un gato", "inteligencia artificial", "solar", "sol", "", None)], "t string, x string")
    old = lambda n, x: (n == "ia" and "inteligencia artificial" in x) or (n != "" and f" {n} " in f" {x} ")
    g = tx.grounded(tx.normalize(F.col("t")), tx.normalize(F.col("x")), tx.lemmas_of(tx.normalize(F.col("x"))))
    for r in rows.select("t", "x", g.alias("g")).collect():
        if r.t is not None and r.x is not None:
            assert r.g.ok == (old(r.t, r.x) or (r.t, r.x) == ("gatos", "un gato")), r


def test_equally_good_terms_are_not_sorted_for_every_few(monkeypatch):
    looks = []
    monkeypatch.setattr(tm, "apart", lambda ranked, maximum: looks.append(len(ranked)) or ranked[:maximum])
    tm.settled_terms(["abc"] * 4, [(1.0, f"termino{i}", 1, 1) for i in range(4000)], 8)
    assert len(looks) < 16
