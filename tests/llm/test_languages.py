"""Held-out accuracy of the classifier, and texts that are no language."""

from pyspark.sql import functions as F

from strandline.llm import languages as L

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))
    model = L.fit(docs.where(half == 0), "doc_id", "text", "lang")
    langs = L.per_language(L.classify(docs.where(half == 1), "doc_id", "text", model), "doc_id").where("n_langs = 1")
    lab = docs.select(F.col("doc_id").alias("k"), L.label_key(F.col("lang")).alias("l")).where("l is not null")
    r = langs.join(lab, F.col("doc_id") == F.col("k")).agg(F.avg((F.col("lang") == F.col("l")).cast("int")), F.count("*")).first()
    assert r[1] > 300 and r[0] > 0.9  # a few labels are wrong on purpose


def test_segments_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs, "doc_id", "text", "lang")
    en, fr = "The council will meet again next month to decide what should be done.", "La police a fermé la route après que les mineurs ont dressé des barricades."
    rows = [(1, f"{en} {fr}", "x"), (2, f'{en} "Vive la grève" {en}', "x"), (3, None, "x"), (4, "", "x"), (5, "  \n", "x"), (6, "12:40 / 13:05", "x"), (7, f"<p>{fr.upper()}</p>", "x"), (8, fr.encode().decode("latin-1"), "x"), (9, f"{en} " * 400, "x"), (1, f"{en} {fr}", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")  # clashing names
    got = {}
    for r in L.classify(df, "doc_id", "text", model).where("lang is not null").collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert got == {1: {"en", "fr"}, 2: {"en"}, 7: {"fr"}, 8: {"fr"}, 9: {"en"}}
    runs = L.classify(spark.createDataFrame([(1, f"<b>{en}</b> {en}\n{fr} La route après que."), (2, "Golden Arrow\n" + en)], "doc_id long, text string"), "doc_id", "text", model).collect()
    text = f"<b>{en}</b> {en}\n{fr} La route après que."
    at = {(r.doc_id, r.segment): r for r in runs}
    assert (at[1, 1].lang, at[1, 1].n_sentences, at[1, 2].lang, at[1, 2].n_sentences) == ("en", 2, "fr", 2) and len(runs) == 3
    assert text[at[1, 1].start : at[1, 1].end] == f"{en}</b> {en}" and text[at[1, 2].start : at[1, 2].end] == f"{fr} La route après que."
    assert at[2, 1].start == 13  # a name is no sentence
    assert L.classify(df.limit(0), "doc_id", "text", model).count() == 0
    empty = L.fit(df.limit(0), "doc_id", "text", "lang")
    assert L.classify(df, "doc_id", "text", empty).where("lang is not null").count() == 0


def test_label_notations(spark):
    want = {"en": "en", "EN": "en", "en_GB": "en", "pt-BR": "pt", "spa": "es", "German": "de", "ger": "de", "ind": "id", "und": None, "": None, "xx": None, None: None, "unknown": None}
    got = spark.createDataFrame([(k,) for k in want], "l string").select("l", L.label_key(F.col("l")).alias("c")).collect()
    assert {r.l: r.c for r in got} == want
