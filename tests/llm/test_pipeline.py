"""The pipeline's stages on odd rows, and what they decide on planted cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with documents that hold a toxic text, an exact and a near copy, a leak, an address, and clean ones."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    slurs = ["vilewight", "vilemonger", "grubbling"]
    rows, marks = [], []
    for k in range(240):
        ws = text(120)
        if k % 3 == 0:
            for _ in range(4):
                ws[rng.randrange(120)] = rng.choice(slurs)
        rows.append((k, " ".join(ws)))
        marks.append((k, 1, int(k % 3 == 0)))
    clean = text(150)
    near = list(clean)
    near[75] = "edited"
    item = text(30)
    rows += [(1000, " ".join(clean)), (1001, " ".join(clean)), (1002, " ".join(near)), (1003, " ".join(text(60) + item + text(60))),
             (1004, " ".join(text(50)) + " ask jo@mail.example.org today"), (1005, " ".join(text(80) + slurs + slurs)), (1006, None), (1007, ""), (1008, ""), (None, " ".join(text(40)))]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("component_id", F.lit("clash")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(5, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_decide_on_planted_cases(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, planted), f"test-{name}")
        assert docs.columns == P.COLUMNS
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = {k for k in range(240) if k % 3} | {1000, 1003, 1004, None}
    assert not {k for k in range(240) if k % 3 == 0} & kept["toxicity"] and 1005 not in kept["toxicity"] and clean <= kept["toxicity"]
    assert clean <= kept["near_duplicates"] and not {1001, 1002, 1007, 1008} & kept["near_duplicates"] and 1006 in kept["near_duplicates"]
    assert kept["decontamination"] == kept["near_duplicates"] - {1003} and kept["personal_data"] == kept["decontamination"]
    masked = {r.doc_id: r for r in docs.collect()}
    assert masked[1004].text.endswith("ask <EMAIL> today") and masked[1004].n_chars == len(masked[1004].text) and masked[1006].text is None
    packed = P.run(spark, planted)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept["personal_data"]


def test_stages_take_empty_and_repeated_rows(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").filter("doc_id is null or doc_id >= 1000")
    twice = docs.unionByName(docs)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), planted).count() == 0
        assert stage(spark, twice, planted).count() > 0, name


def test_texts_of_one_id_are_judged_each(spark, planted):
    rng = random.Random(3)
    one, two, three = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(3))
    rows = [(7, one), (7, two), (7, two), (5, one), (9, two), (9, three), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text or "") for r in P.one_of_each_group(spark, docs, planted).collect())
    assert kept == sorted([(5, one), (7, two), (9, three), (7, "")])
