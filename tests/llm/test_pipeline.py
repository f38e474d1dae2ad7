import random

import corpus
import corpus_pipeline
from pyspark.sql import functions as F
from rackpulse.llm import quality


def small_corpus(spark):
    rng = random.Random(61)
    common = ["the", "of", "and", "to", "in", "is", "that", "it"]

    def prose(lines=8):
        return "\n".join(
            " ".join(rng.choice(common) if rng.random() < 0.4 else f"word{rng.randrange(4000)}" for _ in range(14))
            for _ in range(lines)
        )

    texts = [prose() for _ in range(60)]
    texts += [texts[0], texts[1].replace("the", "The"), texts[2] + "\nand one more line of the text that is new to it all"]
    texts += ["spam " * 100, "", None, "#### !!!! " * 40]
    return corpus.documents(spark, texts, ("a", "b", "c"))


def test_stages(spark, tmp_path):
    docs = small_corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = docs, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{number}")
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = seen[name] = spark.read.parquet(path)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
    kept = {r.doc_id for r in seen["quality"].collect()}
    assert kept == set(range(63))
    lines = seen["line_dedup"].collect()
    all_lines = [line for r in lines for line in r.text.split("\n") if line]
    assert len({line.lower() for line in all_lines}) == len(all_lines)
    left = {r.doc_id for r in seen["near_duplicates"].collect()}
    assert set(range(60)) <= left
    before = seen["near_duplicates"].agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    after = seen["mixing"].agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert abs(before - after) <= 3
    ids = seen["packing"].groupBy("doc_id").agg(F.sum("length")).collect()
    assert {r.doc_id for r in ids} == {r.doc_id for r in seen["mixing"].collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first()[0] == seen["packing"].agg(F.sum("length")).first()[0]


def test_near_duplicates_go(spark, tmp_path):
    rng = random.Random(62)
    base = corpus.text(rng, 12)
    docs = corpus.documents(spark, [base, base.replace(" ", " new ", 1), corpus.text(rng, 12), base + " end"])
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()} == {0, 2}


def test_stages_hand_few_rows_at_once_to_python(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = corpus.documents(spark, ["a few words"] * 5)
    try:
        for _, stage in corpus_pipeline.STAGES:
            for given, wanted in (("10000", "1000"), ("0", "1000"), ("200", "200")):
                spark.conf.set(name, given)
                stage(spark, docs, str(tmp_path))
                assert spark.conf.get(name) == wanted
    finally:
        spark.conf.set(name, before)


def test_empty_tables(spark, tmp_path):
    docs = corpus.odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
    assert quality.judge(docs).count() == 0
