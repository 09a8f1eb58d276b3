"""Postings are grouped inside a text before they are shuffled."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docquarry.functions import text as words
from docquarry.operators import postings

TEXTS = [
    (1, "the The tHE, a an and-the_9 " + "x" * 40 + " " + "x" * 35), (2, None), (3, ""), (4, "the"), (5, "ab"), (6, "the"), (7, " Äthe theKing İstanbul\n日本the語the "),
    (8, "the other"), (8, "an other the"), (None, "the end"), (None, "no end"), (9, "the " * 3000),
]


def exploded(docs):
    """A row for each token, grouped after that."""
    every = docs.select("id", F.posexplode(words.tokens(F.col("text")))).toDF("id", "pos", "word").where(F.length("word") >= words.WORD_LENGTH)
    return every.groupBy("word", "id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def found(df):
    rows = [(r.word, r.id, tuple(r.positions)) for r in df.select("word", "id", "positions").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_grouped_as_exploded(spark, tiny):
    for rows in (TEXTS, [r for r in TEXTS if r[0] and r[0] < 8], [(1, ""), (2, None)], []):
        docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
        assert found(postings.postings_of(docs, "id", "text")) == found(exploded(docs))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("concat('d', doc_id) AS id", "text")
    assert found(postings.postings_of(docs, "id", "text")) == found(exploded(docs))


def test_a_row_of_a_text_and_word_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "the " * 1000), (2, "the end " * 1000)], "id long, text string")
    plan = postings.postings_of(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6)), pa.array(["a" * n if n is not None else None for n in (5, 0, None, 3 << 20, 1 << 20, 1)])], names=["id", "text"])
    assert [s.num_rows for s in postings._slices([batch])] == [3, 1, 1, 1]
    assert [s.num_rows for s in postings._slices([batch.slice(4)])] == [1, 1]
