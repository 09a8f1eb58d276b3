"""A build leaves postings where the texts are, in runs that are sorted by words."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from docquarry.operators import postings
from docquarry.operators.postings import PostingIndex


def test_a_build_shuffles_no_postings(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    plan = postings.postings_of(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    # texts of the same id are put together, without a look at all texts beforehand to find ranges
    twice = postings.postings_of(docs.unionByName(docs), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in twice and "rangepartitioning" not in twice


def test_a_segment_is_sorted_by_words(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("doc_id < 100").coalesce(1)
    for name, rows in (("once", docs), ("twice", docs.unionByName(docs))):
        index = PostingIndex(spark, str(tmp_path / name))
        segment = index.add(rows, "doc_id", "text")
        files = list((tmp_path / name / segment / "postings").glob("*.parquet"))
        for file in files:
            words = pq.read_table(file, columns=["word"])["word"].to_pylist()
            assert words == sorted(words)
        found = index.ids_phrase("ther and").collect()
        assert len(found) == len(set(found)) and index.postings().count() == sum(pq.ParquetFile(f).metadata.num_rows for f in files)


def test_runs():
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6)), pa.array(["a" * n if n is not None else None for n in (5, 0, None, 3 << 20, 1 << 20, 1)])], names=["id", "text"])
    assert [s.num_rows for s in postings._slices([batch], 1 << 22)] == [4, 2]
    texts = pa.RecordBatch.from_arrays([pa.array([7, 3]), pa.array(["Zoo King İce king", None])], names=["id", "text"])
    assert postings._grouped(texts).to_pylist() == [{"word": "king", "id": 7, "positions": [1, 4]}, {"word": "zoo", "id": 7, "positions": [0]}]
    assert postings._grouped(texts.slice(1)).num_rows == 0
