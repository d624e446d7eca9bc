"""Token files read in part: some documents' ids, and the lengths without the ids."""

import glob

import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glosswork.llm import token_files


def test_reads_of_some_documents(spark, tmp_path, monkeypatch):
    """The rows asked for and no others, by predicates that reach the files; files have small pages with indexes and coded ids."""
    monkeypatch.setattr(token_files, "PAGE_BYTES", 4096)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, f"number {i} " + "some words and more " * (i % 90)) for i in range(3000)] + [(None, "no id"), (7, "seven again")]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/t", path, files=3)
    tokenizer = Tokenizer.from_file(path)
    want = sorted((i, [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for i, t in rows if i in (7, 2999, 1500))
    out = token_files.read(spark, f"{tmp_path}/t", [7, 1500, 2999, 5_000_000])
    assert sorted((r["doc"], list(r["ids"])) for r in out.collect()) == want
    assert "PushedFilters: [In(doc, [" in out._jdf.queryExecution().executedPlan().toString()
    lengths = spark.read.parquet(f"{tmp_path}/t").agg(F.sum("n_tokens"))
    assert "ids" not in lengths._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    files = sorted(glob.glob(f"{tmp_path}/t/*.parquet"))
    assert len(files) == 3
    spans = []
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
        assert columns["ids"].has_dictionary_page and columns["ids"].has_offset_index and columns["doc"].has_column_index
        spans.append((columns["doc"].statistics.min, columns["doc"].statistics.max))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # files are in order of ids
