"""Each stage of the pipeline on awkward and empty tables, and run() against its stages' own rules."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
ROWS = [(None, None, None, None), (1, "", "en", "a"), (2, "word", None, "a"), (2, "word", None, "a"), (3, "x " * 30_000, "en", None), (None, "no id at all, but some text", "en", "b"), (4, "One line that is long enough to count.\nOne line that is long enough to count!", "de", "b"), (5, "y" * 3_000_000, "en", "a"), (6, "One line that is long enough to count.\nand one of its own", "de", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(params=["awkward", "empty", "nulls"])
def odd(spark, request):
    rows = {"awkward": ROWS, "empty": [], "nulls": [(None, None, None, None)] * 3}[request.param]
    d = spark.createDataFrame(rows, SCHEMA)
    names = {"row": F.lit(1), "size": F.lit("clash"), "key": F.lit(0), "id": F.lit("other"), "shard": F.lit(2), "bits": F.lit(3), "n_chars": F.char_length("text").cast("long"), "target": F.lit("t"), "h1": F.lit(4), "pos": F.lit(5)}
    return d.withColumns(names)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_tables(spark, odd, name, stage):
    out = stage(spark, odd, DATA)
    rows = out.collect()
    if not odd.count():
        assert rows == []
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == odd.columns and [t for _, t in out.dtypes] == [t for _, t in odd.dtypes]
        texts = {r.text for r in odd.collect()}
        assert all(r.row == 1 and r["size"] == "clash" and r.id == "other" and r.pos == 5 for r in rows)
        if name in ("quality classifier", "SimHash near-dedup"):  # these keep or drop whole documents
            assert all(r.text in texts for r in rows) and len(rows) <= odd.count()
        assert all(r.text is None or r.n_chars == len(r.text) for r in rows)


def test_near_dedup_and_lines_keep_one_of_each(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    _, line_stage = corpus_pipeline.STAGES[1]
    got = [(r.doc_id, r.text) for r in line_stage(spark, d, DATA).collect()]
    # The line of 4 and 6 stays once, the one apart from it by one character goes.
    whole = "\n".join(t for _, t in got if t)
    assert whole.count("One line that is long enough to count.") == 1 and "count!" not in whole and "and one of its own" in whole
    _, near = corpus_pipeline.STAGES[2]
    kept = [r.text for r in near(spark, d, DATA).collect()]
    assert kept.count("word") == 1 and "y" * 3_000_000 in kept


def test_run_is_its_stages(spark):
    """Every piece's ids come from one document of the mix, in order, and each document's pieces make up all of its ids."""
    from siltstone.llm import packing
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).toPandas(), docs.schema)
    tok = Tokenizer.from_file(packing.vocabulary())
    want = {}
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.setdefault(r.doc_id, []).append(len(ids))
    got = corpus_pipeline.run(spark, DATA).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").toPandas()
    per = got.groupby("doc_id").length.sum().to_dict()
    assert per == {k: sum(v) for k, v in want.items()}
    filled = got.groupby("sequence_id").length.sum()
    assert filled.max() <= 4096
    ends = got.sort_values(["sequence_id", "offset"])
    for _, s in ends.groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
