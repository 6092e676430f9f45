import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from judgeloom.llm import packing

EN, FR = "the of and that with this from one some other", "le de et que avec cette dans une autre pour"


def prose(seed, words=EN, n=60):
    draw = np.random.RandomState(seed)
    return " ".join(draw.choice([*words.split(), *(f"{w}{k}" for w in words.split() for k in "abcdefgh")], n))


def test_run_against_its_stages_by_hand(spark, tmp_path):
    bench = prose(999, n=30)
    rows = [(i, prose(i, EN if i % 2 else FR), "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, prose(3, EN), "en"), (101, prose(5, EN) + " changed", "en"), (102, "12 34 !!", "en"), (103, None, None), (104, "", "fr")]
    rows += [(105, prose(200) + " " + bench + " " + prose(201), "en"), (106, prose(300) + " write to me@site.org please", "en")]
    docs = spark.createDataFrame([(d, t, g, "src", len(t or "")) for d, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["doc_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {d: t for d, t, _ in rows if d not in (100, 101, 102, 103, 104, 105)}
    want[106] = want[106].replace("me@site.org", "[EMAIL]")
    direct = Tokenizer.from_file(path("word_bpe_49k.json"))
    assert got == {d: len(direct.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "near-duplicates" and packing.LENGTH == 2048


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, node string, __extra int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0


def test_an_empty_table_gives_no_piece(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_leave_one(spark, tmp_path):
    rows = [(i % 20, prose(i % 20), "en", None, 1) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).where("start = 0").collect()) == list(range(20))
