"""The pipeline's stages take effect on planted rows and keep clean ones."""

import sentencepiece
import public_tokenizers

import corpus_pipeline


def clean(seed, n=70):
    return " ".join(f"word{seed * 1000 + i}" for i in range(n)) + "."


def test_stages(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    rows = [
        (1, clean(1), "en", "a", 10),
        (2, clean(1) + " extra", "en", "a", 10),
        (3, clean(3) + " " + item, "en", "a", 10),
        (4, clean(4) + " write to jo@mail.example.com", "en", "b", 10),
        (5, "too short", "en", "b", 9),
        (6, None, None, None, None),
        (None, clean(7), "fr", "b", 10),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 4, None}
    assert got[1]["text"] == clean(1) and got[1]["n_chars"] == 10 and all(r["round_trip"] for r in got.values())
    assert "jo@mail" not in got[4]["text"] and got[4]["text"].startswith(clean(4)) and got[4]["n_chars"] == len(got[4]["text"])
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert got[4]["ids"] == model.encode(got[4]["text"], add_eos=True)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "private_data", "sentencepiece"]


def test_failing_lines_leave_the_kept_documents(spark, tmp_path):
    lines = [clean(1), "Home | About | News | Contact", clean(2)]
    rows = [(1, "\n".join(lines), "en", "a", 10), (2, clean(3) + "\n\n" + clean(4), "en", "a", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()}
    assert got[1]["text"] == clean(1) + "\n" + clean(2) and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == rows[1][1] and got[2]["n_chars"] == 10
