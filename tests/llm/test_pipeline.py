"""The pipeline against stage-by-stage expectations on a planted corpus."""

import random

import __spark_entry__ as entry
import corpus_pipeline
from quillspark.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} == {q if q == "pipeline" else q.split("_")[0] for q in entry.queries() if q == "pipeline" or q[2:3].isdigit() and q.startswith("op")}


def test_planted_corpus(spark, tmp_path):
    draw = random.Random(1)
    common = "the of and to a in is that for it with".split()

    def prose(n):
        return [draw.choice(common) if k % 3 == 0 else "".join(draw.choices("bcdfghjklm", k=2)) + "".join(draw.choices("aeiou", k=1)) + str(draw.randint(0, 99)) for k in range(n)]

    items = [" ".join(prose(30)) + "." for _ in range(10)]
    clean = ["\n".join(" ".join(prose(40)) + "." for _ in range(4)) for _ in range(60)]
    junk = [" ".join(w + "%%%" for w in prose(80)) for _ in range(10)]
    leaks = [clean[i].replace("\n", "\n" + items[i] + "\n", 1) + "\n" + " ".join(prose(60)) + "." for i in range(5)]
    leaks = ["\n".join([" ".join(prose(50)) + ".", items[i], " ".join(prose(50)) + "."]) for i in range(5)]
    near = [clean[i] for i in range(20, 25)]
    texts = clean + junk + leaks + near
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    copies = set(range(75, 80))
    assert set(range(60)) <= set(out) and not set(out) & set(range(60, 75))
    # a copy has lost all its lines to the first; of the texts left empty one document stays at most
    assert len(set(out) & copies) <= 1
    assert all(r.round_trip for r in out.values())
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert out[0].ids == lib.encode(texts[0], add_special_tokens=False).ids


def test_pipeline_runs_on_the_tables(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
