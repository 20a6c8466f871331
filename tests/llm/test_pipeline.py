import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from innkeep.llm import decontamination, quality
from test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def test_each_stage_matches_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    cols = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for no, (name, stage) in enumerate(P.STAGES):
        rows = [r.asDict() for r in docs.collect()]
        path = str(tmp_path / str(no))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        got = docs.collect()
        ids = sorted(r["doc_id"] for r in rows)
        if no == 0:
            want = sorted(r["doc_id"] for r in rows if model.score(r["text"]) >= 0.7)
        elif no == 1:
            comp = brute_components({r["doc_id"]: brute_fp(r["text"]) for r in rows})
            want = sorted(i for i, c in comp.items() if i == c)
        elif no == 2:
            m = decontamination.Matcher(bench)
            want = sorted(r["doc_id"] for r in rows if not m.matches(r["text"]))
            exact = [decontamination.normalise(t) for _, t in bench]
            assert not [r for r in got if any(e in decontamination.normalise(r.text) for e in exact)]
        elif no == 3:
            want = ids
            assert all(r.n_chars == len(r.text) for r in got)
            assert not [r for r in got if "@" in (r.text or "") and ".com" in r.text.split("@")[1][:30]]
        else:
            enc = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            lengths = {r["doc_id"]: len(enc.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows}
            found = {}
            for r in got:
                found[r.doc_id] = found.get(r.doc_id, 0) + r.length
            assert found == lengths
            break
        assert docs.columns == cols and sorted(r.doc_id for r in got) == want


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for no, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(no)))
        docs = spark.read.parquet(str(tmp_path / str(no)))
    assert docs.count() == 0
