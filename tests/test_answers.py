from pyspark.sql import functions as F

from quillstone.operators import answers
from quillstone.plans.catalogue import QUERIES
from quillstone.plans.retrieval import final, questions


def test_every_question_is_answered(spark):
    d = "/root/testdata/sf0.001"
    found = {}
    for r in final(spark, d).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append({"key": r["doc_key"]})
    want = []
    for q in questions(spark, d).collect():
        docs = found.get(q["query_id"], [])
        a = answers.answer_loop(answers.RuleModel(), q["query"], docs[:2], {"search_papers": lambda args, d=docs: d}, 1)
        want.append((q["query_id"], a.reply, len(a.docs), len(a.calls)))
    assert len(want) > 5
    assert sorted(map(tuple, QUERIES["udf07_answer_loop"](spark, d).collect())) == sorted(want)
    assert sorted(r["query_id"] for r in QUERIES["udf11_entry_point"](spark, d).collect()) == sorted(w[0] for w in want)


def test_documents_are_embedded_whole(spark, tmp_path):
    spark.createDataFrame([(1, "alpha " * 300 + "zebra " * 900)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(64)).cast("int") for w in ("alpha", "zebra")]).first()
    assert at[0] != at[1]
    want = [0.0] * 64
    want[at[0]], want[at[1]] = round(0.1**0.5, 6), round(0.9**0.5, 6)
    assert QUERIES["udf03_document_embedder"](spark, str(tmp_path)).first()["embedding"] == want
