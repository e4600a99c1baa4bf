import numpy as np
import pyarrow as pa

from quillstone import serving
from quillstone.functions import batches
from quillstone.operators import chunking
from quillstone.sources import site


def test_slices_hold_all_rows_and_few_bytes():
    texts = ["x" * n for n in np.random.default_rng(1).integers(0, 3000, 500).tolist()] + [None, "y" * 20_000, "", None]
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "t": pa.array(texts, pa.string())})
    got = list(batches.in_slices([batch, batch.slice(0, 0), batch.slice(7, 9)], 8_000))
    want = [*enumerate(texts), *list(enumerate(texts))[7:16]]
    assert [row for s in got for row in zip(*s, strict=True)] == want
    assert all(len(n) == 1 or sum(len(x or "") for x in t) <= 8_000 for n, t in got)


def test_workers_hold_a_slice_of_a_batch(spark, monkeypatch):
    """Rows that become Python objects at once are bounded by bytes, and the results do not depend on the slices."""
    docs = [(i, None if i % 17 == 0 else f"# T {i}\n\n" + f"word{i} " * (40 * i) + "\n\n## S\n\n| a | b |\n|---|---|\n| 1 | 2 |") for i in range(60)]
    md = spark.createDataFrame(docs, "doc_id long, markdown string").coalesce(1)
    pages = spark.createDataFrame([(i, None if t is None else f"<p>{t}</p>") for i, t in docs], "doc_id long, html string").coalesce(1)
    content = spark.createDataFrame([(i, (t or "!").encode()) for i, t in docs], "doc_id long, content binary").coalesce(1)

    def convert(data: bytes) -> str:
        if data == b"!":
            raise ValueError("no")
        return data.decode()

    def results():
        return [
            sorted(map(str, chunking.chunk_documents(md).collect())),
            sorted(map(str, pages.select("doc_id", site.html_to_markdown_udf()("html").alias("m")).collect())),
            sorted(map(str, serving.convert_documents(content, convert).collect())),
        ]

    whole = results()
    assert whole[0] == sorted(str(r) for r in spark.createDataFrame([(i, k, *c) for i, t in docs for k, c in enumerate(chunking.chunks(t or ""), 1)], chunking.PIECE).collect())
    assert whole[1] == sorted(str(r) for r in spark.createDataFrame([(i, site.html_to_markdown(None if t is None else f"<p>{t}</p>")) for i, t in docs], "doc_id long, m string").collect())
    assert len(whole[2]) == 60 and sum("ValueError: no" in r for r in whole[2]) == 4
    monkeypatch.setattr(batches, "SLICE", 1)
    assert results() == whole
