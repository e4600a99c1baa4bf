import json
import threading
import urllib.request

from quillstone import serving


def test_answers_with_sources(spark):
    corpus = spark.createDataFrame([("a", "On stars", "white dwarfs are small stars"), ("b", "On rocks", "granite is a rock"), ("c", "Empty", None)], "doc_key string, title string, content string")
    reply, sources = serving.answer_question(spark, corpus, "white dwarfs", [])
    assert reply == "Found: [1]" and sources == "[1] *On stars*"
    reply, sources = serving.answer_question(spark, corpus, "zzz", [])
    assert reply == "Nothing was found." and sources == serving.NO_SOURCES


def test_http():
    server = serving.serve(lambda m, h: (None, None) if m == "fail" else (f"{m}{len(h)}", "s"))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def post(body):
        return json.load(urllib.request.urlopen(urllib.request.Request(f"{base}/api/chat", json.dumps(body).encode())))

    assert json.load(urllib.request.urlopen(f"{base}/health")) == {"status": "ok"}
    assert post({"message": "hi", "history": [1]}) == {"reply": "hi1", "sources": "s"}
    assert post({"message": "fail"})["reply"] == serving.APOLOGY
    server.shutdown()
