"""Services over HTTP, against a server of the tests' own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.operators import embedding, remote


def vector(text):
    return [float(len(text)), float(text.count("a")), 1.0]


class Service(BaseHTTPRequestHandler):
    seen, uploads, fail, broken = [], {}, {}, set()

    def log_message(self, *args):
        pass

    def reply(self, value, code=200):
        data = value if isinstance(value, bytes) else json.dumps(value).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        if self.path.startswith("/v1/batches/"):
            job = self.path.rsplit("/", 1)[-1]
            self.fail[job] = self.fail.get(job, 0) + 1
            return self.reply({"status": "failed" if job in self.broken else "completed" if self.fail[job] > 1 else "in_progress", "output_file_id": job})
        lines = [json.loads(x) for x in self.uploads[self.path.split("/")[3]].splitlines()]
        out = [{"custom_id": x["custom_id"], "response": {"body": {"data": [{"embedding": vector(x["body"]["input"])}]}}} for x in reversed(lines)]
        return self.reply("".join(json.dumps(x) + "\n" for x in out).encode())

    def do_POST(self):
        raw = self.rfile.read(int(self.headers["Content-Length"]))
        self.seen.append((self.path, self.headers.get("Authorization") or self.headers.get("x-goog-api-key")))
        if self.path == "/v1/files":
            name = f"f{len(self.uploads)}"
            self.uploads[name] = raw.split(b"application/jsonl\r\n\r\n")[1].rsplit(b"\r\n--", 1)[0].decode()
            return self.reply({"id": name})
        body = json.loads(raw)
        if self.path == "/v1/batches":
            return self.reply({"id": body["input_file_id"]})
        if self.path == "/v1/embeddings":
            if body["model"] == "refused":
                return self.reply({}, 401)
            if body["model"] == "busy" and self.fail.setdefault("busy", 2):
                self.fail["busy"] -= 1
                return self.reply({}, 503)
            rows = [{"index": i, "embedding": vector(t)} for i, t in enumerate(body["input"])]
            return self.reply({"data": rows[::-1]})
        if self.path == "/v1/rerank":
            return self.reply({"results": [{"index": i, "relevance_score": len(t)} for i, t in enumerate(body["documents"]) if "skip" not in t]})
        return self.reply({"embeddings": [{"values": vector(r["content"]["parts"][0]["text"])} for r in body["requests"]]})


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


SETTINGS = {
    "dimension": {"m": 3}, "max_request_size": {"m": 2}, "normalize": {"n": True}, "default_scores": {"m": {"score": 0.5, "local": 1}},
    "providers": {"127.0.0.1": {"normalization": {"m": "org/m"}, "batch": {"dialect": "openai", "endpoint": "/v1/batches", "completed": "completed", "failed": ["failed"], "output_file_key": "output_file_id", "max_batch_size": 2}}},
}


def test_embedding(spark, base):
    settings = remote.Settings(SETTINGS)
    service = remote.connect("openai", "far", base, "m", "hidden", settings)
    texts = ["a", "bb", "aab", "", "aaaa"]
    assert np.array_equal(service(texts), np.array([vector(t) for t in texts], np.float32)) and service([]).shape[0] == 0
    assert ("/v1/embeddings", "Bearer hidden") in Service.seen and "hidden" not in repr(service)
    assert np.allclose(np.linalg.norm(remote.connect("openai", "unit", base, "n", None, settings)(texts), axis=1), 1)
    expected = service(texts)
    assert np.array_equal(remote.connect("gemini", "content", base, "m", "key", settings)(texts), expected) and Service.seen[-1] == ("/v1/models/org/m:batchEmbedContents", "key")
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "bbb")], "doc_id long, text string")
    got = {r["doc_id"]: r["q"] for r in embedding.embed(docs, "text", "far").collect()}
    assert got[2] is None and len(got[1]) == 3 and got[1] != got[3]
    with pytest.raises(remote.Refused, match="401"):
        embedding.called(remote.Embedder(base, "refused"), ["a"])
    assert embedding.called(remote.Embedder(base, "busy"), ["a"]).shape == (1, 3) and Service.fail["busy"] == 0
    with pytest.raises(remote.Refused, match="other vectors"):
        remote.Embedder(base, "m", None, remote.Settings({"dimension": {"m": 4}}))(["a"])
    with pytest.raises(ValueError, match="version"):
        remote.connect("openai", "x", base[:-3], "m", None, settings)
    with pytest.raises(KeyError):
        remote.connect("other", "x", base, "m")


def test_rerank(spark, base):
    remote.connect_reranker("far", base, "r", "key")
    hits = spark.createDataFrame([(1, d, d) for d in range(1, 5)], "query_id long, doc_id long, rank int")
    texts = spark.createDataFrame([(1, "x"), (2, "xxx"), (3, "skip me please"), (4, None)], "doc_id long, text string")
    got = embedding.rerank(hits, texts, spark.createDataFrame([(1, "q")], "query_id long, text string"), "doc_id", "far", 4).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [2, 1, 3, 4] and remote.Reranker(base, "r")("q", []) == []


def test_jobs(spark, base, tmp_path):
    service = remote.Embedder(base, "m", "key", remote.Settings(SETTINGS))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "a", None, "c\nd", "é", ""])], "doc_id long, text string").repartition(2)
    jobs = remote.Jobs(service, f"file://{tmp_path}/jobs", 0.01)
    got = {r["doc_id"]: r["q"] for r in jobs.embed(rows, "text").collect()}
    assert got[0] == got[2] and got[3] is None and all(len(q) == 3 for i, q in got.items() if i != 3)
    sent = [json.loads(x) for u in Service.uploads.values() for x in u.splitlines()]
    assert len(sent) == 5 and max(len(u.splitlines()) for u in Service.uploads.values()) <= 2 and sent[0]["body"]["model"] == "org/m"
    n = len(Service.seen)
    assert {r["doc_id"]: r["q"] for r in jobs.embed(rows, "text").collect()} == got and len(Service.seen) == n  # nothing is sent again
    with pytest.raises(ValueError, match="no answer"):
        jobs.embed(rows.withColumn("text", F.concat("text", F.lit("!"))), "text")
    other = remote.Jobs(service, f"file://{tmp_path}/other", 0.01)
    Service.broken |= {f"f{i}" for i in range(len(Service.uploads), 99)}
    with pytest.raises(RuntimeError, match="failed"):
        other.embed(rows, "text")
    Service.broken.clear()
    assert {r["doc_id"]: r["q"] for r in other.embed(rows, "text").collect()} == got
    with pytest.raises(ValueError, match="no jobs"):
        remote.Jobs(remote.Embedder(base, "m"), f"file://{tmp_path}/none").embed(rows, "text")
    assert remote.request_line("mistral", "m") is not None


def test_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(SETTINGS))
    got = remote.Settings.read(spark, f"file://{tmp_path}/s.json")
    assert (got.dimension("m"), got.default_scores("m"), got.default_scores("x"), got.request_size("x"), got.api_name("h", "m")) == (3, (0.5, 1.0), (0.0, 0.0), 2048, "m")
    with pytest.raises(KeyError):
        got.dimension("x")
