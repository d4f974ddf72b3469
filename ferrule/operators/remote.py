"""Embedding and rerank services over HTTP, their settings, and jobs of many texts at once.

A service is registered by name like any provider and called in the tasks. Answers that say the request itself
is wrong are raised at once; others are tried again by `embedding.called`.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import vectors
from ferrule.sources import archive, snapshot

from . import embedding

AGAIN = (408, 429)


class Refused(RuntimeError):
    """The service won't take this request however often it is sent."""


def send(url: str, body: bytes | Mapping | None, headers: Mapping[str, str], timeout: float = 600) -> bytes:
    """What a service answers; a mapping goes as JSON, nothing as GET."""
    kind = {} if body is None or isinstance(body, bytes) else {"Content-Type": "application/json"}
    data = body if body is None or isinstance(body, bytes) else json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, {**kind, **headers}), timeout=timeout) as answer:
            return answer.read()
    except urllib.error.HTTPError as e:
        if 400 <= e.code < 500 and e.code not in AGAIN:
            raise Refused(f"{urlsplit(url).netloc}: {e.code} {e.reason}") from None
        raise


@dataclass(frozen=True)
class Settings:
    """What is known of models and of services, by the host of their address."""

    values: Mapping[str, Any]

    @staticmethod
    def read(spark: SparkSession, path: str) -> Settings:
        """From a JSON file, or from YAML where its reader is installed."""
        with archive.Source(spark, path) as f:
            text = f.readall().decode()
        try:
            return Settings(json.loads(text))
        except ValueError:
            try:
                import yaml
            except ImportError:
                raise ValueError(f"{path} is no JSON, and there is no reader for YAML") from None
            return Settings(yaml.safe_load(text) or {})

    def _of(self, part: str, name: str, default: Any = None) -> Any:
        return (self.values.get(part) or {}).get(name, default)

    def dimension(self, model: str) -> int:
        found = self._of("dimension", model)
        if found is None:
            raise KeyError(f"no dimension of {model}")
        return int(found)

    def default_scores(self, model: str) -> tuple[float, float]:
        """Of distant and of local records."""
        found = self._of("default_scores", model) or {}
        return float(found.get("score", 0)), float(found.get("local", 0))

    def normalize(self, model: str) -> bool:
        return bool(self._of("normalize", model, False))

    def request_size(self, model: str, default: int = 2048) -> int:
        return int(self._of("max_request_size", model, default))

    def api_name(self, host: str, model: str) -> str:
        return ((self._of("providers", host) or {}).get("normalization") or {}).get(model, model)

    def jobs(self, host: str) -> Mapping[str, Any] | None:
        return (self._of("providers", host) or {}).get("batch")


def checked(found: Sequence[Sequence[float]], n: int, dimension: int | None, normalize: bool) -> np.ndarray:
    """A row for each text, of the model's dimension where it is known."""
    out = np.asarray(found, np.float32).reshape(n, -1 if n else dimension or 0) if len(found) == n else None
    if out is None or (dimension and out.shape[1] != dimension):
        raise Refused("the service gave other vectors than were asked for")
    if normalize:
        size = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, size, out=out, where=size != 0)
    return out


@dataclass(frozen=True)
class Embedder:
    """POST {base}/embeddings; `base` ends in the version of the interface."""

    base: str
    model: str
    key: str | None = field(default=None, repr=False)
    settings: Settings = Settings({})

    @property
    def host(self) -> str:
        return urlsplit(self.base).hostname or ""

    def headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.key}"} if self.key else {}

    def parts(self, texts: Sequence[str]) -> list[Sequence[str]]:
        size = self.settings.request_size(self.model)
        return [texts[i : i + size] for i in range(0, len(texts), size)]

    def vectors(self, found: list, n: int) -> np.ndarray:
        known = (self.settings.values.get("dimension") or {}).get(self.model)
        return checked(found, n, known and int(known), self.settings.normalize(self.model))

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        found: list = []
        for part in self.parts(texts):
            body = {"model": self.settings.api_name(self.host, self.model), "input": list(part), "encoding_format": "float"}
            rows = json.loads(send(f"{self.base.rstrip('/')}/embeddings", body, self.headers()))["data"]
            found += [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]
        return self.vectors(found, len(texts))


@dataclass(frozen=True)
class ContentEmbedder(Embedder):
    """POST {base}/models/{model}:batchEmbedContents, with the key in a header."""

    def headers(self) -> dict[str, str]:
        return {"x-goog-api-key": self.key} if self.key else {}

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        name, found = self.settings.api_name(self.host, self.model), []
        for part in self.parts(texts):
            body = {"requests": [{"model": f"models/{name}", "content": {"parts": [{"text": t}]}} for t in part]}
            found += [r["values"] for r in json.loads(send(f"{self.base.rstrip('/')}/models/{name}:batchEmbedContents", body, self.headers()))["embeddings"]]
        return self.vectors(found, len(texts))


@dataclass(frozen=True)
class Reranker:
    """POST {base}/rerank; a score for each text, in their order. Texts that the service leaves out come last."""

    base: str
    model: str
    key: str | None = field(default=None, repr=False)

    def __call__(self, query: str, texts: Sequence[str]) -> list[float]:
        if not texts:
            return []
        body = {"model": self.model, "query": query, "documents": list(texts), "top_n": len(texts)}
        scores = [float("-inf")] * len(texts)
        for r in json.loads(send(f"{self.base.rstrip('/')}/rerank", body, {"Authorization": f"Bearer {self.key}"} if self.key else {}))["results"]:
            scores[r["index"]] = float(r["relevance_score"])
        return scores


DRIVERS = {"openai": Embedder, "gemini": ContentEmbedder}


def connect(driver: str, name: str, base: str, model: str, key: str | None = None, settings: Settings = Settings({})) -> Embedder:
    """Registers a service as a provider. The address of a host that the settings list must end in a version."""
    if driver not in DRIVERS:
        raise KeyError(f"no driver {driver}; there are {', '.join(sorted(DRIVERS))}")
    service = DRIVERS[driver](base, model, key, settings)
    last = urlsplit(base).path.rstrip("/").rsplit("/", 1)[-1]
    if service.host in (settings.values.get("providers") or {}) and not re.fullmatch(r"v\d+\w*", last):
        raise ValueError(f"{service.host}: the address must end in the version of the interface, as in /v1")
    return embedding.register(name)(service)


def connect_reranker(name: str, base: str, model: str, key: str | None = None) -> Reranker:
    return embedding.register(name, embedding.RERANKERS)(Reranker(base, model, key))


# Jobs: texts go up as files of JSON lines, and come back as such some time later.


def request_line(dialect: str, model: str) -> F.Column:
    """The line of one text; `custom_id` names it in the answer."""
    if dialect == "mistral":
        return F.to_json(F.struct("custom_id", F.struct(F.col("text").alias("input"), F.lit("float").alias("encoding_format")).alias("body")))
    body = F.struct(F.lit(model).alias("model"), F.col("text").alias("input"), F.lit("float").alias("encoding_format"))
    return F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), body.alias("body")))


def answers(lines: DataFrame) -> DataFrame:
    """(custom_id, v) from lines of answers; lines without a vector give none."""
    shape = "custom_id string, response struct<body:struct<data:array<struct<embedding:array<float>>>>>"
    rows = lines.select(F.from_json("value", shape).alias("r")).select("r.custom_id", F.get("r.response.body.data", F.lit(0))["embedding"].alias("v"))
    return rows.filter("custom_id is not null and v is not null")


@dataclass(frozen=True)
class Jobs:
    """Embedding by jobs. `folder` keeps requests, the ids of what was sent and answers, so that a run that stopped goes on without sending again."""

    service: Embedder
    folder: str
    wait: float = 10.0

    @property
    def origin(self) -> str:
        at = urlsplit(self.service.base)
        return f"{at.scheme}://{at.netloc}"

    @property
    def rules(self) -> Mapping[str, Any]:
        found = self.service.settings.jobs(self.service.host)
        if not found:
            raise ValueError(f"no jobs are known of {self.service.host}")
        return found

    def embed(self, rows: DataFrame, text: str) -> DataFrame:
        """All columns and `q`; each distinct text is sent once, null texts never. Texts without an answer are an error."""
        spark, requests = rows.sparkSession, f"{self.folder}/requests"
        keyed = rows.withColumn("_d", F.sha2(text, 256))
        if not snapshot.exists(spark, f"{requests}/_SUCCESS"):
            asked = keyed.filter(F.col(text).isNotNull()).select(F.col("_d").alias("custom_id"), F.col(text).alias("text")).dropDuplicates(["custom_id"])
            name = self.service.settings.api_name(self.service.host, self.service.model)
            lines = asked.select(request_line(self.rules["dialect"], name).alias("value"))
            lines.write.mode("overwrite").option("maxRecordsPerFile", int(self.rules.get("max_batch_size", 50000))).text(requests)
        names = [name for name, size in archive.files(spark, requests) if name.startswith("part-") and size]
        for name in names:  # a call for each file of up to max_batch_size texts
            self.submit(spark, name)
        for name in names:
            self.collect(spark, name)
        found = answers(spark.read.schema("value string").text(f"{self.folder}/answers") if names else spark.createDataFrame([], "value string")).dropDuplicates(["custom_id"])
        out = keyed.join(found.withColumnRenamed("custom_id", "_d"), "_d", "left")
        lost = out.filter(F.col(text).isNotNull() & F.col("v").isNull()).count()
        if lost:
            raise ValueError(f"{lost} rows have no answer")
        return out.withColumn("q", vectors.encode_q15(F.col("v"))).drop("_d", "v")

    def submit(self, spark: SparkSession, name: str) -> None:
        note = f"{self.folder}/jobs/{name}.json"
        if snapshot.exists(spark, note):
            return
        with archive.Source(spark, f"{self.folder}/requests/{name}") as f:
            lines = f.readall()
        mark = uuid.uuid4().hex
        parts = [f'--{mark}\r\nContent-Disposition: form-data; name="purpose"\r\n\r\nbatch\r\n', f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{name}.jsonl"\r\nContent-Type: application/jsonl\r\n\r\n']
        body = "".join(parts).encode() + lines + f"\r\n--{mark}--\r\n".encode()
        file = json.loads(send(f"{self.origin}/v1/files", body, {**self.service.headers(), "Content-Type": f"multipart/form-data; boundary={mark}"}))["id"]
        if self.rules["dialect"] == "mistral":
            job = {"input_files": [file], "model": self.service.settings.api_name(self.service.host, self.service.model), "endpoint": "/v1/embeddings", "timeout_hours": 24}
        else:
            job = {"input_file_id": file, "endpoint": "/v1/embeddings", "completion_window": "24h"}
        sent = json.loads(send(self.origin + self.rules["endpoint"], job, self.service.headers()))["id"]
        snapshot.write_text(spark, note, json.dumps({"id": sent}))

    def collect(self, spark: SparkSession, name: str) -> None:
        """Waits for a job and writes its answers; a job that failed is an error, and sent anew by the next run."""
        target, note = f"{self.folder}/answers/{name}", f"{self.folder}/jobs/{name}.json"
        if snapshot.exists(spark, target):
            return
        with archive.Source(spark, note) as f:
            job = json.loads(f.readall())["id"]
        while True:
            state = json.loads(send(f"{self.origin}{self.rules['endpoint']}/{job}", None, self.service.headers()))
            if state["status"] == self.rules["completed"]:
                break
            if state["status"] in self.rules["failed"]:
                fs, at = snapshot._fs(spark, note)
                fs.delete(at, False)
                raise RuntimeError(f"job {job}: {state['status']}")
            time.sleep(self.wait)
        content = send(f"{self.origin}/v1/files/{state[self.rules['output_file_key']]}/content", None, self.service.headers())
        with archive.Sink(spark, f"{self.folder}/_{name}") as out:
            out.write(content)
        (fs, at), (_, whole) = snapshot._fs(spark, f"{self.folder}/_{name}"), snapshot._fs(spark, target)
        fs.mkdirs(whole.getParent())
        if not fs.rename(at, whole):
            raise OSError("the answers couldn't be moved")
