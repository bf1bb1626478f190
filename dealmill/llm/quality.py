"""A quality classifier: a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks of bytes that cover it whole. Bytes become short vectors, filters slide over
them, and each filter keeps its largest answer in a chunk. A small hidden layer turns these answers into the evidence
of a chunk; the strongest and the mean evidence of all chunks of a text make one probability. Chunks overlap by more
than a filter's width, so every stretch of bytes is seen whole by every filter. Filters, byte vectors and layers are
learned from labelled texts by gradient descent; the gradient of a largest answer goes to the place that gave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from dealmill.llm.common import in_slices, materialize, scratch
from dealmill.llm.toxicity import held_out_fold

#: The byte after the last: what fills the end of a text's last chunk.
PAD = 256


@dataclass(frozen=True)
class QualityParams:
    #: Labelled rows that are fitted on, and chunks of each, evenly spaced over the whole text, at most.
    sample: int = 4_000
    sample_chunks: int = 48
    rounds: int = 10
    rate: float = 0.004
    batch: int = 64
    #: Bytes of a chunk and of a step from one chunk to the next; a filter's width and its stride in bytes.
    chunk: int = 256
    width: int = 16
    stride: int = 4
    embedding: int = 8
    filters: int = 32
    hidden: int = 32
    seed: int = 17

    @property
    def step(self) -> int:
        return self.chunk - self.width


def chunks_of(text: bytes, p: QualityParams) -> np.ndarray:
    """The chunks of a text, one a row; the last one is padded. An empty text has one chunk of padding."""
    n = max(1, -(-(len(text) - p.width) // p.step))
    flat = np.full((n - 1) * p.step + p.chunk, PAD, np.int16)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, p.chunk)[:: p.step]


def _glorot(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)


@dataclass
class QualityModel:
    params: QualityParams = field(default_factory=QualityParams)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.weights:
            p, rng = self.params, np.random.default_rng(self.params.seed)
            self.weights = {
                "bytes": rng.standard_normal((PAD + 1, p.embedding)).astype(np.float32) * 0.5,
                "filters": _glorot(rng, p.width * p.embedding, p.filters), "filter_bias": np.zeros(p.filters, np.float32),
                "hidden": _glorot(rng, p.filters, p.hidden), "hidden_bias": np.zeros(p.hidden, np.float32),
                "evidence": _glorot(rng, p.hidden, 1)[:, 0], "evidence_bias": np.zeros(1, np.float32),
                "pool": np.array([1.0, 1.0], np.float32), "bias": np.zeros(1, np.float32),
            }

    def pooled(self, chunks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest answer in each chunk and, if asked, the byte where it begins."""
        p, w = self.params, self.weights
        vectors, best, where = w["bytes"][chunks], None, None
        for shift in range(0, p.width, p.stride):  # windows side by side, then all of them moved by a stride
            n = (p.chunk - shift) // p.width
            answers = (vectors[:, shift : shift + n * p.width].reshape(len(chunks) * n, -1) @ w["filters"]).reshape(len(chunks), n, -1)
            top = answers.max(1)
            if places:
                at = answers.argmax(1) * p.width + shift
                where = at if best is None else np.where(top > best, at, where)
            best = top if best is None else np.maximum(best, top)
        return best + w["filter_bias"], where

    def evidence(self, pooled: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(np.maximum(pooled, 0) @ w["hidden"] + w["hidden_bias"], 0) @ w["evidence"] + w["evidence_bias"]

    def probabilities(self, texts: list[bytes], chunks_at_once: int = 512) -> np.ndarray:
        """One probability for each text. Memory depends on the longest text's bytes, not on its chunks' vectors."""
        cut = [chunks_of(t, self.params) for t in texts]
        sizes = np.array([len(c) for c in cut], np.int64)
        z, waiting, held = [], [], 0
        for c in cut:
            for lo in range(0, len(c), chunks_at_once):
                waiting.append(c[lo : lo + chunks_at_once])
                held += len(waiting[-1])
                if held >= chunks_at_once:
                    z.append(self.evidence(self.pooled(np.concatenate(waiting))[0]))
                    waiting, held = [], 0
        if waiting:
            z.append(self.evidence(self.pooled(np.concatenate(waiting))[0]))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        z = np.concatenate(z).astype(np.float64)
        a, b = self.weights["pool"].astype(np.float64)
        logit = a * np.maximum.reduceat(z, starts) + b * np.add.reduceat(z, starts) / sizes + float(self.weights["bias"][0])
        return 1 / (1 + np.exp(np.clip(logit, -500, 500)))  # evidence speaks against a text

    def gradients(self, chunks: list[np.ndarray], good: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean log loss of texts, given by their chunks, and its gradient."""
        p, w = self.params, self.weights
        sizes, every = np.array([len(c) for c in chunks]), np.concatenate(chunks)
        starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(sizes)), sizes)
        m, where = self.pooled(every, places=True)
        r = np.maximum(m, 0)
        h = np.maximum(r @ w["hidden"] + w["hidden_bias"], 0)
        z = h @ w["evidence"] + w["evidence_bias"]
        top = np.array([s + z[s : s + n].argmax() for s, n in zip(starts, sizes, strict=True)])
        mean = np.add.reduceat(z, starts) / sizes
        bad = 1 / (1 + np.exp(-np.clip(w["pool"][0] * z[top] + w["pool"][1] * mean + w["bias"][0], -30, 30)))
        loss = -np.mean(np.log(np.where(good > 0, 1 - bad, bad) + 1e-9))
        d = ((bad - (1 - good)) / len(good)).astype(np.float32)
        out = {"pool": np.array([d @ z[top], d @ mean], np.float32), "bias": np.array([d.sum()], np.float32)}
        dz = (w["pool"][1] * d / sizes)[owner].astype(np.float32)
        dz[top] += w["pool"][0] * d
        out["evidence"], out["evidence_bias"] = h.T @ dz, np.array([dz.sum()], np.float32)
        dh = np.where(h > 0, dz[:, None] * w["evidence"], 0)
        out["hidden"], out["hidden_bias"] = r.T @ dh, dh.sum(0)
        dm = np.where(m > 0, dh @ w["hidden"].T, 0)
        out["filter_bias"] = dm.sum(0)
        # only the window that gave a filter's largest answer moves: bytes of (chunk, filter) windows
        c, f = np.nonzero(dm)
        window = every[c[:, None], where[c, f][:, None] + np.arange(p.width)]
        seen = w["bytes"][window].reshape(len(c), -1)
        out["filters"] = np.stack([dm[c[f == k], k] @ seen[f == k] for k in range(p.filters)], 1)
        out["bytes"] = np.zeros_like(w["bytes"])
        back = (dm[c, f][:, None] * w["filters"].T[f]).reshape(-1, p.embedding)
        for e in range(p.embedding):
            out["bytes"][:, e] = np.bincount(window.ravel(), back[:, e], PAD + 1)
        return float(loss), out

    def fit(self, chunks: list[np.ndarray], good: np.ndarray) -> None:
        """Adam over shuffled batches, with a rate that falls to 0."""
        p, rng = self.params, np.random.default_rng(self.params.seed)
        m, v, t = {k: 0.0 for k in self.weights}, {k: 0.0 for k in self.weights}, 0
        steps = p.rounds * -(-len(chunks) // p.batch)
        for _ in range(p.rounds):
            order = rng.permutation(len(chunks))
            for lo in range(0, len(order), p.batch):
                own = order[lo : lo + p.batch]
                _, g = self.gradients([chunks[i] for i in own], good[own])
                t += 1
                for k in self.weights:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
                    step = m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
                    self.weights[k] = (self.weights[k] - p.rate * (1 - (t - 1) / steps) * step).astype(np.float32)


def _sampled(p: QualityParams):
    """Whole labelled texts to the chunks they are learned from: all, or evenly spaced ones of a long text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                c = chunks_of((text or "").encode(errors="replace"), p)
                out.append(c[np.unique(np.linspace(0, len(c) - 1, min(len(c), p.sample_chunks)).astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()), batch.column("good")], ["doc_id", "chunks", "good"])

    return run


def fit_quality(documents: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> QualityModel:
    """Fits on at most ``sample`` labelled documents, drawn by a digest of doc_id; only they reach the driver.

    ``labels`` has doc_id and quality (0/1) of the rows that may be learned from. Null labels and ids are left out; of
    repeated labels the largest counts, of repeated documents one; null texts are empty. Without rows of both labels
    every text gets the share of label 1, or one half.
    """
    p = params or QualityParams()
    drawn = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])
    rows = materialize(texts.mapInArrow(_sampled(p), f"doc_id {dict(texts.dtypes)['doc_id']}, chunks binary, good int"), "quality-sample")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("chunks", "good").toArrow().to_pydict()
    model, good = QualityModel(p), np.array([g > 0 for g in rows["good"]], np.float32)
    if not len(good) or good.min() == good.max():
        share = float(good.mean()) if len(good) else 0.5
        model.weights["pool"] = np.zeros(2, np.float32)
        model.weights["bias"] = np.array([np.log((1 - share + 1e-3) / (share + 1e-3))], np.float32)
        return model
    model.fit([np.frombuffer(c, np.int16).reshape(-1, p.chunk) for c in rows["chunks"]], good)
    return model


def score_quality(documents: DataFrame, model: QualityModel, threshold: float = 0.3, at_once: int = 1 << 20) -> DataFrame:
    """The documents, whole texts scored, with columns ``score`` (0 to 1) and ``predicted`` (score >= threshold) set last.

    Null and empty texts score alike, as a chunk of padding. Every row keeps its other columns; columns of the input
    named like the two are replaced. Repeated rows score each and alike; an empty table gives no rows.
    """
    kept = [c for c in documents.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            scores, waiting, held = [], [], 0
            for text in batch.column("text").to_pylist():
                waiting.append((text or "").encode(errors="replace"))
                held += len(waiting[-1])
                if held >= at_once:
                    scores.append(model.probabilities(waiting))
                    waiting, held = [], 0
            if waiting:
                scores.append(model.probabilities(waiting))
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    source = documents.select(*[F.col(f"`{c}`") for c in kept])
    return source.mapInArrow(run, StructType([*source.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType()))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    with scratch(spark):
        model = fit_quality(docs, labels.where(~held_out_fold()))
    return score_quality(docs, model).select("doc_id", held_out_fold().alias("held_out"), "score", "predicted")
