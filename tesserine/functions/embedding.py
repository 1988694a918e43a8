"""Embedding providers by name. Remote ones take a client and run it batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import projection
from .hypervector import BITS
from .text import encoder


class Provider(Protocol):
    """``embed`` adds ``embedding`` to rows with a text; ``project`` makes bits of it."""

    def embed(self, rows: DataFrame, text: str) -> DataFrame: ...

    def project(self, embedding: Column) -> Column: ...


class HdcText:
    """The text encoder as floats 0 and 1, and back by a threshold of one half."""

    def embed(self, rows: DataFrame, text: str) -> DataFrame:
        bit = lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", w, i).bitwiseAND(F.lit(1).cast("long")).cast("float"))
        return rows.withColumn("_v", encoder()(F.col(text))).withColumn("embedding", F.flatten(F.transform("_v", bit))).drop("_v")

    def project(self, embedding: Column) -> Column:
        on = F.transform(embedding, lambda v, i: F.when(v > 0.5, F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
        return F.transform(F.sequence(F.lit(0), F.lit(BITS - 64), F.lit(64)), lambda s: F.aggregate(F.slice(on, s + 1, F.lit(64)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


class Client:
    """Any function from texts to vectors of ``width`` floats, such as a remote service or a local model."""

    def __init__(self, call: Callable[[list[str]], list[list[float]]], width: int, batch: int = 64) -> None:
        self.call, self.width, self.batch = call, projection.validate_input_dim(width), batch

    def embed(self, rows: DataFrame, text: str) -> DataFrame:
        call, step = self.call, self.batch
        packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(text).alias("text"), F.array().cast("array<float>").alias("embedding"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t or "" for t in b.column(1).to_pylist()]
                made = [v for at in range(0, len(texts), step) for v in call(texts[at : at + step])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.asarray(v, np.float32) for v in made], pa.list_(pa.float32()))], ["row", "text", "embedding"])

        return packed.mapInArrow(run, packed.schema).select("row.*", "embedding")

    def project(self, embedding: Column) -> Column:
        return projection.random_projection(self.width)(embedding)


def http_call(url: str, key: str, model: str, timeout: float = 30.0) -> Callable[[list[str]], list[list[float]]]:
    """A client of a remote service that takes ``{"model", "input": [..]}`` and gives ``{"data": [{"index", "embedding"}]}``."""

    def call(texts: list[str]) -> list[list[float]]:
        import json
        from urllib.request import Request, urlopen

        body = json.dumps({"model": model, "input": texts}).encode()
        with urlopen(Request(url, body, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}), timeout=timeout) as reply:
            data = json.load(reply)["data"]
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]

    return call


def onnx_call(model: str, tokenizer: str, most: int = 512) -> Callable[[list[str]], list[list[float]]]:
    """A client of a local ONNX encoder: the mean of its last states over each text's tokens, of length one.

    Files are opened where the client runs, once in each worker.
    """
    held: dict[str, tuple] = {}

    def call(texts: list[str]) -> list[list[float]]:
        if "open" not in held:
            import onnxruntime
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(tokenizer)
            own.enable_padding()
            own.enable_truncation(most)
            held["open"] = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"]), own
        session, own = held["open"]
        coded = own.encode_batch(texts)
        given = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": np.array([c.attention_mask for c in coded], np.int64), "token_type_ids": np.array([c.type_ids for c in coded], np.int64)}
        states = session.run(None, {i.name: given[i.name] for i in session.get_inputs()})[0]
        mask = given["attention_mask"][:, :, None]
        mean = (states * mask).sum(axis=1) / np.maximum(1, mask.sum(axis=1))
        return (mean / np.maximum(1e-12, np.linalg.norm(mean, axis=1, keepdims=True))).tolist()

    return call


def get_provider(name: str, call: Callable[[list[str]], list[list[float]]] | None = None, width: int = 384) -> Provider:
    """``hdc-text``, or ``fastembed[:model]``, ``openai`` and ``voyage`` with the client that runs them: one of
    :func:`http_call` or :func:`onnx_call`, or any other."""
    kind = name.partition(":")[0]
    if kind in ("hdc-text", "hdc"):
        return HdcText()
    if kind in ("fastembed", "openai", "voyage"):
        if call is None:
            raise ValueError(f"{name} needs a client")
        return Client(call, width)
    raise ValueError(f"unknown provider {name}")
