"""Generation, rewriting and encoding behind small protocols.

A generator is any class whose instances have ``generate(prompts)``; an encoder
any with ``encode(texts)``.  One instance is made in each Python worker.  The
fakes here stand in for services that a box without network can't reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import cleaning
from quillmark.operators.features import nonempty
from quillmark.operators.ordered import numbered


class EchoGenerator:
    """Gives a prompt back, marked."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [f"[generated] {p}" for p in prompts]


class HashEncoder:
    """Unit vectors of hashed words: a stand-in for an encoder."""

    def __init__(self, width: int = 16) -> None:
        self.width = width

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.width)
            for word in (text or "").split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.width] += 1 if h >> 63 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out


def plan(spark: SparkSession, prompts: DataFrame, n: int, provider: str, start: int = 0) -> DataFrame:
    """(sample_id, prompt): n requests, prompts taken in turn."""
    listed = numbered(prompts.select("prompt"), "prompt", name="i")
    size = listed.agg(F.count("*").alias("k"))
    wanted = spark.range(start, n).crossJoin(F.broadcast(size)).select("id", (F.col("id") % F.col("k")).alias("i"))  # one row
    return wanted.join(listed, "i").select(F.format_string(f"ai_raw_{provider}_%04d", "id").alias("sample_id"), "prompt")


def generated(requests: DataFrame, make: Callable[[], object], batch: int = 1000) -> DataFrame:
    """(sample_id, text): every request through a generator, at most ``batch``
    prompts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make()
        for frame in frames:
            for low in range(0, len(frame), batch):
                part = frame.iloc[low : low + batch]
                yield pd.DataFrame({"sample_id": part["sample_id"], "text": generator.generate(part["prompt"].tolist())})

    return requests.select("sample_id", "prompt").mapInPandas(run, "sample_id string, text string")


def encoded(docs: DataFrame, make: Callable[[int], object], width: int, key: str = "doc_id") -> DataFrame:
    """(key, embedding) of each row's text, a batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make(width)
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "embedding": encoder.encode(frame["text"].tolist())})

    return docs.select(key, "text").mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, embedding array<double>")


def rewritten(samples: DataFrame, make: Callable[[], object], prefix: str, label: str = "ai_humanized", words: int = 80) -> DataFrame:
    """Texts cut into pieces, each rewritten, and joined again; the new row
    names its original."""
    cut = samples.select("sample_id", cleaning.translation_pieces(F.col("text"), words).alias("pieces"))
    pieces = nonempty(cut, "pieces").select("sample_id", F.posexplode("pieces").alias("pos", "piece"))
    asked = pieces.select(F.concat_ws("#", "sample_id", "pos").alias("sample_id"), F.col("piece").alias("prompt"))
    done = generated(asked, make).select(F.split("sample_id", "#").alias("k"), "text").select(F.col("k")[0].alias("original_id"), F.col("k")[1].cast("int").alias("pos"), "text")
    whole = done.groupBy("original_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), " ").alias("text"))
    return whole.select(F.concat(F.lit(prefix), F.col("original_id")).alias("sample_id"), "text", F.lit(label).alias("label"), "original_id")


class RefusesLongBatches(EchoGenerator):
    """Stands for a local model whose memory holds few prompts."""

    def __init__(self, most: int = 8) -> None:
        self.most = most

    def generate(self, prompts: list[str]) -> list[str]:
        if len(prompts) > self.most:
            raise ValueError("too many prompts at once")
        return super().generate(prompts)


#: Services that rewrite a single text, by name, each with its own generator.
REWRITERS: dict[str, Callable[[], object]] = {"gemini": EchoGenerator, "openai": EchoGenerator, "llama": EchoGenerator, "transformers": RefusesLongBatches}
REWRITE_PROMPT = "Rewrite in about {words} words: {text}"


def rewritten_by(samples: DataFrame, service: str, words: int, batch: int = 8) -> DataFrame:
    """(sample_id, original_id, text): whole texts through one service, with a
    length to aim at."""
    if service not in REWRITERS:
        raise ValueError(f"unknown service: {service}")
    before, after = REWRITE_PROMPT.format(words=words, text="\0").split("\0")
    asked = samples.select("sample_id", F.concat(F.lit(before), "text", F.lit(after)).alias("prompt"))
    done = generated(asked, REWRITERS[service], batch)
    return done.select(F.concat(F.lit(f"ai_humanized_{service}_"), "sample_id").alias("sample_id"), F.col("sample_id").alias("original_id"), "text")


def collect(spark: SparkSession, prompts: DataFrame, have: DataFrame, target: int, provider: str, make: Callable[[], object]) -> DataFrame:
    """(sample_id, text): what is there, and the rest of ``target`` requests,
    numbered on from it."""
    start = have.count()
    rest = generated(plan(spark, prompts, target, provider, start), make) if start < target else have.limit(0)
    return have.select("sample_id", "text").unionByName(rest.select("sample_id", "text"))
