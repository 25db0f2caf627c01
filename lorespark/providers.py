"""Model providers: chat and embedding calls behind small interfaces.

``lorespark.http_chat`` has a client for real services and a registry of others;
the offline stand-ins here answer deterministically. A call never raises into a query: its
result says whether it succeeded and why not, so an error text is never taken
for an answer.
"""

from __future__ import annotations

import hashlib
import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DELIMITER = "#####"
# Providers, their default models and where their keys are found.
PROVIDERS = {
    "openai": {"default_model": "gpt-4o-mini", "base_url": "https://api.openai.com/v1", "api_key_env": "OPENAI_API_KEY"},
    "qwen": {"default_model": "qwen-plus", "base_url": "https://dashscope.aliyuncs.com/compatible-mode/v1", "api_key_env": "DASHSCOPE_API_KEY"},
}
PREFIXES = {"gpt-": "openai", "claude-": "openai", "qwen": "qwen"}
DEFAULT_PROVIDER = "openai"
EMBED_MODEL = "text-embedding-3-large"
RESULT = "struct<ok: boolean, text: string, tokens: bigint, error: string>"


def provider_of(model: Column) -> Column:
    """Provider by the model's name; any other name is the default's."""
    found = F
    for prefix, provider in PREFIXES.items():
        found = found.when(model.startswith(prefix), provider)
    return found.otherwise(DEFAULT_PROVIDER)


def provider_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, *config.values()) for name, config in PROVIDERS.items()], "provider string, default_model string, base_url string, api_key_env string")


def route(requests: DataFrame, model: str = "model") -> DataFrame:
    """``requests`` with the provider and settings of their model; the providers are a small fixed table."""
    return requests.withColumn("provider", provider_of(F.coalesce(F.col(model), F.lit("")))).join(F.broadcast(provider_table(requests.sparkSession)), "provider", "left").select(*requests.columns, "provider", "default_model", "base_url", "api_key_env")


def endpoint(provider: str, api_key: str | None = None, base_url: str | None = None) -> tuple[str | None, str]:
    """(key, address): arguments first, then the environment, then the fixed values."""
    config = PROVIDERS.get(provider, PROVIDERS[DEFAULT_PROVIDER])
    return api_key or os.environ.get(config["api_key_env"]), base_url or os.environ.get(f"{provider.upper()}_API_BASE") or config["base_url"]


@dataclass(frozen=True)
class Answer:
    ok: bool
    text: str | None
    tokens: int
    error: str | None = None


class Chat(Protocol):
    def __call__(self, messages: list[dict[str, str]], model: str, max_tokens: int, temperature: float) -> Answer: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class EchoChat:
    """Offline: answers with the first words of what it was asked; tokens are words in and out."""

    def __call__(self, messages, model="gpt-4o-mini", max_tokens=1280, temperature=0.5) -> Answer:
        words = messages[-1]["content"].replace(DELIMITER, "").split()
        out = words[:max_tokens]
        return Answer(True, " ".join(out), sum(len(m["content"].split()) for m in messages) + len(out))


class HashEmbedder:
    """Offline: a unit vector of signed hashed words; where they cancel out, that of the first word. Without words it is zero.

    A word's place and sign are kept, up to ``KNOWN`` words. With ``ascii`` only ASCII letters, digits and _ make words.
    """

    KNOWN = 200_000

    def __init__(self, size: int = 64, ascii: bool = False):
        self.size, self.ascii, self.known = size, ascii, {}
        self.words = re.compile(r"\w+", re.ASCII if ascii else 0)

    def _places(self, words: list[str]) -> np.ndarray:
        """Each word's component, those of negative sign after all others."""
        if len(self.known) > self.KNOWN:
            self.known.clear()
        for word in set(words).difference(self.known):
            h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
            self.known[word] = h % self.size + (0 if h >> 63 else self.size)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            # words are found before letters are lowered, which may turn others into ASCII ones
            words = [w.lower() for w in self.words.findall(text)] if self.ascii else self.words.findall(text.lower())
            for counted in (words, words[:1]):
                found = np.bincount(self._places(counted), minlength=2 * self.size)
                row[:] = found[: self.size] - found[self.size :]
                if row.any():
                    break
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).astype(np.float32).tolist()


def messages(system: Column | str, prompt: Column) -> Column:
    """System and delimited user message."""
    role = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(role("system", system if isinstance(system, Column) else F.lit(system)), role("user", F.concat(F.lit(DELIMITER), prompt, F.lit(DELIMITER))))


def call(chat: Chat, asked: list[dict[str, str]] | None, model: str, max_tokens: int, temperature: float) -> Answer:
    if not asked:
        return Answer(False, None, 0, "nothing was asked")
    try:
        return chat(asked, model, max_tokens, temperature)
    except Exception as e:  # noqa: BLE001 - a failed call is a result
        return Answer(False, None, 0, f"{type(e).__name__}: {e}")


def ask(rows: DataFrame, asked: str, make: Callable[[], Chat] = EchoChat, model: str = "gpt-4o-mini", max_tokens: int = 1280, temperature: float = 0.5) -> DataFrame:
    """``rows`` with ``answer`` (ok, text, tokens, error) and ``seconds`` to the messages in column ``asked``.

    One client per task. Calls may be repeated when a task is retried, so write
    the result before using it more than once.
    """
    columns = rows.columns
    at = columns.index(asked)

    def answered(batches):
        chat = make()
        for batch in batches:
            answers, seconds = [], []
            for one in batch.column(at).to_pylist():
                began = time.monotonic()
                a = call(chat, one, model, max_tokens, temperature)
                answers.append({"ok": a.ok, "text": a.text, "tokens": a.tokens, "error": a.error})
                seconds.append(time.monotonic() - began)
            kind = pa.struct([("ok", pa.bool_()), ("text", pa.string()), ("tokens", pa.int64()), ("error", pa.string())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, kind), pa.array(seconds, pa.float64())], [*columns, "answer", "seconds"])

    return rows.mapInArrow(answered, StructType([*rows.schema.fields, *StructType.fromDDL(f"answer {RESULT}, seconds double").fields]))


def embed(rows: DataFrame, text: str, make: Callable[[], Embedder] = HashEmbedder, batch: int = 256) -> DataFrame:
    """``rows`` with ``vector``; null where the text is null or the call failed."""
    columns = rows.columns
    at = columns.index(text)

    def embedded(batches):
        model = make()
        for arrow in batches:
            vectors: list[list[float] | None] = []
            texts = arrow.column(at).to_pylist()
            for lo in range(0, len(texts), batch):
                part = texts[lo : lo + batch]
                try:
                    found = iter(model([t for t in part if t is not None]))
                    vectors += [None if t is None else next(found) for t in part]
                except Exception:  # noqa: BLE001 - a failed call gives no vectors
                    vectors += [None] * len(part)
            yield pa.RecordBatch.from_arrays([*arrow.columns, pa.array(vectors, pa.list_(pa.float32()))], [*columns, "vector"])

    return rows.mapInArrow(embedded, StructType([*rows.schema.fields, *StructType.fromDDL("vector array<float>").fields]))
