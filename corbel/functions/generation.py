"""Generators: anything with generate(list of prompts) -> list of answers."""

import json
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EngineError
from .http import post


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class EchoGenerator:
    """The prompt's last line, for tests."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.rstrip().rsplit("\n", 1)[-1] for p in prompts]


class HttpGenerator:
    """A chat service: {"model", "messages"} to {"choices": [{"message": {"content"}}]}, {"message"} or {"response"}."""

    def __init__(self, url: str, model: str, key: str | None = None, timeout: float = 120):
        self.url, self.model, self.key, self.timeout = url, model, key, timeout

    def generate(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        said = json.loads(post(self.url, {"model": self.model, "stream": False, "messages": [{"role": "user", "content": prompt}]}, self.key, self.timeout))
        if said.get("choices"):
            return said["choices"][0]["message"]["content"]
        if "message" in said:
            return said["message"]["content"]
        if "response" in said:
            return said["response"]
        raise EngineError("the service gave no answer")


def answers(prompts: DataFrame, generator: Generator) -> DataFrame:
    """prompts (query_id, prompt) with `answer`, asked for in Arrow batches on the executors."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(generator.generate(s.tolist()), dtype=object)

    return prompts.withColumn("answer", run("prompt"))
