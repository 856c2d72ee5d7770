"""Extractors: where text becomes JSON. Deterministic, recorded or injected.

An extractor maps prompts to responses (and is told the temperature, if it asks for one); it runs in the tasks, batch by batch, so
it must be picklable. Responses are not repeatable in general: write them to a
table, or checkpoint them, before anything is derived from them.
"""

from __future__ import annotations

import functools
import importlib
import inspect
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CallError, with_retries


class Extractor(Protocol):
    def __call__(self, prompt: str) -> str: ...


MODAL = re.compile(r"\b(must|shall|should|will|may not|required to)\b", re.IGNORECASE)
TYPE_WORDS = (
    ("data_quality_threshold", r"accuracy|completeness|quality|error rate"), ("update_timeline", r"within \d+|days|hours|deadline"), ("beneficial_ownership_threshold", r"beneficial"),
    ("ownership_category", r"ownership|joint|trust"), ("update_requirement", r"update|change"), ("control_requirement", r"control|monitor|review"), ("documentation_requirement", r""),
)


HEAD = re.compile(r"(?m)^=== CHUNK \[([^\]]+)\][^\n]*===\nLocation: [^\n]*\nHeading: [^\n]*\n\n")


def deterministic(prompt: str) -> str:
    """Sentences of the chunks in a prompt that have a modal verb as requirements, typed by keywords."""
    out = []
    heads = list(HEAD.finditer(prompt))
    for m, end in zip(heads, [*(h.start() for h in heads[1:]), len(prompt)]):
        for line in prompt[m.end() : end].split("\n"):
            for sentence in re.split(r"(?<=[.!?])\s+", line.strip()):
                if MODAL.search(sentence):
                    kind = next(k for k, words in TYPE_WORDS if re.search(words, sentence, re.IGNORECASE))
                    out.append({"rule_type": kind, "rule_description": sentence, "grounded_in": sentence, "confidence": 0.8, "attributes": {}, "source_chunk_id": m[1]})
    return json.dumps(out)


def remote(call: Callable[[str], str], retries: int = 3, base: float = 2.0, max_tokens: int | None = None) -> Extractor:
    """An injected call with retries; it is given the temperature, and max_tokens, if it has parameters of those names."""
    if max_tokens is not None and takes(call, "max_tokens"):
        call = functools.partial(call, max_tokens=max_tokens)
    if takes_temperature(call):
        return lambda prompt, temperature: with_retries(lambda: call(prompt, temperature=temperature), retries, base)
    return lambda prompt: with_retries(lambda: call(prompt), retries, base)


def takes(call: Callable, name: str) -> bool:
    try:
        return name in inspect.signature(call).parameters
    except (TypeError, ValueError):
        return False


def takes_temperature(call: Callable) -> bool:
    return takes(call, "temperature")


def named(place: str | None, retries: int, base: float, max_tokens: int | None = None) -> Extractor | None:
    """The function at ``module:name`` as a remote extractor; none for no place."""
    if not place:
        return None
    module, _, name = place.partition(":")
    try:
        call = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"No extractor {place}: {e}") from e
    return remote(call, retries, base, max_tokens)


def extract(prompts: DataFrame, extractor: Extractor = deterministic, *keys: str) -> DataFrame:
    """(keys, content, error): the response to each prompt, or the class of its failure and no content."""
    warm = takes_temperature(extractor)
    rows = prompts.select(*keys, "prompt", F.col("temperature") if "temperature" in prompts.columns else F.lit(0.0).alias("temperature"))
    names = [*keys, "content", "error"]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content, error = [], []
            for prompt, temperature in zip(pdf["prompt"], pdf["temperature"]):
                try:
                    content.append(extractor(prompt, temperature=temperature) if warm else extractor(prompt))
                    error.append(None)
                except CallError as e:
                    content.append(None)
                    error.append(e.error_type)
            yield pdf[list(keys)].assign(content=content, error=error)[names]

    return rows.mapInPandas(run, f"{kinds}, content string, error string")


def replay(prompts: DataFrame, recorded: DataFrame, *keys: str) -> DataFrame:
    """Recorded responses (keys, content) in place of calls."""
    return prompts.select(*keys).join(recorded, list(keys), "left").withColumn("error", F.when(F.col("content").isNull(), "NOT_RECORDED"))

