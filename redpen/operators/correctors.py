"""Correctors as a plug: whatever maps a frame of (sid, text) to one with the text corrected."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import answer_text, build_prompt, parse_completion, worked_examples
from . import checker, encoding, reports
from .training import apply_matches, parse_answer


class Corrector(Protocol):
    """A corrector of whole frames: rows keep their sid, each comes back once."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


def identity(rows: DataFrame) -> DataFrame:
    """Nothing is corrected: the floor of every comparison."""
    return rows.select("sid", "text")


def batched(generate: Callable[[list[str]], list[str]], rows: DataFrame, column: str, batch: int = 64) -> DataFrame:
    """``rows`` with ``completion``: what ``generate`` gives for the prompts in ``column``, a
    batch at a time; it runs on executors and must give as many texts as it gets."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            prompts, out = part[column].tolist(), []
            for i in range(0, len(prompts), batch):
                got = generate(prompts[i : i + batch])
                if len(got) != len(prompts[i : i + batch]):
                    raise ValueError("the generator gave another number of texts than it got")
                out += got
            yield part.assign(completion=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, completion string")


class Prompted:
    """A model with worked examples in its prompt; it answers with the sentence alone."""

    def __init__(self, generate: Callable[[list[str]], list[str]], shots: list[tuple[str, str]], language: str = "de"):
        self.generate, self.shots, self.language = generate, shots, language

    def __call__(self, rows: DataFrame) -> DataFrame:
        asked = rows.select("sid", "text", build_prompt(F.col("text"), self.language, worked_examples(self.shots)).alias("prompt"))
        return batched(self.generate, asked, "prompt").select("sid", parse_completion(F.col("completion"), F.col("text")).alias("text"))


class FineTuned:
    """A model that answers in JSON, applied to its own output until a row stops changing.
    An answer without a correction leaves the row as it is."""

    def __init__(self, generate: Callable[[list[str]], list[str]], language: str = "de", rounds: int = 1, write: Callable[[DataFrame], DataFrame] = lambda d: d):
        self.generate, self.language, self.rounds, self.write = generate, language, rounds, write

    def answers(self, rows: DataFrame) -> DataFrame:
        """(sid, source, answer) of one round."""
        asked = rows.select("sid", F.col("text").alias("source"), build_prompt(F.col("text"), self.language).alias("prompt"))
        return batched(self.generate, asked, "prompt").select("sid", "source", parse_answer(F.col("completion")).alias("answer"))

    def faults(self, rows: DataFrame) -> DataFrame:
        return reports.generation_faults(self.answers(rows))

    def __call__(self, rows: DataFrame) -> DataFrame:
        once = lambda d: self.answers(d).select("sid", answer_text(F.col("answer"), F.col("source")).alias("text"))
        return encoding.iterate(rows, once, self.rounds, self.write).select("sid", "text")


class RuleChecker:
    """A rule checker's first replacements put into each text."""

    def __init__(self, fetch: Callable[[list[str]], list[str]], cache: DataFrame, version: str, language: str):
        self.fetch, self.cache, self.version, self.language = fetch, cache, version, language

    def __call__(self, rows: DataFrame) -> DataFrame:
        found, _ = checker.checked(rows.select("sid", "text"), self.cache, self.fetch, self.version, self.language)
        matches = F.transform(checker.from_response(F.col("matches")), lambda m: F.struct(m["offset"].alias("offset"), m["length"].alias("length"), checker.best_replacement(m).alias("replacement")))
        return found.select("sid", F.coalesce(apply_matches(F.col("text"), matches), F.col("text")).alias("text"))


SYSTEMS: dict[str, Callable[..., Corrector]] = {"identity": lambda: identity, "prompted": Prompted, "finetuned": FineTuned, "checker": RuleChecker}


def build(name: str, *args, **options) -> Corrector:
    """A corrector by its system's name."""
    if name not in SYSTEMS:
        raise KeyError(f"no system {name}; known: {', '.join(sorted(SYSTEMS))}")
    return SYSTEMS[name](*args, **options)
