"""Prompts and what comes back: all column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The instructions and labels that models are trained on.
INSTRUCTION = {"de": "Correct the German sentence, then list what changed.", "es": "Correct the Spanish sentence, then list what changed."}
DAMAGE = "Rewrite the German sentence as a learner would, making "
SOURCE, TARGET = "Input:", "Output:"
#: What closes the correction in an answer.
MARKER = ', "changes":'


def _framed(head: Column, text: Column, middle: str = "") -> Column:
    return F.concat(head, F.lit(f"\n\n{middle}{SOURCE} "), text, F.lit(f"\n{TARGET}"))


def build_prompt(source: Column, language: str = "de", examples: str = "") -> Column:
    """What a corrector is given: the instruction, worked examples if any, the sentence."""
    return _framed(F.lit(INSTRUCTION[language]), source, examples)


def worked_examples(pairs: list[tuple[str, str]]) -> str:
    """Examples as they stand between the instruction and the sentence."""
    return "".join(f"{SOURCE} {a}\n{TARGET} {b}\n\n" for a, b in pairs)


def preamble(language: str, pairs: list[tuple[str, str]]) -> str:
    """The fixed head of a few-shot prompt."""
    return f"{INSTRUCTION[language]}\n\n{worked_examples(pairs)}"


def count_phrase(count: Column) -> Column:
    return F.when(count == 0, "no mistakes").when(count == 1, "1 mistake").otherwise(F.concat(count.cast("string"), F.lit(" mistakes")))


def damage_prompt(correct: Column, count: Column) -> Column:
    """What an error generator is given: a correct sentence and how many errors to make."""
    return _framed(F.concat(F.lit(DAMAGE), count_phrase(count), F.lit(".")), correct)


def parse_completion(completion: Column, source: Column) -> Column:
    """The first line of a completion without an echoed label; the source if nothing is left."""
    line = F.split_part(F.trim(completion), F.lit("\n"), F.lit(1))
    text = F.trim(F.regexp_replace(line, f"^{TARGET}", ""))
    return F.coalesce(F.nullif(text, F.lit("")), source)


def answer_text(answer: Column, source: Column) -> Column:
    """The correction of a parsed answer; the source where there is none, or an empty one."""
    return F.coalesce(F.nullif(F.trim(answer["correction"]), F.lit("")), source)
