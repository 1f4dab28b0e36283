"""Frozen splits: fingerprints, drift, and a guard on the held-out split."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpora import read_m2


class HeldOutSplitError(RuntimeError):
    """The test split was asked for without saying so."""


class FrozenError(RuntimeError):
    """A corpus that is already frozen would be frozen again."""


@dataclass(frozen=True)
class SplitRecord:
    path: str
    sha256: str
    bytes: int
    sentences: int
    edits: int


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def describe_split(spark: SparkSession, path: str | Path) -> SplitRecord:
    """Counts over all annotators, and the file's fingerprint."""
    row = read_m2(spark, str(path)).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(F.filter("edits", lambda e: e["start"] >= 0))), F.lit(0)).alias("e")).first()
    return SplitRecord(str(path), sha256_file(path), Path(path).stat().st_size, row.n, row.e)


def freeze(manifest: Path, corpus: str, splits: dict[str, SplitRecord]) -> None:
    """Adds a corpus to the manifest; raises if it is there already."""
    held = json.loads(manifest.read_text()) if manifest.exists() else {"corpora": {}}
    if corpus in held["corpora"]:
        raise FrozenError(f"{corpus} is frozen")
    held["corpora"][corpus] = {"frozen_at": datetime.now(UTC).isoformat(timespec="seconds"), "splits": {k: asdict(v) for k, v in splits.items()}}
    manifest.write_text(json.dumps(held, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def drifts(manifest: Path, corpus: str | None = None) -> list[str]:
    """Every split whose file is missing or reads otherwise than when frozen."""
    out = []
    for name, entry in json.loads(manifest.read_text())["corpora"].items():
        if corpus is not None and name != corpus:
            continue
        for split, record in entry["splits"].items():
            if not Path(record["path"]).exists():
                out.append(f"{name}/{split}: missing")
            elif sha256_file(record["path"]) != record["sha256"]:
                out.append(f"{name}/{split}: changed")
    return out


def split_path(manifest: Path, corpus: str, split: str) -> str:
    splits = json.loads(manifest.read_text())["corpora"].get(corpus, {}).get("splits", {})
    if split not in splits:
        raise KeyError(f"no split {split} of {corpus}; known: {', '.join(sorted(splits)) or 'none'}")
    return splits[split]["path"]


def load_split(spark: SparkSession, manifest: Path, corpus: str, split: str, allow_test: bool = False) -> DataFrame:
    """The sentences of a frozen split; ``test`` only when it is asked for by name and flag."""
    if split == "test" and not allow_test:
        raise HeldOutSplitError(f"{corpus}/test is held out")
    return read_m2(spark, split_path(manifest, corpus, split))


def training_split(split: str) -> str:
    """The name, if it may be trained on."""
    if split != "train":
        raise HeldOutSplitError(f"{split} isn't for training")
    return split


def trim_merges(vocab: DataFrame, merges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A trimmed tokenizer: the kept rows of vocab (token, id) with new ids in the order
    of the old, and the merges (ordinal, left, right) whose parts and result all stay."""
    from pyspark.sql import Window

    kept = vocab.join(keep.select("id").distinct(), "id", "left_semi")
    order = Window.partitionBy(F.lit(1)).orderBy("id")
    renumbered = kept.select("token", "id", (F.row_number().over(order) - 1).alias("new_id"))
    names = kept.select("token")
    out = merges.withColumn("whole", F.concat("left", "right"))
    for c in ("left", "right", "whole"):
        out = out.join(names.withColumnRenamed("token", c), c, "left_semi")
    return renumbered, out.select("ordinal", "left", "right")
