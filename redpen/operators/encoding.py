"""Training features: token ids with a loss mask and weights, padded in batches."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prompts import MARKER

#: The label of tokens that aren't learned.
MASKED = -100


def encode(prompt_ids: Sequence[int], answer_ids: Sequence[int], offsets: Sequence[tuple[int, int]], end_id: int, changed_from: int | None, weight: float, longest: int) -> tuple[list[int], list[int], list[float]] | None:
    """(ids, labels, weights) of prompt and answer; None if they are longer than ``longest``.

    The prompt is masked with weight 0. Answer tokens that end after the character
    ``changed_from`` (where the list of changes begins) weigh ``weight``, the others and the
    end 1; give (start, start + 1) for tokens that count by where they begin."""
    ids = [*prompt_ids, *answer_ids, end_id]
    if len(ids) > longest:
        return None
    late = [changed_from is not None and stop > changed_from for _, stop in offsets]
    labels = [MASKED] * len(prompt_ids) + [*answer_ids, end_id]
    return ids, labels, [0.0] * len(prompt_ids) + [weight if x else 1.0 for x in late] + [1.0]


#: Records that are encoded at once; an encoding holds far more than its ids.
_ROWS = 256

ENCODED = "ids array<int>, labels array<int>, weights array<double>"


def encoded_records(rows: DataFrame, tokenizer_path: str, end_id: int, weight: float = 1.0, longest: int = 1024, id_col: str = "sid") -> DataFrame:
    """Rows (id, ids, labels, weights) of records with ``prompt`` and ``answer`` text, by a
    file of the tokenizers library; records longer than ``longest`` tokens go. Tokens of an
    answer that begin at its changes' marker or behind weigh ``weight``; an answer without
    the marker weighs 1 throughout."""
    made = T.StructType([rows.schema[id_col], *T.StructType.fromDDL(ENCODED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tokenizers

        # a task has its core; the library's threads would take those of others
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held = tokenizers.Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = part["answer"].to_pylist()
                # where a prompt's tokens begin doesn't count
                prompts = held.encode_batch_fast(part["prompt"].to_pylist())
                answers = held.encode_batch(texts, add_special_tokens=False)
                kept, ids, labels, weights = [], [], [], []
                for k, (text, p, a) in enumerate(zip(texts, prompts, answers, strict=True)):
                    first, size = len(p), len(a)
                    if first + size + 1 > longest:
                        continue
                    kept.append(k)
                    own = np.array([*p.ids, *a.ids, end_id], np.int32)
                    late = _late(a, text.find(MARKER))
                    ids.append(own)
                    labels.append(np.concatenate([np.full(first, MASKED, np.int32), own[first:]]))
                    weights.append(np.concatenate([np.zeros(first), np.ones(late), np.full(size - late, weight), [1.0]]))
                ends = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
                flat = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x) if x else [], kind))
                columns = [part[id_col].take(pa.array(kept, pa.int64())), flat(ids, pa.int32()), flat(labels, pa.int32()), flat(weights, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=made.names)

    return rows.select(id_col, "prompt", "answer").mapInArrow(run, made)


def _late(encoded, split: int) -> int:
    """The number of an encoded text's tokens before those that begin at the character
    ``split`` or behind; all of them if it is negative."""
    if split < 0:
        return len(encoded)
    at = encoded.char_to_token(split)
    if at is None:
        return sum(s < split for s, _ in encoded.offsets)
    return at if encoded.token_to_chars(at)[0] >= split else at + 1


def split_sizes(rows: DataFrame, validation: int) -> int:
    """How many rows to hold out: ``validation``, a tenth at most, one at least."""
    return min(validation, max(rows.count() // 10, 1))


def weighted_mean_loss(rows: DataFrame, loss: str, weight: str) -> DataFrame:
    """The sum of weighted losses over the sum of weights, or over 1e-8."""
    return rows.agg((F.sum(F.col(loss) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-8))).alias("loss"))


def collate(rows: DataFrame, batch: str, pad_id: int) -> DataFrame:
    """Ids, labels and weights padded on the right to the longest row of the batch. The
    longest is a partial maximum joined back."""
    longest = rows.groupBy(batch).agg(F.max(F.size("ids")).alias("longest"))

    def fill(name: str, value: Column) -> Column:
        return F.concat(name, F.array_repeat(value, F.col("longest") - F.size(name))).alias(name)

    others = [c for c in rows.columns if c not in ("ids", "labels", "weights")]
    return rows.join(longest, batch).select(*others, fill("ids", F.lit(pad_id)), fill("labels", F.lit(MASKED)), fill("weights", F.lit(0.0)))


def iterate(rows: DataFrame, correct, rounds: int, write) -> DataFrame:
    """A corrector applied to its own output until a row stops changing, for ``rounds`` at
    most. Rows are (sid, text); ``correct`` maps a frame to one, ``write`` cuts lineage (a
    table in a shared folder). Rows: sid, text, rounds, the number of rewrites."""
    active = rows.select("sid", F.col("text"), F.lit(0).alias("rounds"))
    settled = None
    for _ in range(rounds):
        after = correct(active.select("sid", "text")).withColumnRenamed("text", "now")
        step = write(active.join(after, "sid").withColumn("changed", F.col("now") != F.col("text")))
        done = step.where(~F.col("changed")).select("sid", "text", "rounds")
        settled = done if settled is None else settled.unionByName(done)
        active = step.where("changed").select("sid", F.col("now").alias("text"), (F.col("rounds") + 1).alias("rounds"))
    return active if settled is None else settled.unionByName(active)
