"""Training in rounds over all labelled rows: tasks learn from one state, and their steps are averaged.

A round deals the rows to tasks of bounded size.  Each task starts from the same numbers (the state, a flat
array whose size the data doesn't change) and learns from its own rows; a number's next value is the
mean of the steps of those tasks that moved it.  Steps are added in the order of the parts, so the result
doesn't depend on the tasks' timing.  Only the state comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, written

TASK_ROWS, TASK_BYTES = 8_192, 48 << 20
ROUNDS = 3
CHUNK = 1 << 12
#: steps in which logits are counted for calibration
FINE, MOST = 256, 64

Learn = Callable[[np.ndarray, Iterator[pa.RecordBatch]], np.ndarray]


def divided(rows: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, int], int]:
    """(training rows, rows for calibration, rows of each label, parts) of ``rows`` (doc_id, text, lang, label, h).

    A fifth, told by ``h``, is for calibration alone; all rows serve both ends where either side would lack a label.
    """
    rows = written(rows, "labelled").withColumn("held", F.expr("(h & 65535) % 5 = 0"))
    sizes = {(r.label, r.held): (r.n, r.bytes) for r in rows.groupBy("label", "held").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    apart = all((y, held) in sizes for y in (0, 1) for held in (True, False))
    counts = {y: sum(n for (label, _), (n, _) in sizes.items() if label == y) for y in (0, 1)}
    train, check = (rows.where("not held"), rows.where("held")) if apart else (rows, rows)
    n, size = (sum(v[k] for (_, held), v in sizes.items() if not (apart and held)) for k in (0, 1))
    return train.drop("held"), check.drop("held"), counts, max(1, -(-n // TASK_ROWS), -(-size // TASK_BYTES))


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        part = batch.column("part").to_numpy()
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]):
            if a < b:
                yield int(part[a]), batch.slice(a, b - a)


def averaged(rows: DataFrame, parts: int, state: np.ndarray, learn: Learn) -> np.ndarray:
    """The state after one round of ``learn`` in each of ``parts`` parts of the rows."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in groupby(_parted(batches), key=lambda x: x[0]):
            step = learn(state.copy(), (batch for _, batch in own)) - state
            for k in range(0, len(step), CHUNK):
                if step[k : k + CHUNK].any():
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": pa.array([k // CHUNK], pa.int32()), "step": pa.array([step[k : k + CHUNK].tobytes()], pa.binary())})

    def mean(chunk: int, total: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "step": pa.array([(total / np.maximum(moved, 1)).astype(np.float32).tobytes()], pa.binary())})

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, moved = None, np.zeros(0), np.zeros(0)
        for batch in batches:
            for chunk, step in zip(batch.column("chunk").to_pylist(), batch.column("step").to_pylist(), strict=True):
                values = np.frombuffer(step, np.float32)
                if chunk != last:
                    if last is not None:
                        yield mean(last, total, moved)
                    last, total, moved = chunk, np.zeros(len(values)), np.zeros(len(values))
                total += values
                moved += values != 0
        if last is not None:
            yield mean(last, total, moved)

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "label", "h", "doc_id")
    moved = dealt.mapInArrow(steps, "part int, chunk int, step binary")
    found = moved.repartition(max(1, min(parts, 32)), "chunk").sortWithinPartitions("chunk", "part").mapInArrow(means, "chunk int, step binary").collect()
    out = state.copy()
    for r in found:
        step = np.frombuffer(r.step, np.float32)
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(step)] += step
    release(rows.sparkSession)
    return out


def trained(rows: DataFrame, parts: int, state: np.ndarray, learner: Callable[[int, int], Learn]) -> np.ndarray:
    """The state after all rounds.  ``learner(round, epochs)``: six passes over rows of one part, one a round over more."""
    for k in range(ROUNDS):
        state = averaged(rows, parts, state, learner(k, 2 if parts == 1 else 1))
    return state


def counted(rows: DataFrame, logits: Callable[[pa.RecordBatch], np.ndarray]) -> list[tuple[str, float, int, int]]:
    """(lang, logit, label 1's, rows): all rows' logits, counted in steps of 1 / ``FINE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.rint(np.clip(logits(batch), -MOST, MOST) * FINE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(place), batch.column("label")], ["lang", "place", "label"])

    found = rows.select("text", "lang", "label").mapInArrow(run, "lang string, place int, label int").groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "place").agg(F.sum("label").alias("hits"), F.count("*").alias("n"))
    return sorted((r.lang, r.place / FINE, r.hits, r.n) for r in found.collect())
