"""Ordered walks over long logs: one range exchange, then state carried on.

Rows are range-partitioned on (key, order) and sorted, so a partition holds a
consecutive stretch and a hot key's history is spread over several.  Each
partition is reduced where it lies.  Only its first and its last key can go on
in a neighbour, so two summaries a partition (``edge``) are all that still
has to be chained; every other key is complete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentlens.session import stored


def ranged(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` in sorted partitions whose numbers follow (key, order).  No
    count is fixed: adaptive execution may merge neighbours, which keeps the order."""
    return rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)


def reduce_in_place(
    rows: DataFrame, key: list[str], summarise: Callable, combine: Callable, schema: str, what: str
) -> tuple[DataFrame, DataFrame]:
    """Summaries per key of :func:`ranged` rows: (complete, edges).

    ``summarise(batch, starts)`` gives the summary columns (lists or arrays, by
    name) of the runs of equal keys that begin at ``starts``; ``combine(left,
    right)`` joins the summaries (dicts) of two consecutive runs of one key.
    ``schema`` names the summary columns.  ``edges`` also have ``__seg``, by
    which the summaries of a key are ordered; there are at most two a partition.
    Both functions run in the workers and must bring what they use.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        seg = TaskContext.get().partitionId()
        held, first, schema_of = None, True, None

        def emit(summaries, edge):
            cols = {c: [s[c] for s in summaries] for c in names}
            n = len(summaries)
            arrays = [pa.array(cols[c], t) for c, t in zip(names, types)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([seg] * n, pa.int32()), pa.array([edge] * n, pa.bool_())], names=[*names, "__seg", "__edge"])

        names = types = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, bool)
            change[0] = True
            for k in key:
                col = batch.column(batch.schema.get_field_index(k))
                a, b = col.slice(1), col.slice(0, n - 1)
                differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
                differs |= pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
                change[1:] |= differs
            starts = np.flatnonzero(change)
            cols = {k: batch.column(batch.schema.get_field_index(k)).take(pa.array(starts)) for k in key}
            for c, v in summarise(batch, starts).items():
                cols[c] = v if isinstance(v, pa.Array) else pa.array(v)
            names, types = list(cols), [c.type for c in cols.values()]
            runs = pa.RecordBatch.from_arrays(list(cols.values()), names=names)
            m = runs.num_rows
            head = runs.slice(0, 1).to_pylist()[0]
            if held is not None and all(held[k] == head[k] for k in key):
                held = combine(held, head)
                if m == 1:
                    continue
                yield emit([held], first)
                first, lo = False, 1
            elif held is not None:
                yield emit([held], first)
                first, lo = False, 0
            else:
                if m == 1:
                    held = head
                    continue
                yield emit([head], True)
                first, lo = False, 1
            if m - 1 > lo:
                middle = runs.slice(lo, m - 1 - lo)
                k = middle.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*middle.columns, pa.array([seg] * k, pa.int32()), pa.array([False] * k, pa.bool_())], names=[*names, "__seg", "__edge"]
                )
            held = runs.slice(m - 1, 1).to_pylist()[0]
        if held is not None:
            yield emit([held], True)

    of_key = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    done = stored(rows.mapInArrow(run, f"{of_key}, {schema}, __seg int, __edge boolean"), what)
    return done.where("NOT __edge").drop("__seg", "__edge"), done.where("__edge").drop("__edge")


def running_totals(rows: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` (a long) over the earlier rows
    of the same key.  (key, order) is unique.

    Totals run inside each partition; of an earlier stretch only the total is
    needed, by the first key of a partition alone, which is one row a partition.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        seg = TaskContext.get().partitionId()
        last, total, stretch = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)) for k in key]
            change = np.zeros(n, bool)
            for col in cols:
                a, b = col.slice(1), col.slice(0, n - 1)
                differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
                change[1:] |= differs | pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
            head = [c[0].as_py() for c in cols]
            change[0] = last is None or head != last
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(values)))
            starts = np.flatnonzero(change)
            run_of = np.cumsum(change) - 1  # -1: the key goes on from the batch before
            base = np.concatenate((sums[starts], [0 - total]))[run_of]
            before = sums[:-1] - base
            number = stretch + run_of + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(before), pa.array(np.full(n, seg, np.int32)), pa.array(number.astype(np.int64))],
                names=[*batch.schema.names, out, "__seg", "__run"],
            )
            last, total, stretch = [c[n - 1].as_py() for c in cols], int(before[-1] + values[-1]), int(number[-1])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    parts = stored(ranged(rows, key, order).mapInArrow(run, f"{schema}, `{out}` long, __seg int, __run long"), "running")
    # the last stretch of each partition, and the first ones, by (partition, stretch)
    ends = parts.groupBy("__seg").agg(F.min("__run").alias("lo"), F.max("__run").alias("hi"))
    edge = parts.join(F.broadcast(ends), "__seg").where("__run = lo OR __run = hi")  # two keys a partition
    sums = edge.groupBy("__seg", "__run", "lo", *key).agg(F.sum(value).alias("s"))
    w = Window.partitionBy(*key).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("carry", F.sum("s").over(w)).where("__run = lo AND carry IS NOT NULL").select("__seg", "__run", "carry")
    # bounded: one row a partition
    total = (F.col(out) + F.coalesce("carry", F.lit(0).cast("long"))).alias(out)
    return parts.join(F.broadcast(carry), ["__seg", "__run"], "left").select(*[F.col(f"`{c}`") for c in rows.columns], total)


def running_max(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the largest ``value`` (a long, may be null) up to
    and with each row in the ``order`` over all rows; null before the first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        seg, low = TaskContext.get().partitionId(), np.iinfo(np.int64).min
        top = low
        for batch in batches:
            if batch.num_rows:
                values = batch.column(batch.schema.get_field_index(value)).fill_null(low).to_numpy(zero_copy_only=False)
                best = np.maximum.accumulate(np.maximum(values, top))
                top = best[-1]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(best, mask=best == low), pa.array(np.full(len(best), seg, np.int32))],
                    names=[*batch.schema.names, out, "__seg"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    parts = stored(ranged(rows, [], order).mapInArrow(run, f"{schema}, `{out}` long, __seg int"), "running")
    w = Window.orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carry = parts.groupBy("__seg").agg(F.max(out).alias("m")).withColumn("carry", F.max("m").over(w)).select("__seg", "carry")
    return parts.join(F.broadcast(carry), "__seg").select(*[F.col(f"`{c}`") for c in rows.columns], F.greatest(out, "carry").alias(out))
