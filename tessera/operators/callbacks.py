"""User functions over complete batches, and user metrics as mergeable states."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tessera.operators.sequence import assign_batches

MERGE_WAYS = 64


# ---------------------------------------------------------------- batches
def map_batches(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str, order_cols, batch_size: int, group_cols=()) -> DataFrame:
    """Call ``fn`` with every batch of ``batch_size`` consecutive rows (by ``order_cols``) as one Arrow table.

    The table has the columns of ``df`` and ``batch_id``, rows in order; what ``fn`` returns (``schema``) is the
    result. A batch is complete whatever the cuts of partitions and Arrow record batches: a batch's rows are
    sent to one partition, and rows are held over until the next batch begins. Only the last batch
    (of a group) is smaller. Batch numbers restart with each group; a null group is a group.
    """
    groups = list(group_cols)
    keyed = assign_batches(df, order_cols, batch_size, groups)
    keyed = keyed.repartition(*groups, "batch_id").sortWithinPartitions(*groups, "batch_id", *order_cols)
    names = StructType.fromDDL(schema).names

    def run(batches):
        held, key = [], None

        def done():
            out = fn(pa.Table.from_batches(held).combine_chunks())
            return out.select(names).to_batches()

        for record in batches:
            if not record.num_rows:
                continue
            at, keys = 0, list(zip(*[record.column(c).to_pylist() for c in (*groups, "batch_id")]))
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[at]:
                    continue
                if held and keys[at] != key:
                    yield from done()
                    held = []
                key = keys[at]
                held.append(record.slice(at, i - at))
                at = i
        if held:
            yield from done()

    return keyed.mapInArrow(run, schema)


# ---------------------------------------------------------------- metrics
class Metric:
    """A metric as a state: ``init``, ``add`` a batch, ``merge`` two states, ``finish`` as rows of ``schema``.

    States travel pickled, so they are plain objects; their size must not grow with the rows.
    """

    schema: str = "value double"

    def init(self):
        raise NotImplementedError

    def add(self, state, batch: pa.Table):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def finish(self, state) -> list[tuple]:
        raise NotImplementedError


METRICS: dict[str, Metric] = {}


def register_metric(name: str, metric: Metric) -> None:
    """Make a metric known under a name that :func:`compute_metric` accepts."""
    METRICS[name] = metric


def compute_metric(df: DataFrame, metric: Metric | str, by=()) -> DataFrame:
    """``by`` columns and the columns of the metric's schema, for every group of ``df`` (null groups too).

    Every task adds its rows to a state per group; states are merged in up to ``MERGE_WAYS`` salted groups
    and then once more, so no task gets more states than tasks / ``MERGE_WAYS`` of a group. An empty table gives
    no rows with ``by``, and the finished initial state without.
    """
    m = METRICS[metric] if isinstance(metric, str) else metric
    by = list(by)
    types = dict(df.dtypes)
    state_schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "salt int", "state binary"])
    cols = [c for c in df.columns if c not in by]
    fields = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(m.schema)]

    def rows_of(states: dict, salt: int, schema: pa.Schema) -> pa.RecordBatch:
        keys = list(states)
        arrays = [pa.array([k[i] for k in keys], schema.field(c).type) for i, c in enumerate(by)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([salt] * len(keys), pa.int32()), pa.array([pickle.dumps(states[k]) for k in keys], pa.binary())],
                                          names=[*by, "salt", "state"])

    def add(batches):
        states, schema, salt = {}, None, TaskContext.get().partitionId() % MERGE_WAYS
        for record in batches:
            schema = record.schema
            t = pa.Table.from_batches([record])
            if not by:
                states[()] = m.add(states[()] if () in states else m.init(), t)
                continue
            place: dict = {}
            for i, k in enumerate(zip(*[t.column(c).to_pylist() for c in by])):
                place.setdefault(k, []).append(i)
            for k, at in place.items():
                states[k] = m.add(states[k] if k in states else m.init(), t.select(cols).take(at))
        if states:
            yield rows_of(states, salt, schema)

    def merge(t: pa.Table) -> pa.Table:
        state = m.init()
        for raw in t.column("state").to_pylist():
            state = m.merge(state, pickle.loads(raw))
        return pa.Table.from_batches([rows_of({tuple(t.column(c)[0].as_py() for c in by): state}, 0, t.schema)])

    def finish(t: pa.Table) -> pa.Table:
        merged = merge(t)
        out = m.finish(pickle.loads(merged.column("state")[0].as_py()))
        return pa.table({**{c: pa.array([merged.column(c)[0].as_py()] * len(out), merged.schema.field(c).type) for c in by},
                         **{c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(fields)}})

    states = df.select(*by, *cols).mapInArrow(add, state_schema)
    if not by:
        first = df.sparkSession.createDataFrame([(0, bytearray(pickle.dumps(m.init())))], "salt int, state binary")
        states = states.unionByName(first)
    states = states.groupBy(*by, "salt").applyInArrow(merge, state_schema)
    out_schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], m.schema])
    return states.withColumn("salt", F.lit(0)).groupBy(*by, "salt").applyInArrow(finish, out_schema)


class ClassReport(Metric):
    """The rows of :func:`tessera.operators.metrics.class_report` from counts by (gold, predicted) class."""

    schema = "class string, precision double, recall double, f1 double, support long"

    def __init__(self, gold: str = "gold", pred: str = "pred"):
        self.gold, self.pred = gold, pred

    def init(self):
        return {}

    def add(self, state, batch):
        pairs = batch.select([self.gold, self.pred]).group_by([self.gold, self.pred]).aggregate([([], "count_all")])
        new = {(None if g is None else str(g), None if p is None else str(p)): n
               for g, p, n in zip(*[pairs.column(c).to_pylist() for c in (self.gold, self.pred, "count_all")])}
        return self.merge(state, new)

    def merge(self, a, b):
        out = dict(a)
        for k, n in b.items():
            out[k] = out.get(k, 0) + n
        return out

    def finish(self, state):
        if not state:
            return []
        part = lambda x, y: x / y if y else 0.0
        rows, total, right = [], sum(state.values()), sum(n for (g, p), n in state.items() if g == p)
        for c in {x for k in state for x in k}:
            support, said = (sum(n for k, n in state.items() if k[i] == c) for i in (0, 1))
            p, r = part(state.get((c, c), 0), said), part(state.get((c, c), 0), support)
            rows.append((c, p, r, part(2 * p * r, p + r), support))
        mean = lambda i: sum(r[i] for r in rows) / len(rows)
        weighted = lambda i: sum(r[i] * r[4] for r in rows) / total
        return [*rows, ("accuracy", None, None, right / total, total), ("macro avg", mean(1), mean(2), mean(3), total),
                ("weighted avg", weighted(1), weighted(2), weighted(3), total)]


register_metric("class_report", ClassReport())
