"""Folding updates into a state in their order, by any function of the old and the new value."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Reducer = Callable[[object, object], object]


def ordered_fold(updates: DataFrame, keys: Sequence[str], name: str, order: Sequence[str], value: str, reducers: Mapping[str, Reducer]) -> DataFrame:
    """``keys``, ``name``, ``value`` and n: the state of each name after all its updates in ``order``.

    A name's first update is its state; after that the state becomes
    ``reducers[name](old, new)``, or the new value for a name without a reducer.
    The order has to tell a name's updates apart, or its result may vary. An
    update is one row and nulls reach the reducers as None; keys and names may
    be null. The sorted updates of a partition stream past the one state that is
    open, so a name may have any number of them; all of a name's are one task's.
    """
    own = [*keys, name]
    kinds = {f.name: f.dataType.simpleString() for f in updates.schema.fields}
    dealt = updates.repartition(*own).sortWithinPartitions(*own, *order).select(*own, value)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        for batch in batches:
            done = []
            for *here, new in zip(*(batch.column(i).to_pylist() for i in range(len(own) + 1)), strict=True):
                if state and state[0] == here:
                    reducer = reducers.get(here[-1])
                    state[1], state[2] = reducer(state[1], new) if reducer else new, state[2] + 1
                else:
                    if state:
                        done.append(state)
                    state = [here, new, 1]
            yield table(done, batch.schema)
            schema = batch.schema
        if state:
            yield table([state], schema)

    def table(states: list, schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([s[0][i] for s in states], schema.field(i).type) for i in range(len(own))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([s[1] for s in states], schema.field(len(own)).type), pa.array([s[2] for s in states], pa.int64())], [*own, value, "n"])

    return dealt.mapInArrow(step, ", ".join(f"`{c}` {kinds[c]}" for c in [*own, value]) + ", n long")
