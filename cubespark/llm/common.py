"""What the corpus operators share: Arrow batches through a task-local function, and scratch tables."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from types import ModuleType

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubespark.sources.scratch import new_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows, and bytes of text, that a task turns into Python objects at a time; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 2_000_000
#: Rows of one key beyond which a join deals the key out to several tasks.
HOT_ROWS = 10_000
#: Keys that are broadcast (up to 40 bytes each); beyond that they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: ASCII white space, the only characters that separate words here.
SPACE = r"[\x20\x09-\x0D]+"

_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<int>": pa.list_(pa.int32()),
}


def per_worker(make: Callable, *args):
    """``make(*args)``, once for each Python worker process, which runs many tasks; only the latest is kept.

    The code of this module travels with the tasks, so what a worker keeps stands in a module of its own.
    """
    kept = sys.modules.setdefault("cubespark_worker", ModuleType("cubespark_worker")).__dict__
    key = (make.__module__, make.__qualname__, args)
    if kept.get("key") != key:
        kept.pop("value", None)
        kept.update(key=key, value=make(*args))
    return kept["value"]


def per_task(make: Callable, *args):
    """``make(*args)`` for one task; what ``per_worker`` keeps goes, so that a worker between tasks holds neither.

    For what is quickly filled again: Spark keeps idle workers beside tasks that run no Python, and both share an executor.
    """
    sys.modules.setdefault("cubespark_worker", ModuleType("cubespark_worker")).__dict__.pop("key", None)
    sys.modules["cubespark_worker"].__dict__.pop("value", None)
    return make(*args)


@contextmanager
def no_collection():
    """Collect what earlier tasks of this worker left, then hold collection off: a task's own tables have no cycles."""
    gc.collect()
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def slices(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE_ROWS rows and, beyond one row, SLICE_BYTES of text in these columns."""
    sizes = [0] * batch.num_rows
    for c in columns:
        column = batch.column(c)
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes = [a + (b or 0) for a, b in zip(sizes, pc.binary_length(column).to_pylist(), strict=True)]
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and (at - start == SLICE_ROWS or held + size > SLICE_BYTES):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def with_python_columns(
    df: DataFrame, inputs: list[str], new: dict[str, str], make: Callable[[], Callable]
) -> DataFrame:
    """Add columns computed in Python, a slice of rows at a time.

    ``make()`` runs once in each task and returns ``fn(*lists)``, which gets one list for each input column and
    returns one list (or array) for each new column. A column of ``df`` whose name clashes with a new one (in any
    case) is replaced; all others pass through untouched as Arrow data. An empty table gives an empty table.
    """
    clash = {n.lower() for n in new}
    keep = [c for c in df.columns if c.lower() not in clash]
    if missing := [c for c in inputs if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    schema = T.StructType([f for f in df.schema if f.name in keep])
    for name, kind in new.items():
        schema = schema.add(name, T.StructType.fromDDL(f"c {kind}")[0].dataType)
    kinds = [_ARROW[k] for k in new.values()]

    def run(batches):
        with no_collection():
            fn = make()
            for batch in batches:
                for part in slices(batch, inputs):
                    got = fn(*(part.column(c).to_pylist() for c in inputs))
                    made = [pa.array(v, type=t) for v, t in zip(got, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=[*keep, *new])
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, on any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, inner: dict[str, str], new: tuple[str, ...]) -> DataFrame:
    """The columns that an operator reads, named as in ``inner``, beside all others in one struct ``_row``.

    So no name of the caller's can clash with one inside the operator. Columns named like a ``new`` one (in any case) are
    left out, as the operator's own takes their place. ``unpacked`` is the way back.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in inner.values() and c.lower() not in new]
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in inner.items()], F.struct(*(rest or [F.lit(0).alias("none")])).alias("_row"))


def unpacked(df: DataFrame, like: DataFrame, inner: dict[str, str], new: tuple[str, ...]) -> DataFrame:
    """The columns of ``like`` in their order, then the ``new`` ones."""
    names = {c: n for n, c in inner.items()}
    old = [F.col(names[c]).alias(c) if c in names else F.col(f"_row.`{c}`").alias(c) for c in like.columns if c.lower() not in new]
    return df.select(*old, *new)


def small(df: DataFrame) -> DataFrame:
    """Broadcast a written table of keys if it has at most BROADCAST_KEYS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def hot_keys(many: DataFrame, on: str) -> DataFrame | None:
    """(on, _parts): keys of a written table with over HOT_ROWS rows, and to how many tasks each is dealt; None if there are none."""
    counts = many.groupBy(on).agg(F.count("*").alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) <= HOT_ROWS:
        return None
    return small(written(counts.filter(F.col("_n") > HOT_ROWS).select(on, F.ceil(F.col("_n") / HOT_ROWS).alias("_parts")), "hot"))


def salted_join(many: DataFrame, one: DataFrame, on: str, deal: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Join where ``many`` may hold very many rows of the ``hot`` keys, and ``one`` holds one row of each key.

    Rows of a hot key are dealt to several tasks by a hash of column ``deal``; the key's row of ``one`` goes to each.
    """
    if hot is None:
        return many.join(one, on, how)
    dealt = many.join(hot, on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(deal), F.col("_parts")), F.lit(0))).drop("_parts")
    parts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1)
    copies = one.join(hot, on, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return dealt.join(copies, [on, "_part"], how).drop("_part")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
