"""Availability masks, morphology, folds and chunk selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespark.functions.grid import CELL, chunk_of
from cubespark.sources.scratch import small, written

CHUNK_KEYS = ["chunk_lat", "chunk_lon"]


def with_chunks(df: DataFrame, size: int) -> DataFrame:
    return df.withColumns({"chunk_lat": chunk_of("lat_idx", size), "chunk_lon": chunk_of("lon_idx", size)})


def availability_mask(parts: list[tuple[DataFrame, Column]]) -> DataFrame:
    """A5: cells for which, in every part, the condition holds in at least one row."""
    each = [df.groupBy(*CELL).agg(F.bool_or(F.coalesce(cond, F.lit(False))).alias("ok")).filter("ok").select(*CELL) for df, cond in parts]
    every = parts[0][0].select(*CELL).distinct()
    valid = reduce(lambda x, y: x.join(y, CELL, "left_semi"), each).withColumn("_m", F.lit(True))
    return every.join(valid, CELL, "left").select(*CELL, F.coalesce("_m", F.lit(False)).alias("mask"))


def chunk_any(mask: DataFrame, size: int, n_lat: int, n_lon: int) -> DataFrame:
    """Whether a chunk has a valid cell; the grid must divide into chunks."""
    if n_lat % size or n_lon % size:
        raise ValueError("the grid does not divide into chunks of that size")
    return with_chunks(mask, size).groupBy(*CHUNK_KEYS).agg(F.bool_or("mask").alias("valid"))


def chunk_counts(mask: DataFrame, size: int, windows: int = 1) -> DataFrame:
    """Valid samples in each chunk."""
    return with_chunks(mask.filter("mask"), size).groupBy(*CHUNK_KEYS).agg((F.count("*") * windows).alias("samples"))


def distinct_chunks(mask: DataFrame, size: int) -> DataFrame:
    """Chunks with unmasked cells."""
    return with_chunks(mask.filter("mask"), size).select(*CHUNK_KEYS).distinct()


def mask_chunks(df: DataFrame, mask: DataFrame, size: int) -> DataFrame:
    """Rows in chunks with at least one valid cell.

    If ``df`` holds its chunk keys, as a table partitioned by chunk does, they are joined as stored: the valid chunks (a
    table that is counted, and broadcast while it is small) prune its partitions at run time, and no other file is read.
    """
    counts = written(with_chunks(mask, size).groupBy(*CHUNK_KEYS).agg(F.count_if("mask").alias("valid")), "chunks")
    rows = df if set(CHUNK_KEYS) <= set(df.columns) else with_chunks(df, size)
    return rows.join(small(counts).filter("valid > 0").select(*CHUNK_KEYS), CHUNK_KEYS, "left_semi").select(*rows.columns)


def apply_mask(df: DataFrame, mask: DataFrame, drop: bool = True, columns: list[str] = ()) -> DataFrame:
    """keep valid cells only, or null the columns of the others."""
    valid = mask.filter("mask").select(*CELL)
    if drop:
        return df.join(valid, CELL, "left_semi")
    known = df.join(valid.withColumn("_m", F.lit(True)), CELL, "left")
    return known.withColumns({c: F.when(F.col("_m"), F.col(c)) for c in columns}).drop("_m")


def disk(n: int) -> list[tuple[int, int]]:
    """Offsets of a disk of odd diameter n."""
    if n % 2 == 0:
        raise ValueError("the kernel size must be odd")
    h = n // 2
    return [(y, x) for y in range(-h, h + 1) for x in range(-h, h + 1) if y * y + x * x <= h * h]


def _around(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell moved by each offset: a fixed number of rows for each."""
    steps = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in offsets]))
    moved = cells.select(*CELL, steps.alias("_o"))
    return moved.select((F.col("lat_idx") + F.col("_o.y")).alias("lat_idx"), (F.col("lon_idx") + F.col("_o.x")).alias("lon_idx"))


def buffer_exclude(ref: DataFrame, target: DataFrame, n: int) -> DataFrame:
    """Target cells outside the disks around all reference cells; n = 1 changes nothing."""
    return target.join(_around(ref.select(*CELL), disk(n)).distinct(), CELL, "left_anti") if n > 1 else target


def binary_opening(mask: DataFrame, n_lat: int, n_lon: int) -> DataFrame:
    """Two erosions and two dilations by the 4-neighbour cross; beyond the grid is false.

    Two passes equal one with the radius-2 diamond of 13 cells, so each is one grouping.
    """
    diamond = [(y, x) for y in range(-2, 3) for x in range(-2, 3) if abs(y) + abs(x) <= 2]
    inside = F.col("lat_idx").between(0, n_lat - 1) & F.col("lon_idx").between(0, n_lon - 1)
    eroded = _around(mask.filter("mask").select(*CELL), diamond).filter(inside).groupBy(*CELL).count().filter(F.col("count") == 13)
    opened = _around(eroded.select(*CELL), diamond).filter(inside).distinct().withColumn("_m", F.lit(True))
    return mask.select(*CELL).join(opened, CELL, "left").select(*CELL, F.coalesce("_m", F.lit(False)).alias("mask"))


def assign_folds(mask: DataFrame, k: int, chunk: int, seed: int, n_lon: int, eligible: Column | None = None) -> DataFrame:
    """Fold 1..k of each cell by its chunk, 0 if masked or outside the eligible regions.

    The order of chunks is md5 of their row-major id and the seed. The window spans distinct chunks only, of which a
    global 0.1 degree grid has a few thousand.
    """
    ok = F.col("mask") if eligible is None else F.col("mask") & eligible
    cells = with_chunks(mask, chunk).withColumn("_ok", ok)
    chunks = cells.filter("_ok").select(*CHUNK_KEYS).distinct()
    per_row = -(-n_lon // chunk)
    cid = F.col("chunk_lat") * per_row + F.col("chunk_lon")
    order = Window.orderBy(F.md5(F.concat_ws("|", cid.cast("string"), F.lit(str(seed)))), *CHUNK_KEYS)
    folds = chunks.withColumn("fold", F.ntile(k).over(order))
    out = cells.join(folds, CHUNK_KEYS, "left")
    return out.select(*CELL, F.when(F.col("_ok"), F.coalesce("fold", F.lit(0))).otherwise(0).alias("fold_mask"))


def fold_roles(df: DataFrame, fold_id: int, k: int = 10, fold: str = "fold_mask") -> DataFrame:
    """Train, val or test of each row by its fold; masked rows have no role."""
    if not 0 <= fold_id < k:
        raise ValueError(f"fold_id must be in 0..{k - 1}")
    val, test = fold_id % k + 1, (fold_id + 1) % k + 1
    role = F.when(F.col(fold) == val, "val").when(F.col(fold) == test, "test").when(F.col(fold) > 0, "train")
    return df.withColumn("role", role)


def prediction_set(df: DataFrame, fold_id: int, k: int = 10, fold: str = "fold_mask", all_folds: bool = False) -> DataFrame:
    """The rows that iteration ``fold_id`` predicts: those of its test fold, or of all folds."""
    roles = fold_roles(df, fold_id, k, fold)
    return roles.filter(F.col("role").isNotNull() if all_folds else F.col("role") == "test")


def split_chunks(mask: DataFrame, size: int, n: int, i: int) -> DataFrame:
    """Cells of the i-th of n runs of valid chunks in row-major order; all others are masked."""
    if not 0 <= i < n:
        raise ValueError(f"index must be in 0..{n - 1}")
    chunks = distinct_chunks(mask, size).withColumn("_t", F.ntile(n).over(Window.orderBy(*CHUNK_KEYS)))
    out = with_chunks(mask, size).join(chunks, CHUNK_KEYS, "left")
    return out.select(*CELL, F.coalesce(F.col("mask") & (F.col("_t") == i + 1), F.lit(False)).alias("mask"))


def fold_difference(folds: DataFrame, val: int, test: int, fold: str = "fold_mask") -> DataFrame:
    """All folds except validation and test."""
    return folds.select(fold).filter(F.col(fold) > 0).distinct().exceptAll(folds.sparkSession.createDataFrame([(val,), (test,)], f"{fold} int"))


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells valid in both."""
    return a.filter("mask").select(*CELL).intersect(b.filter("mask").select(*CELL))


def mask_and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells valid in a and not in b."""
    return a.filter("mask").select(*CELL).exceptAll(b.filter("mask").select(*CELL))


def check_cube(df: DataFrame, targets: list[str] = (), chunk: bool = False) -> DataFrame:
    """Keys must exist, and one of the targets; returns df."""
    need = [*CELL, *(CHUNK_KEYS if chunk else [])]
    if missing := [c for c in need if c not in df.columns]:
        raise ValueError(f"the cube lacks {missing}")
    if targets and not any(t in df.columns for t in targets):
        raise ValueError("no target is in the cube")
    return df
