"""What the text operators share: shared storage, range partitions and Arrow streams."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python function holds at once; an Arrow batch is cut into such slices.
SLICE_ROWS = 2048
#: Bytes of text that a Python function holds at once, beside one longer text.
SLICE_BYTES = 8 << 20
#: The same for a stage of a chain, where the executor holds the stages before it.
STAGE_ROWS, STAGE_BYTES = 256, 512 << 10
#: Characters of SQL white space: space and the control characters 9 to 13.
BLANKS = "\\x20\\x09-\\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def held_out() -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` in the folder that the cluster shares."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = _own_root(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _own_root(spark: SparkSession) -> str:
    """The folder set by setCheckpointDir; without one a new folder of this machine, in local mode only."""
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="silvaspark-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new shared folder and read it back.

    Unlike a checkpoint this keeps columns apart, so later reads fetch only what they use.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to the one row that ``groups`` has for each key, of ``size`` among ``total`` rows; ``size`` goes.

    Keys with more than one in 4 n rows, n the shuffle partitions, are fewer than 4 n: these are
    broadcast, so their rows stay where they are. The others are shuffled, none of them hot.
    ``groups`` is read three times and should be a written table; keys are not null.
    """
    hot = F.col(size) > max(1.0, total / (4 * partitions(rows.sparkSession)))
    few = F.broadcast(groups.filter(hot).drop(size))  # fewer than 4 n rows
    rest = rows.join(F.broadcast(groups.filter(hot).select(*on)), on, "left_anti")
    return rows.join(few, on).unionByName(rest.join(groups.filter(~hot).drop(size), on, how))


def tie(text: str = "text") -> Column:
    """A number that orders rows of one doc_id: a hash of the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def range_bucket(df: DataFrame, key: str, n: int) -> tuple[Column, int]:
    """Ranges of an integer ``key`` and then of ``tie()``, by approximate quantiles of all rows, and their number, about ``n``.

    The bounds are literals in a balanced tree of conditions, so every use gives the same
    ranges, whatever executor runs it. A null key comes before all others. A key that holds so many
    rows that several bounds fall on it is cut further by ranges of the hash.
    """
    if n <= 1:
        return F.lit(0), 1
    number, least = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), -(2.0**63)
    values = df.select(F.coalesce(F.col(key).cast("double"), F.lit(least)).alias(key)).stat.approxQuantile(key, [i / n for i in range(1, n)], 1 / (4 * n))
    times = Counter(int(v) for v in values)
    bounds = sorted(times)
    base = [0, *accumulate(1 + (times[b] if times[b] > 1 else 0) for b in bounds)]
    place = F.shiftright(tie(), 40) + F.lit(1 << 23)  # the 24 highest bits, from 0 on

    def leaf(i: int) -> Column:
        if i == len(bounds) or times[bounds[i]] == 1:
            return F.lit(base[i])
        inside = F.lit(base[i] + 1) + F.shiftright(place * F.lit(times[bounds[i]]), 24)
        return F.when(number == F.lit(bounds[i]), inside).otherwise(F.lit(base[i]))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return leaf(low)
        middle = (low + high) // 2
        return F.when(number > F.lit(bounds[middle]), tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(bounds)).cast("int"), base[-1] + 1


def calm() -> None:
    """Let the collector of cycles look less often: the functions here keep many objects and make no cycles."""
    gc.set_threshold(200_000, 20, 100)


def release() -> None:
    """Give memory back that an earlier task of this worker held: what it kept for words lives in cycles, and free memory stays with the process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of the batches, of at most ``rows`` rows and about ``most`` bytes of ``column``; a longer text is a part of its own."""
    calm()
    release()
    for batch in batches:
        sizes = None
        if column in batch.schema.names:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = min(start + rows, batch.num_rows)
            if sizes is not None:
                before = sizes[start - 1] if start else 0
                end = min(end, max(start + 1, int(np.searchsorted(sizes, before + most, "right"))))
            yield batch.slice(start, end - start)
            start = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Apply a function, made once for a task, to slices of a DataFrame's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for part in slices(batches, rows):
            yield function(part)
        del function
        release()

    return df.mapInArrow(run, schema)


class Memo(dict):
    """What a function gives for short strings, kept up to a number of entries.

    When full it starts anew, so its memory is bounded and frequent strings soon return.
    """

    def __init__(self, function: Callable[[str], object], limit: int, longest: int = 64):
        super().__init__()
        self.function, self.limit, self.longest = function, limit, longest

    def __missing__(self, key: str):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class Kept:
    """What a function of many strings gives for each, kept for about ``limit`` strings.

    Strings that were asked for lately stay: when the younger half is full it becomes the older
    one, and what is asked for from the older one returns to the younger. Strings of over
    ``longest`` characters are not kept.
    """

    def __init__(self, function: Callable[[list[str]], list], limit: int, longest: int = 64):
        self.function, self.limit, self.longest = function, limit // 2, longest
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def __call__(self, keys: list[str]) -> list:
        """The values of different keys, in their order."""
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        gaps = [i for i, v in enumerate(found) if v is None]
        if not gaps:
            return found
        asked = [keys[i] for i in gaps]
        values = list(map(old.get, asked)) if old else [None] * len(asked)
        new = [k for k, v in zip(asked, values, strict=True) if v is None]
        made = iter(self.function(new) if new else ())
        values = [next(made) if v is None else v for v in values]
        for i, value in zip(gaps, values, strict=True):
            found[i] = value
        if max(map(len, asked)) <= self.longest:
            young.update(zip(asked, values, strict=True))
        else:
            young.update((k, v) for k, v in zip(asked, values, strict=True) if len(k) <= self.longest)
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return found

    def clear(self) -> None:
        self.young, self.old = {}, {}


def word_table(texts: list[str]) -> tuple[list[str], list[int], list[int]]:
    """Texts cut at every space: the different words, the word of each place, and each text's first place."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = lists.flatten().dictionary_encode()
    n = len(coded.dictionary)
    words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if n else []
    return words, coded.indices.to_numpy().tolist(), lists.offsets.to_numpy().tolist()
