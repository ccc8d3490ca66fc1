"""Near duplicates by HyperMinHash: registers of leading zeros and mantissa bits, banded.

A text's word shingles are hashed to 64 bits. A hash falls into one of the buckets; the least
value there is kept as a register of 16 bits: the number of its leading zeros and the ten bits
after the first one. Empty registers are filled from others of the same text, in an order that
depends on the register alone, so that two registers agree about as often as the sets do (their
Jaccard index). Six registers make a band.

1. Texts with the same shingle set form a class, whose least doc_id stands for it.
2. Texts that share a band meet in the least id there, its hub, so a band of any size gives as
   many pairs as it has texts. Of its hubs a text takes the one with the highest likeness, as the
   registers estimate it, corrected for registers that agree by chance; the pair is verified
   on the full sets. Components of these links are formed, and the texts that hubs left apart
   try again with hubs among what is left, while that links many.
3. Texts that are still in a band with texts of another component are compared with them in
   blocks: groups that bands hold together and whose sets are of like size are cut into blocks,
   those of the group's largest component apart from all others, and a task gets the registers of
   two blocks. So a group of any size is spread, and a large component goes only to the few
   texts beside it, not to itself. What the registers leave over goes on with its text: products of
   incidence matrices give the sizes of the intersections of full sets. No pair is a row but the
   links found.

A pair with an index of 0.8 shares none of the 48 bands with a probability below 1e-6.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators import graph
from .common import SLICE_ROWS, STAGE_ROWS, fresh, map_slices, release, slices, spread_join, texts_of, written
from .hashing import mix, stretches

BANDS, ROWS, MANTISSA = 48, 6, 10
REGISTERS = BANDS * ROWS
#: Standard errors of the estimate below the threshold from which a pair is verified; sets so small are verified in any case.
SLACK, SMALL = 6.0, 128
#: Bits of the map of texts that are verified: at most 2^16 rows of 64 bits, at any size of input.
MAP_BITS = 1 << 22
#: Rounds of hubs before what is left is verified in blocks; texts of a block.
HUB_ROUNDS, BLOCK = 2, 256
#: Shingles that a product takes at once.
COLUMNS = 1 << 14

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles: A-Z lower-cased, words between blanks.

    A text of fewer words is one shingle; without words there is none.
    """
    data = np.frombuffer(text.encode().lower(), np.uint8)
    inside = np.concatenate([[False], ~_BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.zeros(0, np.uint64)
    hashes = stretches(data, edges[::2], edges[1::2])
    n = len(hashes)
    size = min(words, n)
    found = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k])
    return np.unique(found)


def _registers(values: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of least values."""
    part, exponent = np.frexp(np.maximum(values, 1).astype(np.float64))
    return ((64 - np.minimum(exponent, 64)) * (1 << MANTISSA) + np.minimum((part - 0.5) * (2 << MANTISSA), (1 << MANTISSA) - 1)).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set; a row of zeros for an empty set."""
    full = np.uint64((1 << 64) - 1)
    least = np.full(len(sets) * REGISTERS, full, np.uint64)
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, of * REGISTERS + bucket, mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)))
    least = least.reshape(len(sets), REGISTERS)
    filled, empty = least.copy(), least == full
    row, column = np.nonzero(empty & ~empty.all(axis=1, keepdims=True))
    turn = 0
    while len(row):
        other = (mix(column.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(turn)) % np.uint64(REGISTERS)).astype(np.int64)
        got = least[row, other]
        hit = got != full
        # the turn is mixed in, so that one value in two places is not two equal registers for sure
        filled[row[hit], column[hit]] = got[hit]
        row, column, turn = row[~hit], column[~hit], turn + 1
    out = _registers(filled)
    out[empty.all(axis=1)] = 0
    return out


def chance(n: int = REGISTERS) -> float:
    """How often two registers of different least values agree: equal leading zeros (1 in 3), then equal mantissas."""
    return 1 / 3 / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Jaccard index from rows of registers, without what agrees by chance."""
    same, by_chance = (a == b).mean(axis=-1), chance()
    return np.maximum(0.0, (same - by_chance) / (1 - by_chance))


def lowest(percent: int) -> float:
    """The estimate below which a pair is not verified."""
    threshold = percent / 100
    return threshold - SLACK * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def sketch_table(docs: DataFrame, words: int, rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, n (shingles), sig (digest of the set), regs (registers as bytes, null for an empty set); ``rows`` are sketched at once."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, words) for t in texts_of(batch)]
            regs = sketches(sets)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary())],
                names=["doc_id", "n", "sig", "regs"],
            )

        return run

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n long, sig binary, regs binary", rows)


def _bit(name: str):
    return F.pmod(F.xxhash64(F.col(name)), F.lit(MAP_BITS))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ``ids``, and of few others: a bit map of bounded size drops the rest before the shuffle."""
    bits = ids.select(_bit("id").alias("_b")).groupBy(F.shiftright("_b", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_b % 64 as int)))").alias("_bits"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null and text is not null").withColumn("_w", F.shiftright(_bit("id"), 6))
    return rows.join(F.broadcast(bits), "_w").filter(F.getbit("_bits", (_bit("id") % 64).cast("int")) == 1).select("id", "text")


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full shingle sets have an index of at least ``percent`` hundredths."""
    texts = written(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id"))), "near-texts")
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.zeros(0, np.uint64)
        for part in slices(batches):
            good = []
            for ta, tb in zip(texts_of(part, "ta"), texts_of(part, "tb"), strict=True):
                if tb != last:
                    last, known = tb, shingles(tb, words)
                mine = shingles(ta, words)
                both = len(np.intersect1d(mine, known, assume_unique=True))
                good.append(100 * both >= percent * (len(mine) + len(known) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long").distinct()


def estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs with their estimate ``e``, without those far below the threshold."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    low = lowest(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            regs = [np.frombuffer(b"".join(part.column(x).to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in ("ra", "rb")]
            e = estimate(*regs)
            small = np.minimum(part.column("na").to_numpy(), part.column("nb").to_numpy()) <= SMALL
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(e)], names=["a", "b", "e"]).filter(pa.array((e >= low) | small))

    return rows.mapInArrow(run, "a long, b long, e double")


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` of the ids in links ``a``, ``b``."""
    links = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "near-edges")
    return written(graph.components(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), links), "near-components")


def near_links(docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """``id``, ``component`` of the representatives that have links: every link between different sets counts."""
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("regs", b * F.lit(2 * ROWS) + F.lit(1), F.lit(2 * ROWS))))
    keys = reps.select("id", "n", F.explode(band).alias("key"))
    shared = written(keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("k")).filter("k > 1"), "near-keys")
    bands = written(spread_join(keys, shared, ["key"], "k", BANDS * reps.count()), "near-bands")

    links, labels, tried = None, None, None
    for _ in range(HUB_ROUNDS):
        pairs = bands.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        guessed = estimated(pairs, reps, percent)
        best = written(guessed.groupBy("a").agg(F.max_by("b", F.struct("e", -F.col("b"))).alias("b")), "near-best")
        new = written(verified(docs, best, words, percent), "near-links")
        tried = best if tried is None else tried.union(best)
        links = new if links is None else links.union(new)
        if new.isEmpty():
            break
        labels = components(links)
        bands = written(_apart(bands, labels), "near-bands")
        if bands.isEmpty():
            return labels
    of = bands if "of" in bands.columns else bands.withColumn("of", F.col("id"))
    more = written(block_links(docs, reps, of, words, percent), "near-links")
    return labels if labels is not None and more.isEmpty() else components(links.union(more))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of pairs of different sets (not the diagonal), by products of slices of the incidence matrix."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    of, column = of[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, width - low)), np.float32)
        part[of[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def passing(regs: np.ndarray, n: np.ndarray, of: np.ndarray, half: np.ndarray, percent: int) -> np.ndarray:
    """Whether each text of a block, or of two (``half``), has a partner that the registers let reach the threshold.

    Partners have another component, like sizes and a band in common; of two blocks they lie in different ones.
    """
    low, small, found = lowest(percent), n <= SMALL, np.zeros(len(n), bool)
    two = half.min() != half.max()
    keys = regs.reshape(len(n), BANDS, ROWS)
    for i in range(len(n) - 1):
        rest = slice(i + 1, None)
        like = (of[rest] != of[i]) & (100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest]))
        if two:
            like &= half[rest] != half[i]
        at = np.flatnonzero(like) + i + 1
        if not len(at):
            continue
        at = at[small[i] | small[at] | (estimate(regs[i], regs[at]) >= low)]
        if len(at):
            at = at[(keys[at] == keys[i]).all(axis=2).any(axis=1)]
            found[at] = True
            found[i] |= len(at) > 0
    return found


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` from sorted batches, one table for each."""
    release()
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if last is not None and tuple(values[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(values[a])
    if held:
        yield pa.Table.from_batches(held)


def block_links(docs: DataFrame, reps: DataFrame, bands: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``a``, ``b`` between texts of different components ``of`` that share a band.

    Registers go to the pairs of blocks; texts only of those that ``passing`` leaves over there.
    """
    clusters = components(bands.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "cluster")
    # sizes within the threshold are in the same or in neighbouring classes; a group has two classes
    ratio = math.log(100 / percent)
    members = bands.select("id", "n", "of").distinct().join(clusters, "id").withColumn("c", F.floor(F.log("n") / ratio))
    both = written(members.withColumn("g", F.explode(F.array("c", F.col("c") - 1))).drop("c"), "near-groups")
    sizes = both.groupBy("cluster", "g", "of").agg(F.count("*").alias("k"))
    groups = sizes.groupBy("cluster", "g").agg(F.max_by("of", F.struct("k", -F.col("of"))).alias("main"), F.max("k").alias("large"), F.sum("k").alias("k")).filter("large < k")
    groups = groups.select("cluster", "g", "main", "k", F.ceil(F.col("large") / BLOCK).alias("mains"), F.ceil((F.col("k") - F.col("large")) / BLOCK).alias("others"))
    held = spread_join(both, written(groups, "near-sizes"), ["cluster", "g"], "k", both.count())
    main = F.col("of") == F.col("main")
    placed = held.withColumn("block", F.pmod(F.xxhash64("id"), F.when(main, F.col("mains")).otherwise(F.col("others"))))
    cell = lambda i, j, half: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), half.cast("long").alias("half"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = F.col("block")
    # blocks of the largest component meet those of the others (j below 0), these meet each other
    with_others = F.transform(upto("others"), lambda o: cell(own, -1 - o, F.lit(0)))
    with_main = F.transform(upto("mains"), lambda b: cell(b, -1 - own, F.lit(1)))
    among = F.transform(upto("others"), lambda o: cell(F.least(own, o), F.greatest(own, o), own))
    cells = placed.withColumn("c", F.explode(F.when(main, with_others).otherwise(F.concat(with_main, among)))).select("cluster", "g", "c.i", "c.j", "c.half", "id", "of", "n")
    keys = ["cluster", "g", "i", "j"]
    sketched = cells.join(reps.select("id", "regs"), "id").repartition(*keys).sortWithinPartitions(*keys, "id")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, keys):
            if table.num_rows < 2:
                continue
            column = lambda name, table=table: table.column(name).to_numpy()
            regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            found = passing(regs, column("n"), column("of"), column("half"), percent)
            if found.any():
                yield from table.select([*keys, "id", "of"]).filter(pa.array(found)).to_batches()

    left = written(sketched.select(*keys, "half", "id", "of", "n", "regs").mapInArrow(leave, "cluster long, g long, i long, j long, id long, of long"), "near-left")
    texts = written(_texts(docs, left.select("id").distinct()), "near-texts")
    rows = left.join(texts, "id").repartition(*keys).sortWithinPartitions(*keys, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, keys):
            ids, of = table.column("id").to_pylist(), table.column("of").to_pylist()
            sets = [shingles(t, words) for t in table.column("text").to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            both = intersections(sets)
            a, b = np.nonzero(np.triu((both > 0) & (100 * both >= percent * (n[:, None] + n[None, :] - both)), 1))
            found, root = [], {o: o for o in of}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                if (p := find(of[x])) != (q := find(of[y])):
                    root[p] = q
                    found.append((ids[y], ids[x]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return rows.select(*keys, "id", "of", "text").mapInArrow(run, "a long, b long").distinct()


def _apart(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """Bands that hold texts of several components, with each text's component ``of`` and a new hub.

    The hub is the least id; for the texts of the hub's own component it is the least id of
    another component, so that each round tries new pairs across components.
    """
    of = written(bands.drop("hub", "of").join(labels.select("id", F.col("component").alias("of")), "id", "left").withColumn("of", F.coalesce("of", "id")), "near-of")
    least = of.groupBy("key", "of").agg(F.min("id").alias("id"), F.count("*").alias("k"))
    two = least.groupBy("key").agg(F.min_by("of", "id").alias("of1"), F.min("id").alias("hub1"), F.max_by("of", "id").alias("of2"), F.max("id").alias("hub2"), F.sum("k").alias("k")).filter("of1 <> of2")
    held = spread_join(of, written(two, "near-two"), ["key"], "k", of.count())
    return held.select("key", "id", "n", "of", F.when(F.col("of") == F.col("of1"), F.col("hub2")).otherwise(F.col("hub1")).alias("hub"))


def _labelled(docs: DataFrame, words: int, percent: int, rows: int = SLICE_ROWS) -> DataFrame:
    """For every row: doc_id, n, component_id, kept, sig (null without shingles or doc_id); ``rows`` are sketched at once."""
    table = written(sketch_table(docs, words, rows), "near-sketches")
    some = table.filter("n > 0 and doc_id is not null")
    classes = written(some.groupBy("sig").agg(F.min("doc_id").alias("id"), F.count("*").alias("k")), "near-classes")
    reps = written(some.join(classes, (F.col("doc_id") == F.col("id")) & (some.sig == classes.sig), "left_semi").groupBy(F.col("doc_id").alias("id"), "n", "sig").agg(F.first("regs").alias("regs")).select("id", "n", "regs"), "near-reps")
    labels = near_links(docs, reps, words, percent)
    named = written(classes.join(labels, "id", "left").select("sig", F.coalesce("component", "id").alias("component_id"), "k"), "near-named")
    held = spread_join(some.select("doc_id", "n", "sig"), named, ["sig"], "k", some.count())
    # without shingles or doc_id a row is alone
    rest = table.filter("n = 0 or doc_id is null").select("doc_id", "n", F.lit(None).cast("binary").alias("sig"), F.lit(None).cast("long").alias("component_id"))
    own = F.coalesce("component_id", "doc_id")
    out = held.unionByName(rest)
    return out.select("doc_id", "n", own.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == own)).alias("kept"), "sig")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """For every row: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least doc_id that a text reaches over links of index ``percent`` / 100 or
    more. Null and empty texts and texts of blanks have no shingles and no links. Equal sets are
    one class. A row of a null doc_id takes no part: its component_id is null and it is kept. Rows
    that repeat a doc_id are each labelled by their own text; if such a doc_id is the least of
    several classes, it joins them. An empty table gives no rows; other columns are ignored.
    """
    return _labelled(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_duplicates`` keeps.

    Rows go by doc_id; where only some rows of a doc_id go, by the digest of their shingles too.
    Null and empty texts and rows of a null doc_id stay. An empty table stays empty; columns of
    any other name are kept and not read.
    """
    gone_id, some, every, sig, lost_sig = fresh(docs, "_gone_id", "_some", "_every", "_sig", "_lost_sig")
    labelled = written(_labelled(docs, words, percent, 2 * STAGE_ROWS).filter("doc_id is not null").select(F.col("doc_id").alias(gone_id), F.col("sig").alias(lost_sig), F.col("kept").alias(some)), "near-labels")
    gone = labelled.groupBy(gone_id).agg(F.bool_or(some).alias(some), F.bool_and(some).alias(every)).filter(~F.col(every)).select(gone_id, some)
    same = F.col("doc_id").cast("long") == F.col(gone_id)
    rest = docs.join(gone.select(gone_id), same, "left_anti")
    mixed = written(gone.filter(some).select(gone_id), "near-mixed")
    if mixed.isEmpty():
        return rest

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sigs = [hashlib.blake2b(shingles(t, words).tobytes(), digest_size=16).digest() for t in texts_of(part)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sigs, pa.binary())], names=[*part.schema.names, sig])

    partly = docs.join(mixed, same, "left_semi")
    lost = labelled.filter(~F.col(some)).select(gone_id, lost_sig).distinct()
    kept = partly.mapInArrow(signed, StructType([*docs.schema.fields, StructField(sig, BinaryType())])).join(lost, same & (F.col(sig) == F.col(lost_sig)), "left_anti").drop(sig)
    return rest.union(kept)
