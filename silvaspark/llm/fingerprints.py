"""Fingerprints of documents: invertible Bloom lookup tables of paragraph digests.

A text is cut after line feeds, and within paragraphs after spaces chosen by the letters before
them, so that an edit spoils only the stretches that it touches. The stretches hold every byte,
separators too. Each stretch, with the number of its occurrence, gives a 64-bit digest; a table
adds it to one cell in each of three parts: a count, the sum of digests and the sum of their
checks.

A fingerprint is a table with cells for all digests of its text, so peeling the cells that hold
one digest lists them; where it does not, the table is made anew with more cells. Two
fingerprints are compared by themselves, without their texts: the smaller is peeled and put into
as many cells as the larger has, the tables are subtracted, and the difference, which holds only the
digests that differ, is peeled. Where that stops short, both are tried again with more cells.

From the counts and the recovered digests follows the likeness, the Jaccard index of the digests.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, range_bucket, slices, texts_of, tie
from .hashing import mix, stretches

#: The least cells of a table, in three parts; cells for each digest; the factor of a retry.
CELLS, FOR_EACH, GROWTH = 24, 1.5, 2
#: Of eight spaces one ends a stretch; the least bytes between two such, the most of a stretch.
LEAST, MOST = 24, 256


def digests(text: str) -> np.ndarray:
    """The digests of a text's stretches, different for each occurrence; none for an empty text."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    feeds = np.flatnonzero(data == 10)
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[spaces >= 3]
    wide = data.astype(np.uint32)
    chosen = spaces[(wide[spaces - 1] * 31 + wide[spaces - 2] * 17 + wide[spaces - 3] * 7) % 8 == 0]
    bounds = np.concatenate([[-1], feeds, [len(data)]])
    cuts = np.unique(np.concatenate([bounds, chosen]))
    close = np.concatenate([[False], np.diff(cuts) < LEAST])
    cuts = cuts[~close | np.isin(cuts, bounds)]
    # a stretch holds the separator that ends it; the text's end is none
    edges = np.unique(np.minimum(cuts + 1, len(data)))
    over = np.flatnonzero(np.diff(edges) > MOST)
    if len(over):
        edges = np.concatenate([edges, *[np.arange(edges[i] + MOST, edges[i + 1], MOST) for i in over]])
        edges.sort()
    starts, ends = edges[:-1], edges[1:]
    found = np.sort(stretches(data, starts, ends))
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, int)
    nth = np.arange(len(found)) - np.repeat(first, np.diff(np.concatenate([first, [len(found)]])))
    return np.unique(mix(found + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


def checks(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def cells_for(n: int) -> int:
    """The cells of a table of ``n`` digests, a multiple of three."""
    return 3 * (CELLS // 3 + int(n * FOR_EACH) // 3)


class Tables:
    """Tables of several texts, each with cells of its own, one after the other; sums wrap around."""

    def __init__(self, cells: np.ndarray):
        self.cells = np.asarray(cells, np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.cells)])
        n = int(self.start[-1])
        self.count, self.key, self.check = np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint32)

    def add(self, of: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        """Add digests, each to the table it is ``of``; a sign of -1 takes away."""
        sign = np.broadcast_to(np.asarray(sign, np.int32), keys.shape)
        wide, check = sign.astype(np.int64).view(np.uint64), sign.view(np.uint32)
        part, start = (self.cells[of] // 3).astype(np.uint64), self.start[of]
        for k in range(3):
            at = ((mix(keys + np.uint64(k * 0x9E3779B9 + 1)) >> np.uint64(16)) % part + np.uint64(k) * part).astype(np.int64) + start
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, keys * wide)
            np.add.at(self.check, at, checks(keys) * check)

    def text(self, i: int, size: int) -> str:
        """A table as a string: the numbers of digests and of cells, then counts, sums and checks."""
        at = slice(self.start[i], self.start[i + 1])
        return base64.b64encode(np.array([size, self.cells[i]], "<u4").tobytes() + self.count[at].astype("<i4").tobytes() + self.key[at].astype("<u8").tobytes() + self.check[at].astype("<u4").tobytes()).decode()

    def peel(self) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Recover what the tables hold: the digests added to and taken from each, and whether it was emptied."""
        of_cell = np.repeat(np.arange(len(self.cells)), self.cells)
        tables, keys, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        look = np.arange(len(self.count))
        while len(look):
            at = look[np.abs(self.count[look]) == 1]
            sign = self.count[at]
            key = self.key[at] * sign.astype(np.int64).view(np.uint64)
            pure = self.check[at] * sign.view(np.uint32) == checks(key)
            of, key, sign = of_cell[at[pure]], key[pure], sign[pure]
            if not len(of):
                break
            order = np.lexsort((key, of))
            of, key, sign = of[order], key[order], sign[order]
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])])
            of, key, sign = of[new], key[new], sign[new]
            self.add(of, key, -sign)
            tables.append(of)
            keys.append(key)
            signs.append(sign)
            look = np.flatnonzero(self.count)
        left = np.flatnonzero((self.count != 0) | (self.key != 0) | (self.check != 0))
        empty = np.ones(len(self.cells), bool)
        empty[of_cell[left]] = False
        of, key, sign = np.concatenate(tables), np.concatenate(keys), np.concatenate(signs)
        order = np.lexsort((key, of))
        of, key, sign = of[order], key[order], sign[order]
        ends = np.searchsorted(of, np.arange(len(self.cells) + 1))
        parts = [(key[a:b], sign[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        return [k[s > 0] for k, s in parts], [k[s < 0] for k, s in parts], empty


def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The digests of all texts and the text of each."""
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists) if lists else np.zeros(0, np.uint64)


class Prints:
    """Fingerprints: the number of digests, the cells, and the digests that the table peels to."""

    def __init__(self, sizes: list[int], cells: list[int], listed: list[np.ndarray], texts: list[str]):
        self.sizes, self.cells, self.listed, self.texts = sizes, cells, listed, texts

    @staticmethod
    def of(lists: list[np.ndarray]) -> Prints:
        """Tables of lists of digests, each with as many cells as it takes to peel it."""
        n = len(lists)
        cells, listed, texts = [cells_for(len(x)) for x in lists], [np.zeros(0, np.uint64)] * n, [""] * n
        todo = list(range(n))
        while todo:
            tables = Tables(np.array([cells[i] for i in todo]))
            tables.add(*flat([lists[i] for i in todo]))
            for k, i in enumerate(todo):
                texts[i] = tables.text(k, len(lists[i]))
            got, _, empty = tables.peel()
            for k, i in enumerate(todo):
                listed[i] = got[k]
            todo = [i for k, i in enumerate(todo) if not empty[k]]
            for i in todo:
                cells[i] *= GROWTH
        return Prints([len(x) for x in lists], cells, listed, texts)

    @staticmethod
    def read(texts: list[str]) -> Prints:
        """Fingerprints from their strings."""
        sizes, cells, parts = [], [], []
        for text in texts:
            raw = base64.b64decode(text)
            size, n = np.frombuffer(raw, "<u4", 2).tolist()
            sizes.append(size)
            cells.append(n)
            parts.append((np.frombuffer(raw, "<i4", n, 8), np.frombuffer(raw, "<u8", n, 8 + 4 * n), np.frombuffer(raw, "<u4", n, 8 + 12 * n)))
        tables = Tables(np.array(cells, np.int64))
        if parts:
            tables.count, tables.key, tables.check = (np.concatenate(x).astype(t) for x, t in zip(zip(*parts, strict=True), (np.int32, np.uint64, np.uint32), strict=True))
        return Prints(sizes, cells, tables.peel()[0], list(texts))

    def pick(self, at: slice) -> Prints:
        return Prints(self.sizes[at], self.cells[at], self.listed[at], self.texts[at])


def differences(left: Prints, right: Prints) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of fingerprints the digests of the left and of the right alone, by subtracting and peeling."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64),) * 2] * len(left.sizes)
    cells = [max(a, b) for a, b in zip(left.cells, right.cells, strict=True)]
    todo = list(range(len(cells)))
    while todo:
        tables = Tables(np.array([cells[i] for i in todo]))
        tables.add(*flat([left.listed[i] for i in todo]))
        tables.add(*flat([right.listed[i] for i in todo]), -1)
        mine, other, empty = tables.peel()
        for k, i in enumerate(todo):
            found[i] = mine[k], other[k]
        todo = [i for k, i in enumerate(todo) if not empty[k]]
        for i in todo:
            cells[i] *= GROWTH
    return found


def likenesses(left: Prints, right: Prints, apart: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[float]:
    """The likeness of each pair of fingerprints."""
    apart = differences(left, right) if apart is None else apart
    return [likeness(a, b, len(x) + len(y)) for a, b, (x, y) in zip(left.sizes, right.sizes, apart, strict=True)]


def likeness(a: int, b: int, differ: int) -> float:
    """The Jaccard index of two sets of digests from their sizes and the number that differ; 1 for two empty ones."""
    return (a + b - differ) / (a + b + differ) if a + b else 1.0


def compare(docs: DataFrame, with_digests: bool = False) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next;
    ``with_digests`` adds edited_from and edited_to, the digests that the edit took and brought.
    Both likenesses come from the fingerprints alone, as ``likenesses`` of their strings does. The
    next document is the next lower doc_id, after the last the first. For it texts are dealt
    out once by ranges of doc_id and sorted; each range also gets the first text of the range
    below, found by one aggregate: one number and hash for a range.

    Null texts are empty; empty texts have no digests and are alike (1.0). Rows of the same doc_id
    follow each other by a hash of their text; a null doc_id is the lowest. A single row is its
    own next. An empty table gives no rows; other columns are ignored. A text is held whole;
    memory is bounded by a slice of texts (``SLICE_BYTES``) or one longer text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket, n = range_bucket(rows, "doc_id", partitions(spark))
    rows = rows.withColumn("tie", tie()).withColumn("part", bucket).withColumn("halo", F.lit(0))
    first = F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("order"), "tie", "doc_id")).alias("top")
    tops = [(r["part"], r["top"]["doc_id"], r["top"]["tie"]) for r in rows.groupBy("part").agg(first).orderBy("part").collect()]
    below = spark.createDataFrame([(part, *tops[k - 1][1:]) for k, (part, _, _) in enumerate(tops)], "to int, top long, top_tie long")
    same = F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("tie") == F.col("top_tie"))
    # a row for each range, whatever number of equal rows there is
    firsts = rows.join(F.broadcast(below), same).groupBy("to").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.min("tie").alias("tie"))
    firsts = firsts.select("doc_id", "text", "tie", F.col("to").alias("part"), F.lit(1).alias("halo"))
    dealt = rows.select("doc_id", "text", "tie", "part", "halo").union(firsts).repartitionById(n, F.col("part")).sortWithinPartitions("halo", F.desc_nulls_last("doc_id"), F.desc("tie"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + ", edited_from array<string>, edited_to array<string>" * with_digests

    def compared(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
        """Rows of all texts but the last, which is only the next of the one before."""
        edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:], strict=False)]
        whole, new = Prints.of([digests(t) for t in texts]), Prints.of([digests(t) for t in edited])
        own, after = whole.pick(slice(0, -1)), whole.pick(slice(1, None))
        apart = differences(own, new)
        columns = [pa.array(ids[: len(edited)], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(own.texts), pa.array(new.texts), pa.array(likenesses(own, new, apart)), pa.array(likenesses(own, after))]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        if with_digests:
            columns += [pa.array([[f"{d:016x}" for d in x[side]] for x in apart], pa.list_(pa.string())) for side in (0, 1)]
            names += ["edited_from", "edited_to"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        for batch in slices(batches):
            halo = batch.column("halo").to_pylist()
            mine = halo.index(1) if 1 in halo else len(halo)
            new_ids, new = batch.column("doc_id").to_pylist(), texts_of(batch)
            ids, texts = ids + new_ids[:mine], texts + new[:mine]
            if mine < len(halo):
                if ids:
                    yield compared(ids, [*texts, new[mine]])
                return
            if len(texts) > 1:
                yield compared(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]

    return dealt.select("doc_id", "text", "halo").mapInArrow(run, schema)
