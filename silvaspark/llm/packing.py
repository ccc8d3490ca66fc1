"""Documents packed into sequences of several context sizes, without a shuffle.

Each partition packs what it reads. A document gives whole windows of the longest size while it
can; its rest is routed to the smallest tier, a power of two, that holds it. Then each tier is
packed, the longest first: its longest rest opens a sequence of the tier's own size, and the gap
is filled with the longest rests of shorter tiers that fit, and what is left of the gap with a cut
from a short one. What cannot fill a sequence of its tier waits for the next documents; at the end
of a partition it is cut into sequences whose lengths are powers of two, so nothing is padded.

Sequences are dealt to step groups of the same number of tokens, whatever their sizes: the longest
and costliest first, each to the group of the least cost that has room. A group is closed only
when it is full; sequences beyond the last full group wait for the next ones.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .byte_tokens import MEMO_WORDS, tokens
from .common import STAGE_ROWS, release, slices, texts_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: Documents packed at once; what stays open goes on to the next.
BATCH_ROWS = 2048
#: Step groups that are balanced together.
POOL = 64

#: A packed sequence: its length, its cost, and its pieces as doc_id, start, length, crc32, the document's tokens, offset.
Sequence = tuple[int, int, list[tuple]]


class Rest:
    """What is not placed yet of a document: its ids from ``start`` on."""

    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id: int | None, ids: bytes, start: int, total: int):
        self.doc_id, self.ids, self.start, self.total = doc_id, ids, start, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, length: int) -> Rest:
        """The first ``length`` ids; the others stay."""
        piece = Rest(self.doc_id, self.ids[: 4 * length], self.start, self.total)
        self.ids, self.start = self.ids[4 * length :], self.start + length
        return piece


def sequence(pieces: list[Rest]) -> Sequence:
    """Pieces side by side; the cost is that of attention within each piece."""
    offset, cost, rows = 0, 0, []
    for p in pieces:
        n = len(p)
        rows.append((p.doc_id, p.start, n, zlib.crc32(p.ids), p.total, offset))
        offset, cost = offset + n, cost + n * n
    return offset, cost, rows


class Packer:
    """Packs documents into sequences of ``window`` ids and of each power of two down to ``least``."""

    def __init__(self, window: int = 1024, least: int = 256):
        if window & (window - 1) or least & (least - 1) or not 0 < least <= window:
            raise ValueError("context sizes are powers of two, the least no more than the window")
        self.window, self.least, self.count = window, least, 0
        self.sizes = [window >> k for k in range(window.bit_length()) if window >> k >= least]
        self.tiers: dict[int, list[tuple[int, int, Rest]]] = {size: [] for size in self.sizes}
        self.waiting = dict.fromkeys(self.sizes, 0)

    def tier(self, length: int) -> int:
        """The smallest context size that holds ``length`` ids."""
        return max(self.least, 1 << (length - 1).bit_length())

    def route(self, rest: Rest) -> None:
        self.count += 1
        size = self.tier(len(rest))
        insort(self.tiers[size], (len(rest), self.count, rest))
        self.waiting[size] += len(rest)

    def pop(self, size: int, at: int) -> Rest:
        n, _, rest = self.tiers[size].pop(at)
        self.waiting[size] -= n
        return rest

    def take(self, gap: int, most: int) -> Rest:
        """From the tiers up to ``most``: the longest rest that fits a gap, of the longest tier that has one; else a cut of the shortest rest."""
        below = [size for size in self.sizes if size <= most]
        for size in below:
            if at := bisect_right(self.tiers[size], (gap, float("inf"))):
                return self.pop(size, at - 1)
        size = next(size for size in reversed(below) if self.tiers[size])
        rest = self.pop(size, 0)
        piece = rest.cut(gap)
        self.route(rest)
        return piece

    def pack(self, documents: Iterator[tuple[int | None, bytes]]) -> Iterator[Sequence]:
        """The sequences that the documents fill, tier after tier; what fills none waits."""
        for doc_id, ids in documents:
            rest = Rest(doc_id, ids, 0, len(ids) // 4)
            while len(rest) >= self.window:
                yield sequence([rest.cut(self.window)])
            if len(rest):
                self.route(rest)
        for size in self.sizes:
            while self.tiers[size] and sum(n for s, n in self.waiting.items() if s <= size) >= size:
                pieces = [self.pop(size, -1)]
                gap = size - len(pieces[0])
                while gap:
                    pieces.append(self.take(gap, size))
                    gap -= len(pieces[-1])
                yield sequence(pieces)

    def last(self) -> Iterator[Sequence]:
        """What waits, cut into sequences whose lengths are powers of two."""
        left = [rest for size in self.sizes for _, _, rest in reversed(self.tiers[size])]
        self.__init__(self.window, self.least)
        total = sum(map(len, left))
        while total:
            size = room = min(self.window, 1 << (total.bit_length() - 1))
            pieces = []
            while room:
                pieces.append(left.pop(0) if len(left[0]) <= room else left[0].cut(room))
                room -= len(pieces[-1])
            yield sequence(pieces)
            total -= size


def balanced(sequences: list[Sequence], n: int, room: int) -> list[int]:
    """A group, 0 to n - 1, for each sequence: at most ``room`` tokens each, sizes spread evenly, costs as even as they can be.

    The longest and costliest first, each to the group of the fewest tokens and then of the least
    cost. Lengths are powers of two, so all fit if their sum does.
    """
    groups, of = [(0, 0, k) for k in range(n)], [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: (-sequences[i][0], -sequences[i][1], i)):
        size, cost, k = heapq.heappop(groups)
        of[i] = k
        heapq.heappush(groups, (size + sequences[i][0], cost + sequences[i][1], k))
    return of


def chosen(sequences: list[Sequence], room: int) -> tuple[list[Sequence], list[Sequence]]:
    """Sequences of ``room`` tokens together, of every size in proportion, and the others."""
    places: dict[int, list[int]] = {}
    for i, (size, _, _) in enumerate(sequences):
        places.setdefault(size, []).append(i)
    share = {i: k / len(of) for of in places.values() for k, i in enumerate(of)}
    taken, full = set(), 0
    for i in sorted(share, key=lambda i: (share[i], i)):
        if full + sequences[i][0] <= room:
            full += sequences[i][0]
            taken.add(i)
    return [s for i, s in enumerate(sequences) if i in taken], [s for i, s in enumerate(sequences) if i not in taken]


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, least: int = 256, step: int = 16, end_id: int = 0, keep: int = MEMO_WORDS) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` ids and of shorter tiers: the columns of ``SCHEMA``.

    Every id of a document and its end id lies in one piece. ``tier`` is the length of the
    sequence; those below ``least`` come from the end of a partition. A step group holds
    ``step * window`` tokens, less only where a partition ends. ``sequence_id`` and ``step_group``
    carry the partition in their upper bits, so they are unique and no count is needed first; a
    partition read again gives the same rows.

    Memory holds a slice of documents, or one longer document, and the numbers of ``2 * POOL``
    step groups. Null texts are empty and have the end id only; rows with equal or null doc_id are
    documents of their own; an empty table gives no rows; other columns are not read.
    """
    if step & (step - 1):
        raise ValueError("the sequences of a step are a power of two")
    room = step * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokens(tokenizer_path) if keep == MEMO_WORDS else tokens(tokenizer_path, keep), Packer(window, least)
        end = end_id.to_bytes(4, "little")
        context = TaskContext.get()
        high = (context.partitionId() if context else 0) << 40
        pending: list[Sequence] = []
        held = next_sequence = next_group = 0

        def rows(done: list[Sequence], n: int) -> pa.RecordBatch:
            nonlocal next_sequence, next_group
            out = []
            for k, ((size, _, pieces), group) in enumerate(zip(done, balanced(done, n, room), strict=True)):
                for doc_id, start, length, crc, total, offset in pieces:
                    out.append((doc_id, start, length, crc, total, high + next_sequence + k, offset, size, high + next_group + group))
            next_sequence, next_group = next_sequence + len(done), next_group + n
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in slices(batches, BATCH_ROWS):
            texts, most = texts_of(batch), BATCH_ROWS if keep == MEMO_WORDS else STAGE_ROWS
            coded = [c for k in range(0, len(texts), most) for c in encoder.encode(texts[k : k + most])]
            for one in packer.pack(zip(batch.column("doc_id").to_pylist(), (c + end for c in coded), strict=True)):
                pending.append(one)
                held += one[0]
                if held >= 2 * POOL * room:
                    now, pending = chosen(pending, POOL * room)
                    held = sum(s[0] for s in pending)
                    yield rows(now, POOL)
        for one in packer.last():
            pending.append(one)
            held += one[0]
        if pending:
            yield rows(pending, -(-held // room))
        if keep != MEMO_WORDS:  # words are kept between tasks for the whole memory only; a stage of a chain leaves nothing behind but the library
            encoder.forget()
            release()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)
