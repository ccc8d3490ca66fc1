"""Byte-pair pieces of a sentencepiece model, by one table over the prefixes of a text.

For merges in a strict order of rank, the encoding of every prefix ends in one token only: of
the vocabulary's pieces that end there, the one that stays apart from the last token of the
prefix before it. An automaton lists the pieces that end at each place, a test of token pairs
picks the one, and the table keeps it with the exact token count. Ids are read backwards.

Pieces never span the end of a run of spaces, nor a line feed, so the table restarts there and
the parts of a text, mostly words, are independent. Many new words go through the table at once:
the automaton steps on all places together, and the pair test is made for all words that have a
piece ending at the same place. The pieces of spaces alone share one lowest score, so their order
depends on the place too; the pair test does not hold for them. Runs of spaces are merged from
the left, after what follows the run.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import Kept, map_slices, texts_of, word_table

SPACE = "▁"
#: Words whose encodings a task keeps; words of more characters go through the table one by one.
MEMO_WORDS, LONG, CHUNK = 800_000, 48, 4_096
#: Token pairs whose test a task keeps, one by one and for many words at once (a power of two).
MEMO_PAIRS, PAIR_PLACES = 1_000_000, 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Hashed:
    """A table of integers by integers of 0 or more, looked up many at once; -1 for an unknown key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        todo, at = np.arange(len(keys)), self.home(keys)
        while len(todo):
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= self.keys[at] < 0
            self.keys[at[first]], self.values[at[first]] = keys[todo[first]], values[todo[first]]
            todo, at = todo[~first], (at[~first] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.home(keys)
        here = self.keys[at]
        found = np.where(here == keys, self.values[at], -1)
        todo = np.flatnonzero((here != keys) & (here >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            here = self.keys[at[todo]]
            hit = here == keys[todo]
            found[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (here >= 0)]
        return found


class PieceTable:
    """The tokens of a model at ``path``: counts of every prefix, ids, and decoding."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids, self.ids, self.rank = {}, {}, {}
        self.raw = [b""] * size
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value], self.raw[i] = i, bytes([value])
            elif model.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.ids[piece], self.rank[piece] = i, -model.get_score(i)
                self.raw[i] = piece.replace(SPACE, " ").encode()
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces of the model span spaces or line feeds")
        self.newline = self.raw_ids("\n")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or piece.strip(SPACE):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.widest = 0
        self.learn_runs()
        self.learn()
        self.learn_steps()

    def raw_ids(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def merged(self, text: str) -> list[str]:
        """The pieces that the merge queue leaves of ``text``: best score first, then leftmost."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (rank := self.rank.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(queue, (rank, a, b, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, both = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or parts[a] + parts[b] != both or after[a] != b:
                continue
            parts[a], parts[b] = both, None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes a token; None for one that merges never make.

        Only halves that rank before it count; ``odd`` and ``never`` hold tokens without such.
        """
        piece, last = self.pieces[token], None
        for cut_at in range(1, len(piece)):
            left, right = self.ids.get(piece[:cut_at]), self.ids.get(piece[cut_at:])
            if left is None or right is None or max(self.order[left], self.order[right]) >= self.order[token]:
                continue
            if self.met(left, right, self.order[token]):
                last = (left, right)
                break
        return last

    def met(self, left: int, right: int, limit: float) -> bool:
        """Whether two tokens both come about, side by side, with no merge across before ``limit``.

        From the end backwards: a merge across the border that ranks before the youngest of the
        two edge tokens would have come first; else that token is undone, and its half next to
        the border is looked at. Of equal merges the one further left comes first.
        """
        order, halves, joined = self.order, self.halves, self.joined
        while True:
            across = joined.get(left * 65_536 + right)
            if across is not None and order[across] < limit:
                return False
            if order[left] > order[right]:
                limit = order[left]
                left = halves[left][1]
            elif order[right] >= 0:
                limit = order[right] + 0.5
                right = halves[right][0]
            else:
                return True

    def learn(self) -> None:
        """Halves of all tokens, in the order of their ranks; characters are whole, at order -1."""
        size = len(self.pieces)
        self.order: list[float] = [-1.0] * size
        self.halves: list[tuple[int, int]] = [(-1, -1)] * size
        self.joined: dict[int, int] = {}
        self.reached = [False] * size
        made = sorted((i for p, i in self.ids.items() if len(p) > 1 and p.strip(SPACE)), key=lambda i: self.rank[self.pieces[i]])
        for place, i in enumerate(made):
            self.order[i] = float(place)
        for i in made:
            piece = self.pieces[i]
            for at in range(1, len(piece)):
                left, right = self.ids.get(piece[:at]), self.ids.get(piece[at:])
                if left is not None and right is not None:
                    self.joined[left * 65_536 + right] = i
        for i in self.ids.values():
            self.reached[i] = len(self.pieces[i]) == 1
        odd = []
        for i in made:
            halves = self.split(i)
            if halves and self.reached[halves[0]] and self.reached[halves[1]]:
                self.halves[i], self.reached[i] = halves, True
            else:
                odd.append(i)
        #: Tokens out of the order of ranks, or that merges never make; pairs with them go through the queue.
        self.odd = frozenset(i for i in odd if len(self.merged(self.pieces[i])) == 1)
        self.never = frozenset(odd) - self.odd

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are encoded as these two."""
        key = left * 65_536 + right if left >= 0 else -right - 1
        known = self.pairs.get(key)
        if known is None:
            if right in self.never:
                known = False
            elif left < 0:
                known = True
            elif left in self.odd or right in self.odd:
                a, b = self.pieces[left], self.pieces[right]
                known = self.merged(a + b) == [a, b]
            else:
                known = self.met(left, right, float("inf"))
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def learn_steps(self) -> None:
        """The trie, halves and joins as tables for many words at once."""
        letters = sorted({c for p in self.ids for c in p})
        self.letter = np.zeros(0x110000, np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        steps, tokens = {}, [-1]
        for piece, i in self.ids.items():
            if len(piece) > 1 and not piece.strip(SPACE):
                continue
            node = 0
            for c in piece:
                key = node * self.width + int(self.letter[ord(c)])
                if key not in steps:
                    steps[key] = len(tokens)
                    tokens.append(-1)
                node = steps[key]
            tokens[node] = i
        table = lambda d: Hashed(np.array(list(d), np.int64), np.array(list(d.values()), np.int64))
        self.steps, self.joins, self.token_at = table(steps), table(self.joined), np.array(tokens)
        self.orders, self.half = np.array(self.order), np.array(self.halves)
        self.pair_keys, self.pair_apart = np.full(PAIR_PLACES, -1, np.int64), np.zeros(PAIR_PLACES, bool)
        self.pair_shift = np.uint64(65 - PAIR_PLACES.bit_length())

    def met_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``met`` for many pairs, without a limit."""
        good, at, limit = np.zeros(len(left), bool), np.arange(len(left)), np.full(len(left), np.inf)
        while len(at):
            across = self.joins[left * 65_536 + right]
            on = (across < 0) | (self.orders[across] >= limit)
            at, left, right = at[on], left[on], right[on]
            order_left, order_right = self.orders[left], self.orders[right]
            later = order_left > order_right
            done = ~later & (order_right < 0)
            good[at[done]] = True
            limit = np.where(later, order_left, order_right + 0.5)
            left, right = np.where(later, self.half[left, 1], left), np.where(later, right, self.half[right, 0])
            at, left, right, limit = at[~done], left[~done], right[~done], limit[~done]
        return good

    def apart_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``apart`` for many pairs, if no token is odd or never made; tests are kept in a table of fixed size."""
        key = left * 65_536 + right
        place = ((key.astype(np.uint64) * _SPREAD) >> self.pair_shift).astype(np.int64)
        good = self.pair_apart[place]
        new = np.flatnonzero((left >= 0) & (self.pair_keys[place] != key))
        if len(new):
            fresh, of = np.unique(key[new], return_inverse=True)
            found = self.met_many(fresh >> 16, fresh & 65_535)[of]
            good[new] = found
            self.pair_keys[place[new]], self.pair_apart[place[new]] = key[new], found
            # of two pairs with one place either may have stayed, so key and test are set once more
            self.pair_apart[place[new]] = np.where(self.pair_keys[place[new]] == key[new], found, self.pair_apart[place[new]])
        good[left < 0] = True
        return good

    def prefixes_many(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """``prefixes`` of many parts: last tokens, lengths, counts, one part after the other, and where each part starts."""
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.array([len(p) for p in parts], np.int64)
        start = np.concatenate([[0], np.cumsum(lengths)])
        of = np.repeat(np.arange(len(parts)), lengths)
        letters, end = self.letter[points], start[1:][of]
        begin, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        at, found = begin, []
        while len(begin):
            node = self.steps[node * self.width + letters[at]]
            on = node >= 0
            begin, node, at = begin[on], node[on], at[on] + 1
            token = self.token_at[node]
            hit = token >= 0
            found.append((begin[hit], at[hit], token[hit]))
            on = at < end[begin]
            begin, node, at = begin[on], node[on], at[on]
        begin, at, token = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        part = of[begin]
        place = at - start[part]
        order = np.argsort(place.astype(np.uint8 if lengths.max(initial=0) < 256 else np.int64), kind="stable")
        begin, at, token, part = begin[order], at[order], token[order], part[order]
        bounds = np.searchsorted(place[order], np.arange(1, lengths.max(initial=0) + 2))
        first, last_of = begin + part, at + part  # a part of n characters has n + 1 prefixes
        size_of = (at - begin).astype(np.int64)
        n = len(points) + len(parts)
        last, size, count = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        n_bytes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        longest = np.argsort(-lengths, kind="stable")
        heads, ranked = (start[:-1] + np.arange(len(parts)))[longest], -lengths[longest]
        for k in range(1, len(bounds)):
            rows = slice(bounds[k - 1], bounds[k])
            fits = self.apart_many(last[first[rows]], token[rows])
            to = last_of[rows][fits]
            last[to], size[to], count[to] = token[rows][fits], size_of[rows][fits], count[first[rows][fits]] + 1
            these = np.searchsorted(ranked, -k, "right")
            raw = heads[:these] + k
            raw = raw[size[raw] == 0]
            if len(raw):
                where = raw - 1 - np.searchsorted(start[:-1] + np.arange(len(parts)), raw - 1, "right") + 1
                size[raw], count[raw] = 1, count[raw - 1] + n_bytes[where]
        return last, size, count, start[:-1] + np.arange(len(parts))

    def backwards_many(self, parts: list[str], last: np.ndarray, size: np.ndarray, count: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many parts, one after the other, and where each part's ids start."""
        at = heads + np.array([len(p) for p in parts], np.int64)
        start = np.concatenate([[0], np.cumsum(count[at])])
        out, todo = np.zeros(start[-1], np.int64), np.flatnonzero(at > heads)
        while len(todo):
            here = at[todo]
            token = last[here]
            place = start[todo] + count[here]
            made = token >= 0
            out[place[made] - 1] = token[made]
            for i in np.flatnonzero(~made).tolist():
                ids = self.raw_ids(parts[todo[i]][here[i] - heads[todo[i]] - 1])
                out[place[i] - len(ids) : place[i]] = ids
            at[todo] = here - size[here]
            todo = todo[at[todo] > heads[todo]]
        return out, start

    def prefixes(self, part: str) -> tuple[list[int], list[int], list[int]]:
        """Of every prefix of a part: its last token (-1: a character as bytes), that token's length, its count."""
        n = len(part)
        last, size, count = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        apart, known = self.apart, self.pairs.get
        seen = 0  # places before this are done
        for end, (token, length) in self.automaton.iter(part):
            end += 1
            while seen < end - 1:
                seen += 1
                if not size[seen]:
                    size[seen], count[seen] = 1, count[seen - 1] + len(part[seen - 1].encode())
            if size[end]:
                continue
            start = end - length
            before = last[start]
            fits = known(before * 65_536 + token if before >= 0 else -token - 1)
            if fits or fits is None and apart(before, token):
                last[end], size[end], count[end] = token, length, count[start] + 1
        while seen < n:
            seen += 1
            if not size[seen]:
                size[seen], count[seen] = 1, count[seen - 1] + len(part[seen - 1].encode())
        return last, size, count

    def backwards(self, part: str, last: list[int], size: list[int]) -> list[int]:
        found: list[int] = []
        i = len(part)
        while i:
            found += [last[i]] if last[i] >= 0 else self.raw_ids(part[i - 1])[::-1]
            i -= size[i]
        return found[::-1]

    def learn_runs(self) -> None:
        """The pieces of runs of spaces: merged from the left, so widest pieces and then those of a short rest.

        Holds where the pieces rank the same; else ``widest`` stays 0 and the queue is asked.
        """
        sizes = [k for k in range(1, max(map(len, self.ids)) + 1) if SPACE * k in self.ids]
        merged = [[self.ids[p] for p in self.merged(SPACE * n)] for n in range(4 * sizes[-1])]
        if all(merged[n] == [self.ids[SPACE * sizes[-1]]] * (n // sizes[-1]) + merged[n % sizes[-1]] for n in range(len(merged))) and len({self.rank[SPACE * k] for k in sizes[1:]}) < 2:
            self.widest, self.rests = sizes[-1], merged[: sizes[-1]]

    def run_ids(self, n: int) -> list[int]:
        """The ids of ``n`` spaces with nothing after them."""
        if not self.widest:
            return [self.ids[p] for p in self.merged(SPACE * n)]
        return [self.ids[SPACE * self.widest]] * (n // self.widest) + self.rests[n % self.widest]

    def run_counts(self, n: int) -> list[int]:
        """The tokens of 1 to ``n`` spaces."""
        if not self.widest:
            return [len(self.run_ids(k)) for k in range(1, n + 1)]
        return [k // self.widest + len(self.rests[k % self.widest]) for k in range(1, n + 1)]

    def part_ids(self, part: str) -> list[int]:
        """The ids of a part with one space at most, at its start, and no line feed."""
        last, size, _ = self.prefixes(part)
        return self.backwards(part, last, size)

    def word_ids(self, word: str) -> list[int]:
        """The ids of a word as ``words`` gives it."""
        if word[:1] == "\n":
            return self.newline + (self.part_ids(word[1:]) if len(word) > 1 else [])
        return self.part_ids(SPACE + word)

    def word_counts(self, word: str) -> Sequence[int]:
        """The token counts of the prefixes of a word and the space or line feed before it, from the first character on."""
        if word[:1] != "\n":
            return self.prefixes(SPACE + word)[2][1:]
        feed = len(self.newline)
        return [feed] + [feed + c for c in self.prefixes(word[1:])[2][1:]]

    def chunks(self, words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """The places and parts of the words that go through the table together, as many as the processor's cache holds."""
        short = [] if self.odd or self.never else [i for i, w in enumerate(words) if len(w) <= LONG]
        for k in range(0, len(short), CHUNK):
            part = short[k : k + CHUNK]
            yield part, [words[i][1:] if words[i][:1] == "\n" else SPACE + words[i] for i in part]

    def many_ids(self, words: list[str]) -> list[list[int]]:
        """``word_ids`` of many words."""
        found: list = [None] * len(words)
        for short, parts in self.chunks(words):
            ids, start = self.backwards_many(parts, *self.prefixes_many(parts))
            ids, start = ids.tolist(), start.tolist()
            for i, a, b in zip(short, start, start[1:], strict=False):
                found[i] = self.newline + ids[a:b] if words[i][:1] == "\n" else ids[a:b]
        return [self.word_ids(w) if f is None else f for f, w in zip(found, words, strict=True)]

    def many_counts(self, words: list[str]) -> list[Sequence[int]]:
        """``word_counts`` of many words; bytes where the counts are small."""
        found: list = [None] * len(words)
        for short, parts in self.chunks(words):
            _, _, count, heads = self.prefixes_many(parts)
            feeds = np.repeat([len(self.newline) * (words[i][:1] == "\n") for i in short], [len(p) + 1 for p in parts])
            flat = (count + feeds).astype(np.uint8).tobytes()  # at most 49 characters of 4 bytes, and a line feed
            for i, a, p in zip(short, heads.tolist(), parts, strict=True):
                found[i] = flat[a + (words[i][:1] != "\n") : a + len(p) + 1]
        return [np.array(self.word_counts(w), np.int64) if f is None else f for f, w in zip(found, words, strict=True)]

    @staticmethod
    def spaced(text: str) -> str:
        """The text with a space before each line feed, so that its words lie between spaces."""
        return text.replace(SPACE, " ").replace("\n", " \n")

    @staticmethod
    def has_runs(text: str) -> bool:
        """Whether some spaces of a text, with the one that encoding puts first, stand side by side."""
        return text[:1] in (" ", SPACE) or "  " in text.replace(SPACE, " ")

    def runs(self, words: list[str]) -> list[tuple[int, int]]:
        """The words of a text with its runs: spaces beyond the one of the word after them, and the word's place.

        A run without a word after it (before a line feed, at the end) has the place -1; the empty
        word, of one space, is such a run.
        """
        found, blanks = [], 0
        for i, word in enumerate(words):
            if word == "":
                blanks += 1
                continue
            if word[0] == "\n":
                if blanks:
                    found.append((blanks, -1))
                blanks = 0
            found.append((blanks, i))
            blanks = 0
        if blanks:
            found.append((blanks, -1))
        return found

    def run_and_ids(self, blanks: int, ids: list[int]) -> list[int]:
        """The ids of a run and of the word after it, which has the last space if its first piece has letters."""
        if ids[0] == self.ids[SPACE]:
            return self.run_ids(blanks + 1) + ids[1:]
        return self.run_ids(blanks) + ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        if not text:
            return []
        words = self.spaced(text).split(" ")
        if not self.has_runs(text):
            return [i for w in words for i in self.word_ids(w)]
        out: list[int] = []
        for blanks, at in self.runs(words):
            ids = self.word_ids(words[at]) if at >= 0 else []
            out += self.run_and_ids(blanks, ids) if blanks and ids else self.run_ids(blanks) if blanks else ids
        return out

    def run_and_counts(self, blanks: int, word: str, counts: Sequence[int]) -> list[int]:
        """The token counts of the prefixes of a run and of the word after it."""
        run = self.run_counts(blanks + 1)
        last, size, _ = self.prefixes(SPACE + word)
        alone, out = [0] * len(size), list(run)  # alone: whether the prefix starts with the lone space
        for i in range(1, len(size)):
            alone[i] = (last[i] == self.ids[SPACE] and size[i] == 1) if i == size[i] else alone[i - size[i]]
            if i > 1:
                out.append(counts[i - 1] - 1 + run[blanks] if alone[i] else counts[i - 1] + run[blanks - 1])
        return out

    def prefix_table(self, text: str) -> PrefixTable:
        """The stored token counts of all prefixes of ``text``."""
        words = self.spaced(text).split(" ") if text else []
        return self.table_of(words, [self.word_counts(w) for w in words], self.has_runs(text))

    def table_of(self, words: list[str], counts: list[Sequence[int]], has_runs: bool) -> PrefixTable:
        """A prefix table from the words of a text and their counts."""
        if not has_runs:
            return PrefixTable(counts)
        parts: list[Sequence[int]] = []
        for blanks, at in self.runs(words):
            if at < 0:
                parts.append(self.run_counts(blanks))
            elif blanks:
                parts.append(self.run_and_counts(blanks, words[at], counts[at]))
            else:
                parts.append(counts[at])
        return PrefixTable(parts)

    def prefix_counts(self, text: str) -> np.ndarray:
        """The token counts of all prefixes of ``text``, from the empty one to the whole text."""
        return self.prefix_table(text).counts()

    def fits(self, text: str, budget: int) -> int:
        """The length of the longest prefix, in code points, with at most ``budget`` tokens."""
        return self.prefix_table(text).fits(budget)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space before the first piece goes."""
        return self.decoded([self.raw[i] for i in ids]).decode("utf-8", "replace")

    @staticmethod
    def decoded(parts: list[bytes]) -> bytes:
        joined = b"".join(parts)
        return joined[1:] if joined[:1] == b" " else joined


class PrefixTable:
    """Exact token counts of every prefix of a text, stored once and asked any number of times.

    Kept by parts that are encoded apart, each with the counts of its own prefixes, which texts
    with the same word share; the sums up to each part are the text's own. The space that encoding
    puts before a text is the first character of the first part, and no prefix of the text.
    """

    def __init__(self, parts: list[Sequence[int]]):
        self.parts, self.base, total = parts, [0], 0
        for part in parts:
            total += part[-1]
            self.base.append(total)

    def total(self) -> int:
        """The tokens of the whole text."""
        return self.base[-1]

    def fits(self, budget: int) -> int:
        """The code points of the longest prefix with at most ``budget`` tokens.

        Sums never fall from part to part, so only the last part that starts within the budget
        may hold the place; within a part counts may fall again.
        """
        k = min(bisect_right(self.base, max(budget, 0)), len(self.parts)) - 1
        if k < 0:
            return 0
        before = sum(map(len, self.parts[:k])) - 1
        left, part = budget - self.base[k], self.parts[k]
        within = next((i for i in range(len(part), 0, -1) if part[i - 1] <= left), 0)
        return max(0, before + within)

    def counts(self) -> np.ndarray:
        """The counts of all prefixes, from the empty one to the whole text."""
        flat = [np.zeros(1, np.int64)] + [np.array(list(p), np.int64) + b for p, b in zip(self.parts, self.base, strict=False)]
        return np.concatenate([flat[0], np.concatenate(flat)[2:]])


@lru_cache(maxsize=2)
def table(path: str) -> PieceTable:
    """One table for a Python worker, kept between its tasks."""
    return PieceTable(path)


@lru_cache(maxsize=4)
def _counts(path: str) -> tuple[PieceTable, Kept]:
    of = table(path)
    return of, Kept(of.many_counts, MEMO_WORDS)


@lru_cache(maxsize=4)
def _codes(path: str) -> tuple[PieceTable, Kept]:
    of = table(path)
    digits, raw = [str(i) for i in range(len(of.raw))], of.raw

    def code(words: list[str]) -> list[tuple[int, str, bytes]]:
        return [(len(ids), ",".join([digits[i] for i in ids]), b"".join([raw[i] for i in ids])) for ids in of.many_ids(words)]

    return of, Kept(code, MEMO_WORDS)


def _budgets(limit: int, budgets: Sequence[int]) -> list[int]:
    return [limit, *(b for b in budgets if b != limit)]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, budgets: Sequence[int] = ()) -> DataFrame:
    """Exact token counts of whole texts: doc_id, n_bytes, n_tokens, over_limit, limit_chars.

    Each text gets a ``PrefixTable``: the count of its longest prefix is n_tokens, and the same
    table tells, without encoding again, how many code points fit ``limit`` (limit_chars) and each
    of ``budgets`` (columns fits_<budget>).

    One pass without a shuffle; a null or empty text has 0 tokens; rows with equal or null doc_id
    each give a row; an empty table gives none; other columns are not read. A text is held whole;
    memory is bounded by a slice of texts (``SLICE_BYTES``) or one longer text, and the kept words.
    """
    asked = _budgets(limit, budgets)
    names = ["limit_chars"] + [f"fits_{b}" for b in asked[1:]]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        of, kept = _counts(model_path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            words, at, first = word_table([of.spaced(t) for t in texts])
            known = kept(words)
            tokens, fits = [], []
            for text, a, b in zip(texts, first, first[1:], strict=False):
                counts = [known[i] for i in at[a:b]] if text else []
                runs = of.has_runs(text)
                table = of.table_of([words[i] for i in at[a:b]] if runs else [], counts, runs)
                tokens.append(table.total())
                fits.append([len(text) if tokens[-1] <= n else table.fits(n) for n in asked])
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_()), *[pa.array([f[k] for f in fits], pa.int64()) for k in range(len(asked))]],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", *names],
            )

        return run

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + "".join(f", {n} long" for n in names)
    return map_slices(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, schema)


def encode_decode(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Ids of whole texts and the text they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``with_ids`` adds ids (array of int) and decoded (string). A null or empty text has no ids
    and decodes to the empty text. One pass without a shuffle; rows with equal or null doc_id
    each give a row; an empty table gives none; other columns are not read. A text is held whole;
    memory is bounded by a slice of texts (``SLICE_BYTES``) or one longer text, and the kept words.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        of, kept = _codes(model_path)

        def coded(ids: list[int]) -> tuple[int, str, bytes]:
            return len(ids), ",".join(map(str, ids)), b"".join([of.raw[i] for i in ids])

        def code(text: str, words: list[str], codes: list[tuple[int, str, bytes]]) -> tuple[int, str, bytes]:
            if not text:
                return 0, "", b""
            if of.has_runs(text):
                parts = []
                for blanks, at in of.runs(words):
                    if not blanks:
                        parts.append(codes[at])
                    elif at < 0:
                        parts.append(coded(of.run_ids(blanks)))
                    else:
                        parts.append(coded(of.run_and_ids(blanks, list(map(int, codes[at][1].split(","))))))
                codes = parts
            return sum([c[0] for c in codes]), ",".join([c[1] for c in codes]), of.decoded([c[2] for c in codes])

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            words, at, first = word_table([of.spaced(t) for t in texts])
            known = kept(words)
            rows = [code(t, [words[i] for i in at[a:b]] if of.has_runs(t) else [], [known[i] for i in at[a:b]]) for t, a, b in zip(texts, first, first[1:], strict=False)]
            digest = lambda b: hashlib.sha256(b).hexdigest()
            columns = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([digest(r[1].encode()) for r in rows], pa.string()), pa.array([digest(r[2]) for r in rows], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([[int(i) for i in r[1].split(",")] if r[1] else [] for r in rows], pa.list_(pa.int32())), pa.array([r[2].decode() for r in rows], pa.string())]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        return run

    return map_slices(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, schema)
