"""Ids of a byte-level vocabulary by the tokenizers library, with frequent words kept.

The library first cuts a text by its pattern, and merges within what it cut. In a text without
runs of white space it cuts before every space and line feed, so words can be encoded apart: a
slice's texts are cut together, every different word is looked up once, and the ids of a word are
kept for the next time. A word of letters and marks after them is cut by the pattern into just
these two, so its pieces go to the library's merges; other words go through the whole library.
Any other text goes to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .common import Kept, word_table

#: Words whose ids a task keeps (some 200 bytes each), the longest such word, and words that go to the merges at once.
MEMO_WORDS, LONGEST, GROUP = 1_400_000, 64, 16
#: Marks the first word of a text, which has no space before it.
FIRST = "\0"
#: ASCII marks, which the pattern cuts off the letters before them.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class ByteTokens:
    def __init__(self, path: str, keep: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        if keep < MEMO_WORDS and hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the words kept here do its work; it grows to 50 MB
        self.raw = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        #: The vocabulary's letters for bytes: what shows stands for itself, the others for the letters from 256 on.
        self.letters = dict.fromkeys(shown) | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.letters |= {b: chr(b) for b in shown}
        self.marks = Kept(lambda marks: [self.merged(m) for m in marks], 10_000, LONGEST)
        self.kept = Kept(self.fresh, keep, LONGEST)
        #: Whether an id's piece starts with a space or a line feed, in the vocabulary's letters for bytes.
        self.opens = np.zeros(self.library.get_vocab_size(), bool)
        for piece, i in self.library.get_vocab().items():
            self.opens[i] = piece[0] in "ĠĊ"

    def forget(self) -> None:
        """Let go of the words kept so far."""
        for kept in (self.marks, self.kept):
            kept.clear()

    def whole(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, by the library alone."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, text: str) -> bool:
        """Whether a text may be cut before each space and line feed."""
        return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or not text.replace("\n", "").isprintable() or any(s in text for s in self.special))

    def shown(self, piece: str) -> str:
        """A piece in the vocabulary's letters for bytes."""
        return piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)

    def merged(self, piece: str) -> bytes:
        """The ids of what the pattern leaves in one piece."""
        return b"".join([self.raw[t.id] for t in self.model.tokenize(self.shown(piece))])

    def after_spaces(self, cores: list[str]) -> list[bytes]:
        """The ids of letters after a space each. Merges never cross a space between letters, so several go at once."""
        ids: list[int] = []
        for k in range(0, len(cores), GROUP):
            ids += [t.id for t in self.model.tokenize("Ġ" + "Ġ".join([c if c.isascii() else self.shown(c) for c in cores[k : k + GROUP]]))]
        flat = np.array(ids, "<u4")
        at = np.flatnonzero(self.opens[flat])
        if len(at) != len(cores):  # a vocabulary with pieces that span a space
            return [self.merged(" " + c) for c in cores]
        raw, ends = flat.tobytes(), (at * 4).tolist() + [4 * len(flat)]
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def fresh(self, words: list[str]) -> list[bytes]:
        """The ids of words: letters of Latin 1 with marks after them in two pieces, others by the whole library."""
        cores, tails, other, alone = [], [], [], {}
        for w in words:
            first = w[:1]
            body = w[1:] if first == FIRST or first == "\n" else w
            core = body.rstrip(MARKS)
            if not core.isalpha() or not core.isascii() and max(core) >= "Ā":
                other.append(w)
                tails.append(None)
                continue
            tails.append(body[len(core) :])
            if body is w:
                cores.append(core)
            else:
                alone[w] = self.merged(core)
        known = list({*tails, "\n"} - {"", None})
        ends = dict(zip(known, self.marks(known), strict=True)) | {"": b""}
        rest, feed, led = self.through(other) if other else {}, ends["\n"], iter(self.after_spaces(cores) if cores else ())
        found = []
        for w, tail in zip(words, tails, strict=True):
            if tail is None:
                found.append(rest[w])
            elif w in alone:
                found.append((feed if w[0] == "\n" else b"") + alone[w] + ends[tail])
            else:
                found.append(next(led) + ends[tail])
        return found

    def through(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words by the whole library: many words go to the library as one text, and come apart where an id opens a word.

        The mark alone is the empty first word before a space or a line feed, the empty word a last space.
        """
        found: dict[str, bytes] = {FIRST: b""}
        alone = [w for w in words if w in ("", "\n") or w[0] == FIRST and w != FIRST]
        rest = [w for w in words if w not in ("", "\n") and w[0] != FIRST]
        for i in range(0, len(rest), 2_000):
            part = rest[i : i + 2_000]
            ids = np.array(self.library.encode_batch_fast(["".join([w if w[0] == "\n" else " " + w for w in part])], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(part):  # an id spans two words, or opens within one
                found |= zip(part, self.whole([w if w[0] == "\n" else " " + w for w in part]), strict=True)
                continue
            raw, ends = ids.tobytes(), (at * 4).tolist() + [4 * len(ids)]
            found |= {w: raw[a:b] for w, a, b in zip(part, ends, ends[1:], strict=False)}
        found |= zip(alone, self.whole([w[1:] if w[:1] == FIRST else w or " " for w in alone]), strict=True)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without added special tokens."""
        out: list[bytes] = [b""] * len(texts)
        cut = [i for i, t in enumerate(texts) if t and self.apart(t)]
        if cut:
            words, at, first = word_table([FIRST + texts[i].replace("\n", " \n") for i in cut])
            known = self.kept(words)
            ids = list(map(known.__getitem__, at))
            for i, a, b in zip(cut, first, first[1:], strict=False):
                out[i] = b"".join(ids[a:b])
        there = set(cut)
        other = [i for i, t in enumerate(texts) if t and i not in there]
        for i, coded in zip(other, self.whole([texts[i] for i in other]), strict=True):
            out[i] = coded
        return out


@lru_cache(maxsize=2)
def tokens(path: str, keep: int = MEMO_WORDS) -> ByteTokens:
    """One encoder for a Python worker, kept between its tasks: of a library that has encoded and goes, 30 MB never come back."""
    return ByteTokens(path, keep)
