"""Token ids of whole texts through the tokenizers library, with a bounded memory of pieces already encoded.

Both public tokenizers split a text before they merge, so the ids of a text are those of its pieces in a row, if it is
cut only where they would split anyway. A piece met before is looked up; the others go to the library in one call.
A piece kind says where cuts are safe:

- "space": byte-level splitting, where one space belongs to the word after it. Cut before a space that a
  non-space follows, and around single line ends.
- "word": white space is dropped. Cut at white space.

Long pieces without spaces are cut between a punctuation mark and a letter, and between a letter and a digit, where both
kinds split, too.

A text in which the quick cut isn't safe (runs of white space, rare space characters) is cut by a pattern instead. A
text that holds a special token's literal, which the library finds before it splits, goes to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import repeat

import numpy as np

from .base import worker_memory

_RARE_SPACE = re.compile(r"[^\S \n]")
_ODD = re.compile("[\x1c-\x1f]")
_CUT = re.compile(r" (?=\S)")
_AS_IS = "\n "
#: Latin words are one unit for either splitter; such a word goes to the merging model itself.
_LATIN = re.compile("[A-Za-zß-öø-ÿ]+")
#: One such mark after a word is a unit of its own for either splitter.
_MARKS = ".,;:!?"
#: Pieces of more characters are cut further; so many characters go to the library at once.
LONG, AT_ONCE = 4096, 1 << 18
_LETTER = "[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]"
#: Letters, digits and marks of these kinds are what they are in every version of Unicode; an apostrophe is no such mark.
_FURTHER = re.compile(f"(?<=[.,;:!?\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?={_LETTER})|(?<=[0-9])(?={_LETTER})|(?<={_LETTER})(?=[0-9])")


def _byte_chars() -> dict[int, str]:
    """The characters that byte-level models write for bytes: printable ones for themselves, the rest from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def encoder(path: str, kind: str, memory: int = 200_000) -> Encoder:
    """A Python worker's encoder: it lives on from task to task, and with it what it knows."""
    return worker_memory(("encoder", path, kind, memory), lambda: Encoder(path, kind, memory))


class Encoder:
    """encode(texts) -> (ids of all texts in a row, each text's number of ids).

    memory: pieces kept at most; when there are more, those that one batch alone used are forgotten, which costs time
    but changes nothing.
    """

    def __init__(self, path: str, kind: str, memory: int = 200_000, longest: int = 64):
        self.tokenizer, self.kind, self.memory, self.longest = _tokenizer(path), kind, memory, longest
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.uses = np.zeros(1 << 16, np.int32)
        self.used = self.rows = 0

    def _shrink(self) -> None:
        """Keep what more than one batch has used; if that is more than half of the memory, nothing."""
        old, uses = self.known, self.uses
        kept = {p: i for p, i in old.items() if uses[i] > 1}
        if 2 * len(kept) > self.memory:
            kept = {}
        at = np.fromiter(kept.values(), np.int64, len(kept))
        flat, begin, size = self.flat, self.begin, self.size
        self._forget()
        if len(kept):
            self._store(list(kept), size[at], flat[np.repeat(begin[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(size[at].sum())])

    def _pieces(self, text: str) -> list[str]:
        pieces = self._cut(text)
        if len(text) <= LONG or max(map(len, pieces), default=0) <= LONG or any(s in text for s in self.special):
            return pieces
        again = _AS_IS if self.kind == "space" else ""
        return [p for piece in pieces for p in ([piece] if len(piece) <= LONG else [own if not k else again + own for k, own in enumerate(_FURTHER.split(piece))])]

    def _cut(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [text if self.kind == "word" else _AS_IS + text]
        if self.kind == "word":
            return text.split() if not _ODD.search(text) else text.split(" ")
        # A piece stands for a space and itself; after the mark, or with its line end, for just itself. Quick pieces hold no space.
        if not _RARE_SPACE.search(text):
            pieces = text.replace("\n", " \n").split(" ")
            if "" not in pieces and "\n" not in pieces:  # else white space stands together, or at an end
                pieces[0] = _AS_IS + pieces[0]
                return pieces
        parts = _CUT.split(text)
        return [_AS_IS + parts[0], *[_AS_IS + " " + p for p in parts[1:]]]

    def _plain(self, piece: str) -> str:
        if self.kind == "word":
            return piece
        if piece.startswith(_AS_IS):
            return piece[len(_AS_IS) :]
        return piece if piece[:1] == "\n" else " " + piece

    def _merged(self, chars: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(chars)]

    def _rows(self, pieces: list[str], plain: list[str]) -> list[list[int]]:
        """Ids of new pieces: Latin words, also with a mark after them, by the tokenizer's merging model, all others by
        the whole tokenizer.
        """
        latin, space, known = _LATIN.fullmatch, self.kind == "space", self.known
        marks = {m: self._merged(m) for m in _MARKS}
        rows: list[list[int]] = []
        rest = []
        for i, text in enumerate(plain):
            mark = text[-1:] if text[-1:] in marks else ""
            body = text[:-1] if mark else text
            word = body[1:] if space and body[:1] == " " else body
            if not latin(word):
                rows.append([])
                rest.append(i)
                continue
            if mark and (k := known.get(pieces[i][:-1])) is not None:
                ids = self.flat[self.begin[k] : self.begin[k] + self.size[k]].tolist()
            elif word.isascii():
                ids = self._merged(word.lower() if not space else word if body is word else _BYTE_CHARS[32] + word)
            else:
                ids = self._merged((body if space else word.lower()).encode().decode("latin-1").translate(_BYTE_CHARS))
            rows.append(ids + marks[mark] if mark else ids)
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([plain[i] for i in rest], add_special_tokens=False), strict=True):
                rows[i] = e.ids
        return rows

    def _add(self, pieces: list[str], plain: list[str]) -> None:
        lo = size = 0
        for hi, text in enumerate(plain, 1):
            size += len(text)
            if size >= AT_ONCE or hi == len(plain):
                rows = self._rows(pieces[lo:hi], plain[lo:hi])
                sizes = np.fromiter(map(len, rows), np.int32, len(rows))
                self._store(pieces[lo:hi], sizes, np.fromiter((i for r in rows for i in r), np.int32, int(sizes.sum())))
                lo, size = hi, 0

    def _store(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, m = self.rows, self.rows + len(pieces)
        if m > len(self.begin):
            self.begin, self.size, self.uses = (np.concatenate([x, np.zeros(m, x.dtype)]) for x in (self.begin, self.size, self.uses))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(ids), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[n:m] = self.used + np.cumsum(sizes) - sizes
        self.size[n:m] = sizes
        self.used += len(ids)
        self.rows = m
        self.known.update(zip(pieces, range(n, m), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.rows > self.memory:
            self._shrink()
        every: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                pieces = self._pieces(text)
                counts[i] = len(pieces)
                every += pieces
        get = self.known.get
        where = np.fromiter(map(get, every, repeat(-1)), np.int64, len(every))
        if (missing := np.flatnonzero(where < 0)).size:
            new = list(dict.fromkeys([every[i] for i in missing]))
            self._add(new, [self._plain(p) for p in new])
            where[missing] = np.fromiter((get(every[i]) for i in missing), np.int64, len(missing))
            for piece in new:
                if len(piece) > self.longest:  # base64, tables: hardly met twice
                    del self.known[piece]
        self.uses[where] += 1  # once for each piece of the batch
        sizes = self.size[where].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[where] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])
        last = np.cumsum(counts)
        return ids, bounds[last] - bounds[last - counts]
