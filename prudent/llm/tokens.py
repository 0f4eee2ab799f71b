"""Token ids of texts with a public tokenizer, shared by packing and the token files.

``Encoder.encode_batch`` gives what ``Tokenizer.encode(text, add_special_tokens=False)`` gives.
The byte-level pre-tokenizer always cuts before a single space that stands between two characters
that aren't white space, so a text is cut there, and every distinct cut piece is encoded once and
kept in a bounded cache.  Runs of white space stay inside a piece.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: the letter that byte-level models write for every byte: itself where it is printable, else the next from 256 on
_PRINTABLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SPELL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_BLANK = chr(_SPELL[32])
#: characters of text whose pieces are coded at once
SLICE_CHARS = 1 << 20

#: stands before a text that Arrow cuts, and marks its first piece
_FIRST = "\0"
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_ASCII_ODD = "\t\v\f\r\x1c\x1d\x1e\x1f"
_ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _plain(text: str) -> bool:
    """Whether every space stands between two characters that aren't white space (told by quick tests; no is safe)."""
    return not (text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text
                or _FIRST in text or any(c in text for c in _ASCII_ODD) or (not text.isascii() and _ODD.search(text)))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Byte-level BPE of a tokenizer file with a cache of encoded pieces.

    The cache has two generations of at most ``limit`` pieces; the older one is dropped when the
    younger is full, so frequent pieces stay and memory is bounded.
    """

    def __init__(self, path: str, limit: int = 150_000):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        #: piece -> ids as little-endian 32-bit integers; one that begins with a space begins a text,
        #: any other stands after a space
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: ids of a punctuation mark that follows letters
        self.points = {c: np.array(self._ids(c), "<u4").tobytes() for c in ".,;:!?"}
        line_end = self._ids("\n")
        self.newline = line_end[0] if len(line_end) == 1 else None
        self.line_end = np.array(line_end, "<u4").tobytes()
        #: the model alone, for words that the pre-tokenizer would not cut: no offsets, no alignment
        self.model = self.tokenizer.model

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All pieces of the texts, one text after another, and how many each has.

        Plain texts are cut by Arrow, others by the expression; a piece that begins its text has a mark or a space before it.
        """
        plain = np.fromiter(map(_plain, texts), bool, len(texts))
        cut = pc.split_pattern(pa.array([_FIRST + t for t, p in zip(texts, plain) if p], pa.large_string()), " ")
        odd = [_SAFE_CUT.split(t) for t, p in zip(texts, plain) if not p]
        for o in odd:
            o[0] = " " + o[0]
        counts = np.empty(len(texts), np.int64)
        counts[plain] = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        counts[~plain] = [len(o) for o in odd]
        values = pa.concat_arrays([cut.flatten(), pa.array([_FIRST + x if x[:1] == _FIRST else x for o in odd for x in o], pa.large_string())])
        if odd and plain.any():  # back to the order of the texts
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            begin = np.zeros(len(texts), np.int64)
            begin[order] = np.cumsum(counts[order]) - counts[order]
            values = values.take(pa.array(_ranges(begin, counts)))
        return values, counts

    @staticmethod
    def _as_text(piece: str) -> str:
        return piece[1:] if piece[0] == " " else " " + piece

    def _encode_new(self, pieces: list[str]) -> None:
        """Put the ids of new pieces in the cache.

        Letters and one punctuation mark after them are two pre-tokens, so the bare word is encoded.
        Pieces with lone line ends inside are put together from their parts.  Pieces without inner white
        space are encoded as lines of one text: a line end is a pre-token of its own there, so its id
        parts the lines.  Others are encoded one by one.
        """
        broken = {p: parts for p in pieces if "\n" in p and (parts := self._at_line_ends(p))}
        pieces = [p for p in pieces if p not in broken]
        pieces += self._unknown({q for parts in broken.values() for q in parts}.difference(pieces))
        words, lines, single, pointed = [], [], [], []
        for p in pieces:
            core = p[1:] if p[0] == " " else p
            if core.isalpha():
                words.append(p)
            elif core[-1:] in self.points and core[:-1].isalpha():
                pointed.append(p)
            elif core.split() == [core] and "<|" not in core:
                lines.append(p)
            else:
                single.append(p)
        words += self._unknown({p[:-1] for p in pointed}.difference(words))
        if self.newline is None:
            lines, single = [], lines + single
        self._encode_words(words)
        self._encode_lines(lines)
        for p in single:
            self.cache[p] = np.array(self._ids(self._as_text(p)), "<u4").tobytes()
        for p in pointed:
            self.cache[p] = self.cache[p[:-1]] + self.points[p[-1]]
        for p, parts in broken.items():
            self.cache[p] = self.line_end.join([self.cache[q] for q in parts])

    def _unknown(self, pieces) -> list[str]:
        """Pieces that neither generation has; those of the older one move to the younger."""
        out = []
        for p in pieces:
            if p not in self.cache:
                known = self.old.get(p)
                if known is None:
                    out.append(p)
                else:
                    self.cache[p] = known
        return out

    def _at_line_ends(self, piece: str) -> list[str]:
        """Parts of a piece between its line ends, where each line end stands alone between other characters (a pre-token of its own)."""
        first, *rest = piece.split("\n")
        core = first[1:] if first[:1] == " " else first
        if self.newline is None or core.split() != [core] or any(r.split() != [r] for r in rest):
            return []
        return [first, *(" " + r for r in rest)]

    def _encode_words(self, words: list[str]) -> None:
        """Words of letters are one pre-token each: the model's merges run on their bytes, in the alphabet that it spells them in."""
        tokenize, cache = self.model.tokenize, self.cache
        for p in words:
            if p.isascii():
                spelled = p[1:] if p[0] == " " else _BLANK + p
            else:
                spelled = self._as_text(p).encode("utf-8", "surrogatepass").decode("latin-1").translate(_SPELL)
            cache[p] = array("I", [t.id for t in tokenize(spelled)]).tobytes()

    def _encode_lines(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 5000):
            part = pieces[at:at + 5000]
            text = "\n".join([self._as_text(p) for p in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids)) * 4
            raw = ids.tobytes()
            start = 0
            for piece, end in zip(part, ends.tolist(), strict=True):
                self.cache[piece] = raw[start:end]
                start = end + 4

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, the new ones encoded."""
        if len(self.cache) > self.limit:
            self.cache, self.old = {}, self.cache
        self._encode_new(self._unknown(pieces))
        return [self.cache[p] for p in pieces]

    def _encode_slice(self, texts: list[str], end: np.ndarray) -> list[np.ndarray]:
        values, counts = self._pieces(texts)
        coded = values.dictionary_encode()
        # the mark stands before a first piece, or before a mark of the text's own
        ids = self._ids_of([p if p[:1] != _FIRST else p[1:] if p[1:2] == _FIRST else " " + p[1:] for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist()])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = coded.indices.to_numpy()
        begin, size = (np.cumsum(sizes) - sizes)[at], sizes[at]
        flat = np.frombuffer(b"".join(ids), "<u4")[_ranges(begin, size)]
        stops = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)].tolist()
        return [np.concatenate([flat[a:b], end]) for a, b in zip([0, *stops], stops)]

    def encode_batch(self, texts: list[str | None], step: int = 512, end_id: int | None = None) -> list[np.ndarray]:
        """Ids of every text (null: none) as unsigned 32-bit integers, with ``end_id`` after them if there is one.

        Pieces of a slice of the texts are coded by Arrow, so each distinct one is looked up once a slice and the ids are
        gathered side by side.
        """
        end = np.array([] if end_id is None else [end_id], "<u4")
        out: list[np.ndarray] = [end] * len(texts)
        part: list[int] = []
        chars = 0
        for i, t in enumerate(texts):
            if t:
                part.append(i)
                chars += len(t)
            if part and (len(part) >= step or chars >= SLICE_CHARS or i == len(texts) - 1):
                for j, ids in zip(part, self._encode_slice([texts[j] for j in part], end)):
                    out[j] = ids
                part, chars = [], 0
        return out


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin[i] .. begin[i] + size[i] - 1`` for every i, one after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker: its cache outlives a task."""
    return Encoder(path)
