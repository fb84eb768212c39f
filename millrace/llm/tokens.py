"""Byte-level BPE ids of whole texts, by the tokenizers library and a public vocabulary file whose path is a parameter.

Texts are cut where the vocabulary's own pattern always cuts: before a space that something else than white space
follows, around a single line end, and before a lone mark behind an ASCII letter. So the ids of a text are those of its
pieces in order. A worker keeps the ids of pieces in a table of a fixed number of slots, by a 64-bit hash; the library
encodes what isn't there. Pieces that come twice in a batch take a slot from others; others only take empty ones. A piece
that begins with a space and something else is cut off wherever it stands, so the library gets many such in one text, and
the bytes of the ids tell them apart again."""

from __future__ import annotations

import os
from array import array

import numpy as np

from millrace.llm import kernel as K

DEFAULT_FILE = "byte_bpe_50k.json"
SLOT_BITS = 21
#: Pieces that the library encodes as one text.
JOINED = 64
#: Ids that the table holds at most; then it starts anew.
ARENA = 1 << 23
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of the white space outside ASCII (and of much else, where there is just no cut).
_MAY_BE_SPACE = _SPACE.copy()
_MAY_BE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The first bytes of the pieces of texts laid end to end."""
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    nxt = np.empty(n, np.uint8)
    nxt[:-1], nxt[-1:] = buf[1:], 32
    last = edge[1:]  # at the end of a text nothing follows
    start = (buf == 32) & ~_MAY_BE_SPACE[nxt] & ~last
    line = np.flatnonzero(buf == 10)
    if len(line):
        before = np.where(line > 0, buf[line - 1], 97)
        line = line[(edge[line] | ((before < 128) & ~_SPACE[before])) & (last[line] | ~_MAY_BE_SPACE[nxt[line]])]
    start = np.append(start, True)
    start[line] = True
    start[line + 1] = True
    start |= edge
    mark = np.flatnonzero(_MARK[buf] & start[1:])
    if len(mark):
        mark = mark[(mark > 0) & ~start[mark] & _LETTER[buf[mark - 1]]]
        start[mark] = True
    return np.flatnonzero(start[:-1])


class Encoder:
    """ids(texts): for each text its ids as an array of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        vocab = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # of each id: a character of a token stands for a byte
        self.bytes[[*vocab.values()]] = [len(t) for t in vocab]
        self._clear()

    def _clear(self) -> None:
        slots = 1 << SLOT_BITS
        self.hash, self.at, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.arena, self.used = np.zeros(ARENA, self.kind), 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of each text's)."""
        got = []
        for i in range(0, len(texts), 4096):
            got += [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return np.frombuffer(b"".join([array("I", g).tobytes() for g in got]), "<u4"), np.array([len(g) for g in got], np.int64)

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same of pieces that may stand together, or None if their ids don't part at their ends, as of broken UTF-8."""
        try:
            flat, _ = self._library([b"".join(pieces[i : i + JOINED]).decode("utf-8") for i in range(0, len(pieces), JOINED)])
        except UnicodeDecodeError:
            return None
        upto = np.concatenate([[0], np.cumsum(self.bytes[flat])])
        ends = np.cumsum([len(p) for p in pieces])
        at = np.searchsorted(upto, ends)
        if upto[-1] != ends[-1] or (upto[at] != ends).any():
            return None
        return flat, np.diff(at, prepend=0)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, first and number of each piece's)."""
        free = np.array([len(p) > 1 and p[0] == 32 and not _MAY_BE_SPACE[p[1]] for p in pieces], bool)
        some = np.flatnonzero(free)
        got = self._together([pieces[i] for i in some.tolist()]) if len(some) else None
        if got is None:
            some, got = some[:0], (np.zeros(0, "<u4"), np.zeros(0, np.int64))
            free[:] = False
        rest = np.flatnonzero(~free)
        more = self._library([pieces[i].decode("utf-8", "replace") for i in rest.tolist()])
        order, size = np.concatenate([some, rest]), np.concatenate([got[1], more[1]])
        first, n = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int32)
        first[order], n[order] = np.cumsum(size) - size, size
        return np.concatenate([got[0], more[0]]), first, n

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        blobs = [t.encode("utf-8") for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
        return self.ids_of(np.frombuffer(b"".join(blobs), np.uint8), offs)

    def ids_of(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The ids of texts laid end to end."""
        if not len(buf):
            return [np.zeros(0, "<u4") for _ in offs[1:]]
        start = cuts(buf, offs)
        stop = np.append(start[1:], len(buf))
        h = K.mixed(K.span_hashes(K.prefix(buf), start, stop) + (stop - start).astype(np.uint64)) | np.uint64(1)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.intp)
        miss = np.flatnonzero(self.hash[slot] != h)
        at, n = self.at[slot], self.n[slot]
        arena = self.arena
        if len(miss):
            new, first, back, count = np.unique(h[miss], return_index=True, return_inverse=True, return_counts=True)
            some = miss[first]
            joined = buf.tobytes()
            flat, begin, size = self._encoded([joined[a:b] for a, b in zip(start[some].tolist(), stop[some].tolist())])
            flat = flat.astype(self.kind)
            if self.used + len(flat) > ARENA:  # what was found in this batch goes with its own arena
                old, held = arena[: self.used], len(flat)
                arena = np.concatenate([flat, old])
                at += held
                at[miss], n[miss] = begin[back], size[back]
                self._clear()
            else:
                arena[self.used : self.used + len(flat)] = flat
                place = (begin + self.used).astype(np.int32)
                self.used += len(flat)
                at[miss], n[miss] = place[back], size[back]
                s = (new >> np.uint64(64 - SLOT_BITS)).astype(np.intp)
                take = (self.hash[s] == 0) | (count > 1)
                self.hash[s[take]], self.at[s[take]], self.n[s[take]] = new[take], place[take], size[take]
        total = np.cumsum(n, dtype=np.int64)
        ids = arena[np.repeat(at - (total - n), n) + np.arange(int(total[-1]))].astype("<u4")
        upto = np.concatenate([[0], total])[np.searchsorted(start, offs)]
        return [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
