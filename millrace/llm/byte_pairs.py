"""Operator 12: byte-level BPE encoding and decoding by a file of ranks.

A text is split by the vocabulary's pattern, and each match is encoded apart. A match that is a token as a whole is that
token. Any other starts as its bytes; a segment tree over the byte positions holds, for each live position, the rank of
the token that it and its right neighbour would make, and so its root is the leftmost of the least ranks. A merge takes
the root's position, links it with its neighbour's neighbour and sets three leaves anew: its own, its left neighbour's,
and that of the position that has died. Each costs a path to the root, so n bytes take n log n steps, also where a match
is a whole text.

Matches are many and short: those of up to LANE bytes go through the same steps side by side, a row of arrays each, and
leave the arrays when they end. Longer ones go alone. A worker meets the same words again and again, so it keeps the ids of
what it has encoded in a table of a fixed number of slots (see tokens), which decides about time and not about ids.

Null texts are empty, an empty text has no ids; rows go one by one, so repeated rows give repeated rows; an empty table
gives none; extra columns are ignored. Texts of any length are encoded whole. Special tokens have no meaning here: their
strings are ordinary text. Bytes that no token covers raise an error, as does an id beyond the vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices
from millrace.llm.tokens import Encoder

DEFAULT_FILE = "byte_bpe_multi_50k.tiktoken"
#: Bytes of the matches that are encoded side by side, and positions of all of them together.
LANE = 128
CELLS = 1 << 20
NONE = np.int64(1) << np.int64(62)  # no pair starts here
_encoders: dict[str, "RankEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids, from a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Ranks:
    """The ranks of pairs of neighbouring tokens, and the merging of pieces by them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.size = ranks, max(ranks.values(), default=-1) + 1
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.made = np.append(keys, np.int64(-1)), np.array([*(pairs[k] for k in keys.tolist()), 0], np.int64)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        tokens = sorted((r, t) for t, r in ranks.items())
        self.length = np.zeros(self.size, np.int64)
        self.length[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
        self.bytes, self.at = np.frombuffer(b"".join(t for _, t in tokens), np.uint8), np.cumsum(self.length) - self.length

    def of(self, a: np.ndarray, b: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Leaves of the tree: (rank of the pair a b, position) in one number, NONE where they make no token."""
        key = a * self.size + b
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.made[at] << np.int64(32) | position, NONE)

    def alone(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length."""
        n, ranks = len(piece), self.ranks
        size = 1 << (n - 1).bit_length()
        none = (self.size, n)
        tree = [none] * (2 * size)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the token at a position: where it ends; where the one before it starts

        def put(i: int) -> None:
            """The leaf of i anew, and the path above it."""
            rank = ranks.get(piece[i : end[end[i]]]) if end[i] < n else None
            up(i, none if rank is None else (rank, i))

        def up(i: int, leaf: tuple) -> None:
            i += size
            tree[i] = leaf
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a <= b else b
                if tree[i] == least:
                    return
                tree[i] = least

        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = (rank, i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] != none:
            i = tree[1][1]
            j = end[i]
            end[i] = end[j]
            if end[j] < n:
                before[end[j]] = i
            up(j, none)
            put(i)
            if before[i] >= 0:
                put(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def together(self, pieces: list[bytes], size: int) -> Iterator[list[int]]:
        """The ids of pieces of at most size bytes (a power of two), a lane each."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        lanes, width = len(pieces), size + 1  # a lane's last position stands for its end
        inside = np.arange(width) < lengths[:, None]
        token = np.full((lanes, width), -1, np.int64)
        token[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((lanes, 2 * size), NONE, np.int64)
        place = np.broadcast_to(np.arange(size, dtype=np.int64), (lanes, size))
        both = inside[:, 1:]
        tree[:, size:][both] = self.of(token[:, :-1][both], token[:, 1:][both], place[both])
        level = size
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        after = np.tile(np.arange(1, width + 1), (lanes, 1))
        before = np.tile(np.arange(-1, width - 1), (lanes, 1))
        token, tree, after, before, live = token.ravel(), tree.ravel(), after.ravel(), before.ravel(), inside.ravel()
        lane = np.flatnonzero(tree[1 :: 2 * size] < NONE)
        while len(lane):
            at, top = lane * width, lane * (2 * size)
            root = tree[top + 1]
            i = root & np.int64(0xFFFFFFFF)
            j = after[at + i]
            k = after[at + j]
            token[at + i] = root >> np.int64(32)
            live[at + j] = False
            after[at + i] = k
            more = k < lengths[lane]
            before[(at + k)[more]] = i[more]
            k = np.minimum(k, size)
            h = before[at + i]
            tree[top + size + j] = NONE
            tree[top + size + i] = np.where(more, self.of(token[at + i], token[at + k], i), NONE)
            left = np.flatnonzero(h >= 0)
            tree[top[left] + size + h[left]] = self.of(token[at[left] + h[left]], token[at[left] + i[left]], h[left])
            paths = [(top, size + i), (top, size + j), (top[left], size + h[left])]
            for _ in range(size.bit_length() - 1):
                paths = [(t, x >> 1) for t, x in paths]
                for t, x in paths:
                    tree[t + x] = np.minimum(tree[t + 2 * x], tree[t + 2 * x + 1])
            lane = lane[tree[top + 1] < NONE]
        ids, ends = token[live].tolist(), np.cumsum(live.reshape(lanes, width).sum(1)).tolist()
        for a, b in zip([0, *ends], ends):
            yield ids[a:b]

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece, none of them empty."""
        out: list[list[int]] = [[]] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for n, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[n] = [whole]
            elif len(p) > LANE:
                out[n] = self.alone(p)
            else:
                sizes.setdefault(1 << (len(p) - 1).bit_length(), []).append(n)
        for size, some in sizes.items():
            for a in range(0, len(some), CELLS // size):
                lot = some[a : a + CELLS // size]
                for n, ids in zip(lot, self.together([pieces[n] for n in lot], size)):
                    out[n] = ids
        return out

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, length of each id's token)."""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.at[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)], n


class RankEncoder(Encoder):
    """The ids of texts by a file of ranks and the public pattern; what has been encoded is kept as in Encoder, whose cuts
    between pieces hold for this pattern."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex

        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.ranks = Ranks(read_ranks(path))
        self.kind = "<u2" if self.ranks.size <= 1 << 16 else "<u4"
        if (self.ranks.byte < 0).any():
            raise ValueError("the ranks lack single bytes")
        self._clear()

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, first and number of each piece's)."""
        matches = [self.split(p.decode("utf-8", "replace")) for p in pieces]
        known = {p: k for k, p in enumerate(dict.fromkeys(p for m in matches for p in m))}
        ids = self.ranks.merged([p.encode("utf-8") for p in known])
        got = [[i for p in m for i in ids[known[p]]] for m in matches]
        n = np.array([len(g) for g in got], np.int32)
        return np.fromiter((i for g in got for i in g), "<u4", int(n.sum())), np.cumsum(n) - n, n


def encoder(path: str) -> RankEncoder:
    """One a worker process and file."""
    if path not in _encoders:
        _encoders[path] = RankEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text): ids as little-endian unsigned 32-bit integers."""
    path = path or default_path()

    def run(batches):
        coder = encoder(path)
        for some, buf, offs in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x.tobytes() for x in coder.ids_of(buf, offs)], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text")).mapInArrow(run, "doc_id long, ids binary")


def decoded(table: DataFrame, path: str | None = None) -> DataFrame:
    """table with the bytes of its ids in their place; null ids are none."""
    path = path or default_path()
    at = table.columns.index("ids")

    def run(batches):
        ranks = encoder(path).ranks
        for some, buf, offs in slices(batches, "ids"):
            data, n = ranks.decoded(np.frombuffer(buf.tobytes(), "<u4"))
            upto = np.concatenate([[0], np.cumsum(n)])[offs // 4].tolist()
            data = data.tobytes()
            yield some.set_column(at, "ids", pa.array([data[a:b] for a, b in zip(upto, upto[1:])], pa.binary()))

    return table.mapInArrow(run, table.schema)


def round_trip_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The query's columns: digests of each text's ids and of the bytes that the ids give back."""
    ids = encoded(docs, path).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decoded(ids, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("ids", 256).alias("decoded_sha256"))
