"""Encoding of a corpus with a public byte-level BPE (problem 8).

Texts are cut into pieces without regular expressions: every code point gets a class, classes with one
character of lookahead select a transition function over eight states, and since composition of such
functions is associative, whole batches are scanned block-wise with numpy: compose within blocks, scan over
blocks, replay. Pieces are then merged into ids once each and cached. The byte offset of every id is known
from the lengths of the ids before it, so ids decode to exactly the text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary lies by default: ranks, one base64 token and its id a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Code points scanned at once, so that memory does not follow the batch.
CHUNK = 1_000_000
BLOCK = 64
#: Pieces kept in a worker's cache; it starts anew beyond that.
CACHE = 400_000

# Classes of code points and symbols (a class with its lookahead).
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_LEAD, S_SINGLE, S_RUN = range(8)
# States: what the piece before is.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, LED, IN_BLANKS, LAST_OF, TWO_OF = range(8)
#: White space; fixed values.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x32400):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    table[WHITE] = BLANK
    table[32] = SPACE
    return table


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by symbol (the upper half: first of a text) and state."""
    step, cut = np.zeros((16, 8), np.uint8), np.zeros((16, 8), np.uint8)
    runs = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER}
    for symbol in range(8):
        for state in range(8):
            if state in (LAST_OF, TWO_OF):
                new, starts = (START if state == LAST_OF else LAST_OF), False
            elif symbol in runs:
                new, starts = runs[symbol], state not in (runs[symbol], LED)
            elif symbol in (S_SHORT, S_LONG):
                joined = state in (IN_OTHER, LED)
                new, starts = (IN_OTHER if joined else LAST_OF if symbol == S_SHORT else TWO_OF), not joined
            elif symbol == S_LEAD:
                new, starts = LED, True
            elif symbol == S_SINGLE:
                new, starts = START, True
            else:
                new, starts = IN_BLANKS, state != IN_BLANKS
            step[symbol, state], cut[symbol, state] = new, starts
    for symbol in range(8):
        step[symbol + 8, :], cut[symbol + 8, :] = step[symbol, START], 1
    return step, cut


STEP, CUT = _transitions()
_tables: dict[str, np.ndarray] = {}


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    if "classes" not in _tables:
        _tables["classes"] = _classes()
    kind = _tables["classes"][points]
    n = len(points)
    ends = np.zeros(n + 3, bool)  # whether a text ends before this place
    ends[first] = True
    ends[n:] = True
    later = np.full(n + 3, BLANK, np.uint8)
    later[:n] = kind
    blank = kind >= SPACE
    followed = (later[1 : n + 1] < SPACE) & ~ends[1 : n + 1]
    symbol = kind.copy()
    symbol[blank] = np.where(followed[blank], np.where(kind[blank] == SPACE, S_LEAD, S_SINGLE), S_RUN)
    quote = np.flatnonzero(points == 39)
    if len(quote):
        at = np.zeros(n + 3, points.dtype)
        at[:n] = points
        one, two = at[quote + 1], at[quote + 2]
        inside1 = ~ends[quote + 1]
        inside2 = inside1 & ~ends[quote + 2]
        short = inside1 & np.isin(one, [ord(c) for c in "stmd"])
        long = inside2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        symbol[quote[short]] = S_SHORT
        symbol[quote[long]] = S_LONG
    symbol[first] += 8
    return symbol


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where pieces start. ``points``: code points of texts end to end; ``first``: starts of the texts that are not empty."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    symbols = _symbols(points, first)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK), np.uint8)
    grid.ravel()[:n] = symbols
    flat_step, flat_cut = STEP.ravel(), CUT.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for k in range(BLOCK):
        whole = flat_step[(grid[:, k, None].astype(np.uint16) << 3) + whole]
    reach = 1
    while reach < blocks:  # after the loop whole[b] maps the first state to the one after block b
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = whole[:-1, START]
    starts = np.zeros((blocks, BLOCK), np.uint8)
    for k in range(BLOCK):
        key = (grid[:, k].astype(np.uint16) << 3) + state
        starts[:, k] = flat_cut[key]
        state = flat_step[key]
    return np.flatnonzero(starts.ravel()[:n])


class Encoder:
    """Ids of texts under one vocabulary of byte ranks; pieces are merged once and cached."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.length = np.zeros(self.size, np.int32)
        for i, t in self.bytes_of.items():
            self.length[i] = len(t)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat: list[int] = []
        self.ends: list[int] = [0]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: of all neighbouring pairs the one of least rank is joined, again and again."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 48:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            least, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (least is None or rank < least):
                    least, at = rank, i
            if least is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here, 0 where none does
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or b >= n or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
                rank = ranks.get(piece[a : end[c]])
                if rank is not None:
                    heapq.heappush(heap, (rank, a, c, end[c]))
            p = before[a]
            if p >= 0:
                rank = ranks.get(piece[p:c])
                if rank is not None:
                    heapq.heappush(heap, (rank, p, a, c))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        known, flat, ends = self.known, self.flat, self.ends
        out = []
        for piece in pieces:
            number = known.get(piece)
            if number is None:
                number = known[piece] = len(ends) - 1
                flat.extend(self.merge(piece.encode()))
                ends.append(len(flat))
            out.append(number)
        return np.array(out, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids end (one more entry than texts)."""
        ids, counts, at = [], np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (size == 0 or size + len(texts[upto] or "") <= CHUNK):
                size += len(texts[upto] or "")
                upto += 1
            if size:
                got, counts[at:upto] = self._encode_chunk([t or "" for t in texts[at:upto]])
                ids.append(got)
            at = upto
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(counts)])

    def _encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE:
            self._clear()
        sizes = np.array([len(t) for t in texts])
        begin = np.cumsum(sizes) - sizes
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, begin[sizes > 0])
        places = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(places, [*places[1:], len(joined)], strict=True)]
        number = self._numbers(pieces)
        flat, ends = np.array(self.flat, np.int32), np.array(self.ends)
        size = ends[number + 1] - ends[number]
        total = np.cumsum(size)
        ids = flat[np.repeat(ends[number] - (total - size), size) + np.arange(total[-1])]
        owner = np.searchsorted(begin + sizes, starts, side="right")  # texts that are empty own nothing
        return ids, np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder per vocabulary and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _runner(path: str, emit: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            column = batch.column(0)
            ids, ends = own.encode(column.to_pylist())
            added = emit(own, ids, ends)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], names=[*batch.schema.names[1:], *(f"__{k}" for k in range(len(added)))])

    return run


def _apply(df: DataFrame, text: str, path: str, emit: Callable, added: list[tuple[str, T.DataType]]) -> DataFrame:
    names = [n for n, _ in added]
    keep = [c for c in df.columns if c != text and c not in names]
    rows = df.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    schema = rows.drop("__text").schema
    for k, (_, kind) in enumerate(added):
        schema = schema.add(f"__{k}", kind)
    out = rows.mapInArrow(_runner(path, emit), schema)
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"__{k}").alias(n) for k, n in enumerate(names)])


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text`` and with ``out``: its ids, without special tokens.

    Null and empty texts give an empty list; text that looks like a special token is ordinary text. No row is
    added or dropped, nothing is shuffled; a column called ``out`` is replaced, other columns stay.
    """

    def emit(_own: Encoder, ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]

    return _apply(df, text, path, emit, [(out, T.ArrayType(T.IntegerType()))])


def encode_with_offsets(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """As ``encode`` with ``ids`` and ``starts``: the place of each id's first byte in the UTF-8 text."""

    def emit(own: Encoder, ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        size = own.length[ids].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        starts = total[:-1] - np.repeat(total[ends[:-1]], np.diff(ends))
        offsets = pa.array(ends, pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(starts, pa.int32()))]

    return _apply(df, text, path, emit, [("ids", T.ArrayType(T.IntegerType())), ("starts", T.ArrayType(T.IntegerType()))])


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text`` and with ``out``: the number of its ids; 0 for null and empty texts."""

    def emit(_own: Encoder, _ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.diff(ends), pa.int64())]

    return _apply(df, text, path, emit, [(out, T.LongType())])
