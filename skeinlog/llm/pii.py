"""Personal information inside free text (problem 4).

A character-level bidirectional LSTM with CRF transitions, in numpy, tags every character. Texts are read in
overlapping windows; where windows overlap, each character takes its scores from the window in which it lies
farther from an edge, and one Viterbi path over the whole text reconciles them. The weights come from
``pii_training`` (trained from labelled spans) and lie beside this module.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "phone", "id_number", "address", "name"]
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
WINDOW, OVERLAP = 224, 64
#: Characters scored at once.
BATCH = 400_000
MODEL = os.path.join(os.path.dirname(__file__), "pii_model.npz")
SYMBOLS = 102


def _symbol_table() -> np.ndarray:
    table = np.full(0x110000, 101, np.uint8)
    table[0x3000:0x32400] = 97
    for point in range(0x3000):
        ch = chr(point)
        base = unicodedata.normalize("NFD", ch)[0]
        kind = unicodedata.category(ch)
        if 32 <= ord(base) < 127:
            table[point] = ord(base) - 31
        elif ch in "\n\r\t":
            table[point] = 96
        elif kind == "Lu":
            table[point] = 98
        elif kind[0] == "L":
            table[point] = 97
        elif kind[0] == "N":
            table[point] = 99
        elif kind == "Zs":
            table[point] = 100
    return table


def squash(x: np.ndarray, work: np.ndarray) -> None:
    """x / (1 + |x|) in place: the model's squashing function, several times cheaper than tanh."""
    np.abs(x, out=work)
    work += 1
    x /= work


class Tagger:
    """The trained model: symbols to scores, scores to the best path."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.symbols = _symbol_table()
        hidden = weights["U"].shape[1]
        self.hidden = hidden
        # The gates i, f, o are 0.5 + 0.5 squash(x / 2), so that one call serves all four.
        scale = np.ones(4 * hidden, np.float32)
        scale[: 3 * hidden] = 0.5
        self.inputs = [np.ascontiguousarray((weights["X"][d] * scale).T.astype(np.float32)) for d in (0, 1)]  # (4h, symbols)
        self.inner = np.ascontiguousarray((weights["U"] * scale).transpose(0, 2, 1).astype(np.float32))  # (2, 4h, h)
        self.out = np.ascontiguousarray(weights["V"].transpose(0, 2, 1).astype(np.float32))  # (2, tags, h)
        self.bias = weights["b"].astype(np.float32)
        self.step = weights["A"].astype(np.float32)  # from, to
        # Most that transitions can gain by another tag in the place of "none", for each of these tags.
        into, out_of = (self.step - self.step[:, :1]).max(0), (self.step - self.step[:1]).max(1)
        self.margin = np.maximum(0, into + out_of)[1:].astype(np.float32)

    def scores(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores (place, tag, window) of windows of ``symbols``, which should be of similar length."""
        n, longest, h = len(start), int(size.max()), self.hidden
        place = np.arange(longest)[:, None]
        inside = place < size
        ahead = np.where(inside, symbols[np.where(inside, start + place, 0)], 0)
        behind = np.where(inside, symbols[np.where(inside, start + size - 1 - place, 0)], 0)
        states = np.empty((longest, 2, h, n), np.float32)
        state, cell = np.zeros((2, h, n), np.float32), np.zeros((2, h, n), np.float32)
        gates, work = np.empty((2, 4 * h, n), np.float32), np.empty((2, 4 * h, n), np.float32)
        for t in range(longest):
            np.matmul(self.inner, state, out=gates)
            np.take(self.inputs[0], ahead[t], axis=1, out=work[0], mode="clip")
            np.take(self.inputs[1], behind[t], axis=1, out=work[1], mode="clip")
            gates += work
            squash(gates, work)
            gated = gates[:, : 3 * h]
            gated *= 0.5
            gated += 0.5
            cell *= gates[:, h : 2 * h]
            cell += gates[:, :h] * gates[:, 3 * h :]
            state[...] = cell
            squash(state, work[:, :h])
            state *= gates[:, 2 * h : 3 * h]
            states[t] = state
        out = np.matmul(self.out[0], states[:, 0])
        back = np.matmul(self.out[1], states[:, 1])
        out += np.take_along_axis(back, np.where(inside, size - 1 - place, place)[:, None, :], axis=0)
        out += self.bias[:, None]
        return out

    def paths(self, score: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best tags (place, text) of texts from their scores (place, tag, text).

        Where "none" leads each tag by more than its two transitions can ever make up for, every best path passes through it.
        Only the stretches between such places are decoded, each from "none" to "none" but at the text's ends.
        """
        longest, _, n = score.shape
        out = np.zeros((longest, n), np.int8)
        free = np.zeros((n, longest + 1), np.int8)
        free[:, :-1] = (((score[:, 1:] + self.margin[:, None]).max(axis=1) >= score[:, 0]) & (np.arange(longest)[:, None] < size)).T
        edges = np.flatnonzero(np.diff(free.ravel(), prepend=0))
        begin, length = edges[::2], edges[1::2] - edges[::2]
        order = np.argsort(length, kind="stable")
        for group in _groups(length[order]):
            part = order[group]
            self._decode(score, out, begin[part] % (longest + 1), begin[part] // (longest + 1), length[part], size)
        return out

    def _decode(self, score: np.ndarray, out: np.ndarray, begin: np.ndarray, column: np.ndarray, length: np.ndarray, size: np.ndarray) -> None:
        steps, tags = int(length.max()), score.shape[1]
        live = np.arange(steps)[:, None] < length
        place = begin + np.minimum(np.arange(steps)[:, None], length - 1)
        own = np.ascontiguousarray(score[place, :, column].transpose(0, 2, 1))
        back = np.empty(own.shape, np.int8)
        same = np.arange(tags, dtype=np.int8)[:, None]
        best = own[0] + np.where(begin == 0, 0, self.step[0][:, None])
        for t in range(1, steps):
            new, came = best[0] + self.step[0][:, None], back[t]
            came[...] = 0
            for k in range(1, tags):
                cand = best[k] + self.step[k][:, None]
                np.copyto(came, k, where=cand > new)
                np.maximum(new, cand, out=new)
            new += own[t]
            back[t] = np.where(live[t], came, same)
            best = np.where(live[t], new, best)
        best = best + np.where(begin + length == size[column], 0, self.step[:, 0][:, None])
        at, columns = best.argmax(axis=0).astype(np.int8), np.arange(len(begin))
        for t in range(steps - 1, -1, -1):
            here = live[t]
            out[place[t, here], column[here]] = at[here]
            if t:
                at = back[t, at, columns]

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """Tags of every character of each text; equal texts are scored once."""
        number: dict[str, int] = {}
        which = [number.setdefault(t, len(number)) for t in texts]
        unique = list(number)
        length = np.array([len(t) for t in unique], np.int64)
        symbols = self.symbols[np.frombuffer("".join(unique).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = np.cumsum(length) - length
        found: list[np.ndarray] = [np.zeros(0, np.int8)] * len(unique)
        short = np.flatnonzero((length > 0) & (length <= WINDOW))
        short = short[np.argsort(length[short], kind="stable")]
        for group in _groups(length[short]):
            part = short[group]
            tags = self.paths(self.scores(symbols, begin[part], length[part]), length[part])
            for k, some in zip(range(len(part)), tags.any(axis=0), strict=True):
                size = int(length[part[k]])
                found[part[k]] = tags[:size, k] if some else np.zeros(size, np.int8)
        long = np.flatnonzero(length > WINDOW)
        for k in range(0, len(long), 512):
            for at, tags in self._long(symbols, begin, length, long[k : k + 512]):
                found[at] = tags
        return [found[k] for k in which]

    def _long(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Texts of several windows: scores are put together before one path over each whole text."""
        starts = [[*range(0, int(n) - WINDOW, WINDOW - OVERLAP), int(n) - WINDOW] for n in length[part]]
        owner = np.repeat(np.arange(len(part)), [len(s) for s in starts])
        offset = np.array([x for s in starts for x in s])
        first = np.array([x == 0 for s in starts for x in s])
        last = np.concatenate([owner[1:] != owner[:-1], [True]])
        whole = [np.zeros((int(n), len(KINDS) + 1), np.float32) for n in length[part]]
        reach = [np.full(int(n), -1, np.int64) for n in length[part]]
        edge = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
        for a in range(0, len(owner), BATCH // WINDOW):
            own = slice(a, a + BATCH // WINDOW)
            score = self.scores(symbols, begin[part][owner[own]] + offset[own], np.full(len(owner[own]), WINDOW))
            for k in range(score.shape[2]):
                w = a + k
                mine = edge.copy()
                mine[: WINDOW // 2] = WINDOW if first[w] else mine[: WINDOW // 2]
                mine[WINDOW // 2 :] = WINDOW if last[w] else mine[WINDOW // 2 :]
                there = slice(int(offset[w]), int(offset[w]) + WINDOW)
                better = mine > reach[owner[w]][there]
                whole[owner[w]][there][better] = score[:, :, k][better]
                reach[owner[w]][there][better] = mine[better]
        order = np.argsort(length[part], kind="stable")
        for group in _groups(length[part][order]):
            ids = order[group]
            size = length[part][ids]
            score = np.zeros((int(size.max()), len(KINDS) + 1, len(ids)), np.float32)
            for k, i in enumerate(ids):
                score[: size[k], :, k] = whole[i]
            tags = self.paths(score, size)
            for k, i in enumerate(ids):
                yield int(part[i]), tags[: size[k], k]


def _groups(length: np.ndarray) -> Iterator[slice]:
    """Slices of ascending lengths that are alike and together no more than one batch."""
    at = 0
    while at < len(length):
        most = max(1, min(BATCH // int(length[at]), 4096))
        upto = min(len(length), at + most)
        # Padding costs as much as text: a group ends where it would be over a tenth longer, but not before 256 texts.
        upto = max(min(upto, at + 256), int(np.searchsorted(length[:upto], 1.1 * length[at], side="right")))
        while upto - at > 1 and (upto - at) * int(length[upto - 1]) > BATCH:
            upto -= max(1, (upto - at) // 8)
        yield slice(at, upto)
        at = upto


def items(text: str, tags: np.ndarray) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the items in a text: runs of one tag, grown to whole words."""
    if not tags.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
    runs: list[list[int]] = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        tag = int(tags[a])
        if not tag:
            continue
        a, b = int(a), int(b)
        if runs and runs[-1][2] == tag and a - runs[-1][1] <= 1:
            runs[-1][1] = b
        else:
            runs.append([a, b, tag])
    runs.sort(key=lambda r: r[0] - r[1])
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(text))
    for a, b, tag in runs:  # longer ones first
        while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
            b += 1
        kind = KINDS[tag - 1]
        if not text[a:b].strip() or any(used[a:b]):
            continue
        taken.append((a, b, kind))
        used[a:b] = b"\1" * (b - a)
    return sorted(taken)


_taggers: dict[str, Tagger] = {}


def tagger(path: str = MODEL) -> Tagger:
    """One tagger per model and worker process."""
    if path not in _taggers:
        with np.load(path) as weights:
            _taggers[path] = Tagger(dict(weights))
    return _taggers[path]


def find_items(texts: list[str | None], own: Tagger | None = None) -> list[list[tuple[int, int, str]]]:
    """Items of each text; null and empty texts have none."""
    own = own or tagger()
    plain = [t or "" for t in texts]
    return [items(t, tags) for t, tags in zip(plain, own.tag(plain), strict=True)]


def masked(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with each item replaced by its typed placeholder and all else unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def _with_texts(df: DataFrame, texts: str) -> tuple[DataFrame, list[str]]:
    keep = [c for c in df.columns if c != texts]
    return df.select(F.col(f"`{texts}`").alias("__texts"), *[F.col(f"`{c}`") for c in keep]), keep


def found_items(df: DataFrame, texts: str, path: str = MODEL) -> DataFrame:
    """``df`` without ``texts``, once per item, with ``kind`` and ``nth`` (from 1 within row and kind).

    ``texts`` is an array of texts that belong to the row, read in order; nulls in it are skipped. Nothing is
    shuffled. Rows without items, with null or empty texts give no row; repeated rows repeat their items.
    """
    rows, keep = _with_texts(df, texts)
    schema = rows.drop("__texts").schema.add("kind", T.StringType()).add("nth", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tagger(path)
        for batch in batches:
            lists = batch.column(0).to_pylist()
            flat = [t for row in lists for t in (row or [])]
            found = iter(find_items(flat, own))
            pick, kinds, nth = [], [], []
            for k, row in enumerate(lists):
                seen: dict[str, int] = {}
                for _ in row or []:
                    for _, _, kind in next(found):
                        seen[kind] = seen.get(kind, 0) + 1
                        pick.append(k)
                        kinds.append(kind)
                        nth.append(seen[kind])
            chosen = pa.array(pick, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(chosen) for c in batch.columns[1:]), pa.array(kinds, pa.string()), pa.array(nth, pa.int32())], names=[*keep, "kind", "nth"])

    return rows.mapInArrow(run, schema)


def mask_text(df: DataFrame, text: str, out: str | None = None, path: str = MODEL) -> DataFrame:
    """``df`` with ``out`` (by default ``text`` itself): the text with typed placeholders; null stays null.

    ``text`` is a text or an array of texts, each of which is masked at its place.
    """
    out = out or text
    listed = isinstance(df.schema[text].dataType, T.ArrayType)
    rows, keep = _with_texts(df, text)
    names = [c for c in keep if c != out]
    rows = rows.select("__texts", *[F.col(f"`{c}`") for c in names], *([F.col("__texts").alias("__text")] if out != text else []))
    schema = rows.drop("__texts").schema.add("__masked", T.ArrayType(T.StringType()) if listed else T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tagger(path)
        for batch in batches:
            given = batch.column(0).to_pylist()
            texts = [t for row in given for t in (row or [])] if listed else given
            done = [masked(t, f) for t, f in zip(texts, find_items(texts, own), strict=True)]
            if listed:
                each = iter(done)
                done = [None if row is None else [next(each) for _ in row] for row in given]
            column = pa.array(done, pa.list_(pa.string()) if listed else pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], column], names=[*batch.schema.names[1:], "__masked"])

    result = rows.mapInArrow(run, schema).withColumnRenamed("__masked", out)
    return result.withColumnRenamed("__text", text) if out != text else result
