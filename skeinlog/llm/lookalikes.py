"""Visually identical text with different characters (problem 10).

A mapping over code points for widths, spaces, invisible characters and look-alikes is compiled once, on the driver,
from Unicode data, the confusable characters in Spark's own Unicode library and the tables below, and checked for
conflicts. A longest-match transducer over grapheme clusters then rewrites whole batches in one pass: its classes
and outputs are arrays over all code points, cluster ends are found for the whole batch at once, clusters of one
code point are looked up as arrays, and each distinct longer cluster is worked out once.
"""

from __future__ import annotations

import glob
import hashlib
import os
import re
import struct
import unicodedata
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.runtime import cut

#: Letters of other scripts that are drawn like Latin ones; fixed values.
LOOKALIKES = dict(zip(
    "аеорсухѕіјԁԛԝһӏ" "АВЕКМНОРСТУХЅІЈҮԚԜӀ" "οϲϳ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ",
    "aeopcyxsijdqwhl" "ABEKMHOPCTYXSIJYQWI" "ocj" "ABEZHIKMNOPTYXCJ", strict=True))
#: Hyphens drawn like the plain one, and presentation forms of letter pairs; fixed values.
SIGNS = {"‐": "-", "‑": "-", "﹣": "-", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Code points that are drawn although their category says format; and invisible ones of other categories. Fixed values.
DRAWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
HIDDEN = {0x34F, 0x115F, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: All of them end a line.
BREAKS = "\r\v\f\x85  "
ZWJ = "‍"


#: Scripts whose look-alikes are in LOOKALIKES, one by one, or whose letters are not compared; by the start of Unicode names.
LISTED = ("LATIN", "CYRILLIC", "GREEK", "MATHEMATICAL", "CJK", "HANGUL", "ARABIC", "HEBREW", "KANGXI", "BOPOMOFO", "MODIFIER", "FULLWIDTH", "HALFWIDTH", "SCRIPT", "BLACK-LETTER", "DOUBLE-STRUCK", "TURNED", "KATAKANA", "HIRAGANA")


def confusables() -> dict[str, str]:
    """Letters of other scripts that Unicode lists as drawn like a Latin letter, with that letter; empty where the library is not found.

    Read from the compiled table of the ICU library among Spark's jars. Of the letters that share a drawing the one
    of the same case is taken, for a letter without case the capital.
    """
    homes = [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
    found = [path for home in homes if home for path in sorted(glob.glob(os.path.join(home, "jars", "icu4j-*.jar")))]
    if not found:
        return {}
    with zipfile.ZipFile(found[0]) as jar:
        data = jar.read("com/ibm/icu/impl/data/icudata/confusables.cfu")
    body = data[struct.unpack_from(">H", data)[0] :]
    _, _, _, keys, n, values, _, _, _ = struct.unpack_from(">9I", body)
    drawn = {}
    for key, value in zip(struct.unpack_from(f">{n}I", body, keys), struct.unpack_from(f">{n}H", body, values), strict=True):
        if key >> 24 == 0:  # drawn as one character; the upper byte counts further ones
            drawn[chr(key & 0xFFFFFF)] = chr(value)
    latin: dict[str, list[str]] = {}
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        latin.setdefault(drawn.get(c, c), []).append(c)
    out = {}
    for ch, shape in drawn.items():
        kind, name = unicodedata.category(ch), unicodedata.name(ch, "")
        fitting = latin.get(shape, [])
        if not fitting or kind not in ("Lu", "Ll", "Lo") or (name.startswith(LISTED) and ch != "ɡ"):
            continue
        same = [c for c in fitting if c.islower() == (kind == "Ll")]
        if same:
            out[ch] = same[0]
    return out


def compile_map() -> dict[str, str]:
    """Code point to its plain form, for all code points whose form differs; raises where rules conflict."""
    alike = confusables() | LOOKALIKES
    out: dict[str, str] = {}
    for point in (*range(0x32400), *range(0xE0000, 0xE0200)):
        ch = chr(point)
        kind = unicodedata.category(ch)
        if ch in BREAKS:
            new = "\n"
        elif kind == "Zs":
            new = " "
        elif point in HIDDEN or (kind == "Cf" and point not in DRAWN) or (kind == "Cc" and ch not in "\t\n"):
            new = ""
        elif ch in SIGNS:
            new = SIGNS[ch]
        elif unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")) or 0x2160 <= point <= 0x217F:
            new = unicodedata.normalize("NFKC", ch)
        else:
            new = ch
        new = "".join(alike.get(c, c) for c in unicodedata.normalize("NFD", new))
        if new != ch:
            out[ch] = new
    for ch, new in out.items():
        again = "".join(out.get(c, c) for c in new)
        if again != new:
            raise ValueError(f"conflict: {ch!r} gives {new!r}, which gives {again!r}")
    return out


#: Classes of code points: stays, has another form, belongs to the cluster before it, ends a line.
STAYS, MAPPED, EXTENDS, BREAK = 0, 1, 2, 3


class Transducer:
    """The compiled mapping as arrays; ``forms`` rewrites a batch."""

    def __init__(self, mapping: dict[str, str] | None = None) -> None:
        self.map = compile_map() if mapping is None else mapping
        self.kind = np.zeros(0x110000, np.uint8)
        self.place = np.zeros(0x110000, np.int32)
        outputs = [""]
        for ch, new in self.map.items():
            plain = unicodedata.normalize("NFC", new)
            if plain != ch:
                self.kind[ord(ch)] = MAPPED
                self.place[ord(ch)] = len(outputs)
                outputs.append(plain)
        self.size = np.fromiter(map(len, outputs), np.int64, len(outputs))
        self.out = np.zeros((len(outputs), int(self.size.max())), np.uint32)
        for k, text in enumerate(outputs):
            self.out[k, : len(text)] = [ord(c) for c in text]
        marks = [p for p in range(0x300, 0x32400) if unicodedata.category(chr(p)).startswith("M")]
        self.kind[marks] = EXTENDS
        self.kind[[ord(c) for c, new in self.map.items() if new == ""]] = EXTENDS
        self.kind[[0xFF9E, 0xFF9F, *range(0x1160, 0x1200)]] = EXTENDS
        self.kind[[ord("\r"), ord("\n")]] = BREAK
        self.known: dict[str, str] = {}

    def cluster(self, text: str) -> str:
        """Plain form of one cluster of several code points."""
        if text == "\r\n":
            return "\n"
        if ZWJ in text:  # joins pictures into another one; elsewhere it is nothing
            text = re.sub(f"(?<![\U0001f000-\U0001faff☀-➿️]){ZWJ}", "", text)
            if text.endswith(ZWJ):
                return self._plain(text[:-1]) + ZWJ
        return self._plain(text)

    def _plain(self, text: str) -> str:
        mapped = unicodedata.normalize("NFD", "".join(self.map.get(c, c) for c in text))
        return unicodedata.normalize("NFC", "".join(self.map.get(c, c) for c in mapped))

    def _known(self, text: str) -> str:
        new = self.known.get(text)
        if new is None:
            new = self.cluster(text)
            if len(text) < 64:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[text] = new
        return new

    def forms(self, texts: list[str]) -> list[str]:
        """The one form of all texts that look like each of these."""
        out = list(texts)
        pick = [k for k, t in enumerate(texts) if not (t.isascii() and t.isprintable())]
        if not pick:
            return out
        joined = "".join(texts[k] for k in pick)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter((len(texts[k]) for k in pick), np.int64, len(pick))
        begins = np.cumsum(size) - size
        kind = self.kind[points]
        head = kind != EXTENDS
        head[begins[size > 0]] = True
        # A mark does not join the end of a line before it; a line feed joins the return before it.
        follows = np.zeros(len(points), bool)
        follows[1:] = kind[:-1] == BREAK
        head |= follows
        feed = follows & (points == 10)
        feed[1:] &= points[:-1] == 13
        feed[begins[size > 0]] = False
        head &= ~feed
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(points))
        new_size = np.ones(len(points), np.int64)
        single = np.zeros(len(points), bool)
        single[starts[ends - starts == 1]] = True
        single &= self.place[points] > 0
        at = np.flatnonzero(single)
        rule = self.place[points[at]]
        new_size[at] = self.size[rule]
        longer = np.flatnonzero(ends - starts > 1)
        written = [self._known(joined[a:b]) for a, b in zip(starts[longer].tolist(), ends[longer].tolist(), strict=True)]
        inside = np.zeros(len(points), bool)
        for_long = np.repeat(np.arange(len(longer)), ends[longer] - starts[longer])
        if len(longer):
            first = np.cumsum(ends[longer] - starts[longer]) - (ends[longer] - starts[longer])
            inside[np.repeat(starts[longer], ends[longer] - starts[longer]) + np.arange(len(for_long)) - np.repeat(first, ends[longer] - starts[longer])] = True
        new_size[inside] = 0
        new_size[starts[longer]] = np.fromiter(map(len, written), np.int64, len(written))
        offset = np.cumsum(new_size) - new_size
        result = np.empty(int(new_size.sum()), np.uint32)
        plain = ~single & ~inside
        result[offset[plain]] = points[plain]
        for k in range(self.out.shape[1]):
            has = self.size[rule] > k
            result[offset[at[has]] + k] = self.out[rule[has], k]
        if len(longer):
            flat = np.frombuffer("".join(written).encode("utf-32-le", "surrogatepass"), np.uint32)
            many = new_size[starts[longer]]
            result[np.repeat(offset[starts[longer]], many) + np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)] = flat
        text = result.tobytes().decode("utf-32-le", "surrogatepass")
        cuts = np.concatenate([[0], np.cumsum(new_size)])
        for k, a, b in zip(pick, cuts[begins].tolist(), cuts[begins + size].tolist(), strict=True):
            out[k] = text[a:b]
        return out

    def plain(self, text: str) -> str:
        """The form of one text."""
        return self.forms([text])[0]


_transducers: dict[int, Transducer] = {}


def transducer(mapping: dict[str, str] | None = None) -> Transducer:
    """One transducer per mapping and worker process."""
    key = len(mapping) if mapping is not None else -1
    if key not in _transducers:
        _transducers[key] = Transducer(mapping)
    return _transducers[key]


def plain_text(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """``df`` with ``out``: the plain form of ``text``; null for null, empty for empty.

    Forms are equal exactly where texts differ only in widths, spaces, invisible characters, the way accents
    and line ends are written, and look-alike letters. A column called ``out`` is replaced.
    """
    keep = [c for c in df.columns if c != out]
    rows = df.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    mapping = transducer().map

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(mapping)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            forms = pa.array([None if t is None else f for t, f in zip(texts, own.forms([t or "" for t in texts]), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], forms], names=[*batch.schema.names[1:], "__form"])

    schema = rows.drop("__text").schema.add("__form", "string")
    return rows.mapInArrow(run, schema).withColumnRenamed("__form", out)


def _keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, form_key, text_key``: digests of the plain form and the text, of rows with visible text."""

    mapping = transducer().map

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(mapping)
        for batch in batches:
            ids, forms, texts = [], [], []
            given = batch.column(1).to_pylist()
            for i, t, form in zip(batch.column(0).to_pylist(), given, own.forms(given), strict=True):
                if form.strip():
                    ids.append(i)
                    forms.append(hashlib.blake2b(form.encode(), digest_size=16).digest())
                    texts.append(hashlib.blake2b(t.encode(), digest_size=16).digest())
            yield pa.record_batch({"id": pa.array(ids, pa.int64()), "form_key": pa.array(forms, pa.binary()), "text_key": pa.array(texts, pa.binary())})

    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "id bigint, form_key binary, text_key binary")


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, class_id, n_spellings, n_links``: one row per document with visible text.

    ``class_id`` is the smallest id among the documents that look the same, ``n_spellings`` the number of different
    texts among them and ``n_links`` the number of documents that look the same but are written differently. Rows
    without visible text or without a key have no row; a key that occurs twice counts once. Counts are combined
    before the shuffle; no pairs are made.
    """
    rows = cut(_keys(df, key, text).distinct())
    spelled = rows.groupBy("form_key", "text_key").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    formed = spelled.groupBy("form_key").agg(F.sum("copies").alias("documents"), F.min("least").alias("class_id"), F.count("*").alias("n_spellings"))
    sized = cut(spelled.join(formed, "form_key").select("text_key", "class_id", "n_spellings", (F.col("documents") - F.col("copies")).alias("n_links")))
    return rows.join(sized, "text_key").select("id", "class_id", F.col("n_spellings").cast("int").alias("n_spellings"), "n_links")


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", split: int = 20_000) -> DataFrame:
    """``a, b`` (a < b): keys of all pairs of rows whose texts look the same but differ in code points.

    Rows without visible text or without a key are in no pair; exact copies are no pair, but each copy pairs
    with each row of another spelling; a key that occurs twice counts once. Only digests are shuffled. Classes
    of equal texts are paired first, within forms that have several spellings; a class of over ``split`` rows
    is spread over several tasks when its rows are joined.
    """
    rows = _keys(df, key, text).distinct()
    classes = rows.groupBy("form_key", "text_key").agg(F.count("*").alias("n"))
    several = classes.groupBy("form_key").agg(F.count("*").alias("spellings")).where("spellings > 1").select("form_key")
    kept = cut(rows.join(several, "form_key", "left_semi"))
    sized = kept.groupBy("form_key", "text_key").agg(F.ceil(F.count("*") / split).cast("int").alias("parts"))
    left = sized.select("form_key", F.col("text_key").alias("left_key"), F.col("parts").alias("left_parts"))
    right = sized.select("form_key", F.col("text_key").alias("right_key"), F.col("parts").alias("right_parts"))
    pairs = left.join(right, "form_key").where("left_key < right_key").select(
        "left_key", "right_key", "right_parts", F.col("left_parts"), F.explode(F.sequence(F.lit(0), F.col("left_parts") - 1)).alias("left_part")
    )
    members = kept.join(sized, ["form_key", "text_key"]).select("text_key", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    a = members.select(F.col("text_key").alias("left_key"), F.col("part").alias("left_part"), F.col("id").alias("x"))
    b = members.select(F.col("text_key").alias("right_key"), F.col("part").alias("right_part"), F.col("id").alias("y"))
    half = pairs.join(a, ["left_key", "left_part"]).select("right_key", "x", F.explode(F.sequence(F.lit(0), F.col("right_parts") - 1)).alias("right_part"))
    both = half.join(b, ["right_key", "right_part"])
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
