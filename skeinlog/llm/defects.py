"""Broken prompt and response pairs (problem 3).

A multi-label linear classifier on hashed n-grams and pair features flags answers that are empty, truncated,
refusals, copies of the question or in another language. It is trained by ``defects_training`` on synthetically
truncated, copied, swapped and refused answers, with thresholds calibrated on a held-out part; weights and
thresholds lie beside this module. Pairs are scored in whole Arrow batches: token numbers, n-gram hashes and
letter triples are arrays, and the score is one sparse product. Only ids and verdicts are shuffled.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFECTS = ["empty", "truncated", "refusal", "copy", "language"]
BITS, LANGUAGE_BITS, DENSE = 15, 13, 40
MODEL = os.path.join(os.path.dirname(__file__), "defects_model.npz")

#: Languages of Latin script with a profile, then those told by their script alone.
LATIN = ["en", "de", "fr", "es", "it", "pt", "nl", "pl", "sv", "tr"]
#: First and last code points of scripts that tell a language by themselves; fixed values.
SCRIPTS = {"ru": [(0x400, 0x52F)], "el": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "ja": [(0x3040, 0x30FF), (0x4E00, 0x9FFF)], "ko": [(0xAC00, 0xD7AF)], "ar": [(0x600, 0x6FF)], "he": [(0x590, 0x5FF)], "th": [(0xE00, 0xE7F)], "hi": [(0x900, 0x97F)]}
LANGUAGES = [*LATIN, *SCRIPTS]
#: Names of languages by which a question may ask for one; fixed values.
ASKED = {
    "en": r"english|englisch\w*|anglais|inglés|inglese|английск\w*|英語", "de": r"german|deutsch\w*|allemand|alemán|tedesco|немецк\w*", "fr": r"french|französisch\w*|français|francés|francese", "es": r"spanish|spanisch\w*|espagnol|español|castellano",
    "it": r"italian|italienisch\w*|italien|italiano", "pt": r"portuguese|portugiesisch\w*|portugais|portugués|português", "nl": r"dutch|niederländisch\w*|néerlandais", "pl": r"polish|polnisch\w*|polonais|polaco", "sv": r"swedish|schwedisch\w*|suédois|sueco", "tr": r"turkish|türkisch\w*|turc|turco",
    "ru": r"russian|russisch\w*|russe|ruso|по-русски", "el": r"greek|griechisch\w*|grec|griego", "ja": r"japanese|japanisch\w*|japonais|japonés|日本語",
}
ASKS = {k: re.compile(rf"\b(?:{v})", re.I) for k, v in ASKED.items()}
ASKS_ANY = re.compile(rf"\b(?:{'|'.join(ASKED.values())})", re.I)

_VISIBLE = regex.compile(r"[^\p{Z}\p{C}ㅤᅟᅠﾠ]")
_PATH = re.compile(r"[\w.~-]*/[\w./~-]*\w")
_NAME = re.compile(r"\b(?:[A-Za-z]+_\w+|[a-z]+[A-Z]\w*|\w*\d\w*[A-Za-z]\w*)\b")
_DIGITS = re.compile(r"\d+")
_TOKENS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[‹›]\w?|[^\w\s]|\n")
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_UNSPOKEN = re.compile(r"[\W\d_‹›]+")
_SQUEEZED = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[.!?。！？]+(?:\s|$)")
_ITEM = re.compile(r"(?:[-*•]|\d+[.)])(?:\s|$)")
_BARE_ITEM = re.compile(r"[-*•]|\d+[.)]?")


def visible(text: str) -> bool:
    """Whether anything of a text can be seen."""
    return _VISIBLE.search(text) is not None


def simplified(text: str) -> str:
    """Paths, names of code and numbers each as one sign."""
    text = _NAME.sub("‹", _PATH.sub("›", text) if "/" in text else text)
    return text if text.isalpha() else _DIGITS.sub("9", text)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted different values; sorting beats hashing here several times over."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array and the length of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.fromiter(map(len, texts), np.int64, len(texts))


def _mixed(parts: list[np.ndarray], salt: int, bits: int) -> np.ndarray:
    """One hash of ``bits`` bits from several arrays of numbers."""
    h = np.full(len(parts[0]), np.uint64(salt * 2 + 1))
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _grams(values: np.ndarray, owner: np.ndarray, n: int, salt: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each run of ``n`` values of one owner."""
    if len(values) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = len(values) - n + 1
    same = owner[:last] == owner[n - 1 :]
    return owner[:last][same], _mixed([values[k : k + last][same] for k in range(n)], salt, bits)


_scripts: list[np.ndarray] = []


def _script_table() -> np.ndarray:
    """For each code point 0: no letter, 1: a letter, 2 and more: a letter of a telling script."""
    if not _scripts:
        table = np.fromiter((chr(p).isalpha() for p in range(0x30000)), np.uint8, 0x30000)
        for k, spans in enumerate(SCRIPTS.values()):
            for a, b in spans:
                table[a : b + 1] *= k + 2
        _scripts.append(table)
    return _scripts[0]


def script_shares(texts: list[str]) -> np.ndarray:
    """Number in SCRIPTS of the script that tells each text's language, -1 without one."""
    points, size = _points(texts)
    kind = _script_table()[np.minimum(points, 0x2FFFF).astype(np.int64)]
    width = len(SCRIPTS) + 2
    count = np.bincount(np.repeat(np.arange(len(texts)), size) * width + kind, minlength=len(texts) * width).reshape(-1, width)
    best = count[:, 2:].argmax(1)
    return np.where(count[:, 2:].max(1) > 0.3 * np.maximum(1, count[:, 1:].sum(1)), best, -1)


def triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each letter triple of the prose in each text: code, names, paths and numbers left out."""
    flat = [" " + _UNSPOKEN.sub(" ", _FENCED.sub(" ", s) if "```" in s else s).strip().lower() + " " for s in texts]
    points, size = _points(flat)
    return _grams(points, np.repeat(np.arange(len(texts)), size), 3, 7, LANGUAGE_BITS)


@dataclass
class Model:
    """Weights of the languages and of the defects, and the thresholds."""

    languages: np.ndarray  # (latin languages, triples) logarithms
    weights: np.ndarray | None = None  # (features, defects)
    threshold: np.ndarray | None = None
    whole: bool = True  # whether a short answer also counts as a whole

    def spoken(self, texts: list[str], plain: list[str]) -> np.ndarray:
        """Shares of the languages in each text (texts x LANGUAGES); even over the Latin ones where it says nothing."""
        n = len(texts)
        out = np.zeros((n, len(LANGUAGES)))
        if not n:
            return out
        script = script_shares(texts)
        owner, gram = triples(plain)
        count = np.bincount(owner, minlength=n)
        score = np.stack([np.bincount(owner, weights=row[gram], minlength=n) for row in self.languages], 1)
        score = (score - score.max(1, keepdims=True)) / np.sqrt(np.maximum(1, count))[:, None]
        share = np.exp(score) * (count >= 3)[:, None] + (count < 3)[:, None]
        out[:, : len(LATIN)] = share / share.sum(1, keepdims=True)
        told = script >= 0
        out[told] = 0
        out[np.flatnonzero(told), len(LATIN) + script[told]] = 1
        return out

    def features(self, questions: list[str], answers: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``row, place, value`` of the hashed features and the dense pair features (pairs x DENSE)."""
        n = len(answers)
        plain = [simplified(a) for a in answers]
        found = [_TOKENS.findall(p) for p in plain]
        number = {t: k for k, t in enumerate(set().union(*found))}
        flat = np.array([number[t] for tokens in found for t in tokens], np.int64)
        codes = np.fromiter((zlib.crc32(t.lower().encode("utf-8", "surrogatepass")) for t in number), np.uint64, len(number))
        all_codes = codes[flat] if len(flat) else np.zeros(0, np.uint64)
        size = np.fromiter(map(len, found), np.int64, n)
        owner = np.repeat(np.arange(n), size)
        line = zlib.crc32(b"\n")
        word = all_codes != line
        w, o = all_codes[word], owner[word]
        parts = [_grams(w, o, k, k, BITS) for k in (1, 2, 3)]
        key = _distinct(np.concatenate([(a << BITS) | g for a, g in parts]))
        row, place = key >> BITS, key & ((1 << BITS) - 1)
        grams = np.bincount(row, minlength=n)
        value = (3.0 / np.sqrt(np.maximum(1, grams)))[row]
        end = np.cumsum(size)
        more = []
        for k in (1, 2, 3, 4):
            have = np.flatnonzero(size >= k)
            more.append((have, _mixed([all_codes[end[have] - k + j] for j in range(k)], 10 + k, BITS), np.ones(len(have))))
        words = np.bincount(o, minlength=n)
        short = np.flatnonzero((words <= 10) & (words > 0) & self.whole)
        whole = [zlib.crc32(" ".join(t.lower() for t in found[k] if t != "\n").encode("utf-8", "surrogatepass")) for k in short]
        more.append((short, _mixed([np.array(whole, np.uint64)], 20, BITS) if len(short) else np.zeros(0, np.int64), np.full(len(short), 2.0)))
        row, place, value = (np.concatenate(x) for x in zip((row, place, value), *more, strict=True))
        dense = np.zeros((n, DENSE))
        dense[:, 0] = 1
        dense[:, 13] = words <= 12
        for k, (a, p) in enumerate(zip(answers, plain, strict=True)):
            _shape(dense[k], a, p)
        self._pair(dense, questions, answers, plain, words)
        return row, place, value, dense

    def _pair(self, dense: np.ndarray, questions: list[str], answers: list[str], plain: list[str], words: np.ndarray) -> None:
        """What question and answer have in common: runs of five letters, and the languages."""
        n = len(answers)
        qs, as_ = ([_SQUEEZED.sub("", x).casefold() for x in part] for part in (questions, answers))
        sets = []
        for part in (qs, as_):
            points, size = _points(part)
            owner, gram = _grams(points, np.repeat(np.arange(n), size), 5, 5, 40)
            few = np.flatnonzero((size > 0) & (size < 5))
            owner = np.concatenate([owner, few])
            gram = np.concatenate([gram, np.array([zlib.crc32(part[k].encode("utf-8", "surrogatepass")) for k in few], np.int64)])
            # Two passes through the same keys: sorted pairs of owner and gram.
            sets.append(_distinct(_mixed([owner, gram], 6, 63).astype(np.uint64) >> np.uint64(24) | (owner.astype(np.uint64) << np.uint64(39))))
        here = [np.bincount((s >> np.uint64(39)).astype(np.int64), minlength=n)[:n] for s in sets]
        both = np.bincount((np.intersect1d(*sets, assume_unique=True) >> np.uint64(39)).astype(np.int64), minlength=n)[:n]
        ok = (here[0] > 0) & (here[1] > 0)
        in_answer, in_question = both / np.maximum(1, here[1]), both / np.maximum(1, here[0])
        dense[:, 20], dense[:, 21] = in_answer * ok, in_question * ok
        dense[:, 22] = 2 * ok * ((in_answer > 0.6) & (in_question > 0.8))
        for k in np.flatnonzero(ok & (in_question > 0.8)):
            q, a = qs[k], as_[k]
            inside = q in a
            dense[k, 23] = 3 * (inside and (len(a) - len(q) < 18 or a.replace(q, "") == ""))
            dense[k, 24] = inside and len(a) - len(q) >= 25
        dense[:, 25] = ok * np.minimum(3.0, [len(a) / max(1, len(q)) for q, a in zip(qs, as_, strict=True)]) / 3
        lq, la = self.spoken(questions, [simplified(q) for q in questions]), self.spoken(answers, plain)
        asked = np.zeros(n)
        for k in [k for k, q in enumerate(questions) if ASKS_ANY.search(q)]:
            asked[k] = sum(la[k, LANGUAGES.index(name)] for name, p in ASKS.items() if p.search(questions[k]))
        fit = np.maximum((lq * la).sum(1), asked)
        dense[:, 30], dense[:, 31], dense[:, 32], dense[:, 33] = fit, 2 * (fit < 0.3), (fit < 0.3) * np.minimum(1.0, words / 8), 2 * (fit < 0.1)
        dense[:, 34] = la.max(1) * (1 - fit)

    def score(self, questions: list[str], answers: list[str]) -> np.ndarray:
        """Logarithmic odds of each defect (pairs x defects)."""
        row, place, value, dense = self.features(questions, answers)
        out = dense @ self.weights[1 << BITS :]
        for d in range(len(DEFECTS)):
            out[:, d] += np.bincount(row, weights=self.weights[place, d] * value, minlength=len(answers))
        return out

    def decide(self, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
        """The defect of each pair: the one farthest above its threshold; None for a sound pair."""
        if not pairs:
            return []
        questions, answers = ([x or "" for x in part] for part in zip(*pairs, strict=True))
        over = self.score(questions, answers) - self.threshold
        over[:, 0] = -np.inf  # empty is checked exactly
        best = over.argmax(1)
        return [("empty" if not visible(a) else DEFECTS[b] if over[k, b] > 0 else None) for k, (a, b) in enumerate(zip(answers, best, strict=True))]


def _shape(out: np.ndarray, answer: str, plain: str) -> None:
    """How an answer ends, and what it is made of."""
    text = answer.rstrip()
    if not text:
        out[1] = 4
        return
    end = text[-1]
    last = text.rsplit("\n", 1)[-1].strip()
    fences = answer.count("```")
    listed = _ITEM.match(last) is not None
    sentences = len(_SENTENCE.findall(plain))
    letter = end.isalnum()
    out[2] = 2 * (fences % 2)
    out[3] = 3 * (_BARE_ITEM.fullmatch(last) is not None and "\n" in text)
    out[4] = end in ".!?。！？"
    out[5] = 3 * (end in ":：")
    out[6] = letter and not listed
    out[7] = listed
    out[8] = end in ",;(-–—“«"
    out[9] = end in ")`\"'»”" or unicodedata.category(end)[0] == "S"
    out[10] = fences > 0 and fences % 2 == 0 and text.endswith("```")
    out[11] = min(sentences, 6) / 3
    out[12] = sentences <= 2
    out[14] = answer.count("(") > answer.count(")")
    out[15] = fences == 0 and last.count("`") % 2 == 1
    out[16] = 2 * (sentences >= 1 and letter and not listed)
    out[17] = sentences == 0 and "\n" not in text and len(text) < 40


_models: dict[str, Model] = {}


def model_at(path: str = MODEL) -> Model:
    """One model per file and worker process."""
    if path not in _models:
        with np.load(path) as kept:
            _models[path] = Model(kept["languages"].astype(np.float64), kept["weights"].astype(np.float64), kept["threshold"])
    return _models[path]


def answer_text(response: Column) -> Column:
    """The answer of a request: values of elements without kind and contents of markdownContent, in order."""
    return F.concat_ws("", F.transform(F.coalesce(response, F.array()), lambda e: F.when(e["kind"].isNull(), e["value"]).when(e["kind"] == "markdownContent", e["content"]["value"])))


def defective_pairs(pairs: DataFrame, path: str = MODEL) -> DataFrame:
    """``request_id, defect`` of defective pairs, at most one defect each, from ``request_id, question, answer``.

    Null and blank answers are empty; a null question counts as empty text; rows without an id are left out
    and repeated rows count once; of several different pairs of one id the one with the greatest hash counts, as
    a pair. An empty table gives no rows. Texts are scored where they are read; only ids, hashes and verdicts are
    shuffled.
    """
    rows = pairs.where("request_id is not null").select("request_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
    keyed = rows.select("request_id", F.xxhash64("question", "answer").alias("version"), "question", "answer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            questions, answers = (batch.column(k).to_pylist() for k in (2, 3))
            found = model.decide(list(zip(questions, answers, strict=True)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["request_id", "version", "defect"])

    scored = keyed.mapInArrow(run, "request_id string, version bigint, defect string")
    chosen = scored.groupBy("request_id").agg(F.max(F.struct("version", "defect")).alias("said"))
    return chosen.where("said.defect is not null").select("request_id", F.col("said.defect").alias("defect"))
