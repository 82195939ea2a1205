"""Garbled text from wrong character encoding.

A smoothed character bigram model is trained on the clean records of the whole
collection.  Clean are the records in which no wrong decoding could have
produced anything (runs of Hangul alone are taken as clean there).  For every run
of characters that some wrong decoding could have produced, every candidate
encode-decode chain that applies, of one step or of two with any codecs, is scored
by the model in its context; the likeliest is accepted if its characters are
known to the model and it beats the text as it stands by more than a margin per
character.

The margin is validated on records that the model it is measured with has not
counted: those chosen by a hash of their text (one in ``HELD_OUT``), all of them,
garbled on purpose.  Right repairs give one histogram of gains, the best of the
wrong repairs of the same texts another, and the margin lies between them.  Both
depend on the set of texts only, not on their order or partitioning.

Scale: counting is one pass with local arrays, merged by one small shuffle;
models are tables of ``BUCKETS`` hashed bigrams and 65,536 characters, histograms
have fixed bins, so what is collected and broadcast has the same size for any
collection.  Repair is one narrow pass over whole texts.  Training and validation
are jobs that run while the plan is built.

Defined results: null and empty texts are no case; lost characters (U+FFFD,
C1 controls, runs of question marks in the place of words) are a case that
cannot be restored; where a text holds both, the restorable runs are restored
and the status is ``partial``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20
#: One text in so many is held out for validation.
HELD_OUT = 16
#: Margin, in nats a restored character, of a collection without a text to validate it on.
MARGIN = 8.0
#: Bins of the histograms of gains, in nats a character.
LOWEST, STEP, BINS = -20.0, 0.1, 600
#: Shares of right repairs that may fall below the margin and of wrong ones that may lie above it.
MISSED, FALSE = 0.01, 0.001
#: Share of a repair's characters the model must know.
KNOWN_SHARE = 0.8
LAMBDA = 0.85

LOST = re.compile("[\ufffd\x80-\x84\x86-\x9f]")
QUESTION_RUN = re.compile(r"(?<![\w?])\?{2,}(?=[\s|]|$)")
HIGH_RUN = re.compile(r"[^\x00-\x7f]+")


def _western() -> dict[str, int]:
    """Windows-1252 with the bytes it leaves open, and Latin-1, in one table."""
    table = {chr(b): b for b in range(0x80, 0x100)}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            pass
    return table


WESTERN = _western()


def _single_byte(codec: str) -> dict[str, int]:
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    return table


#: Wrong decodings by one byte a character, as tables back to the byte.
SINGLE = {"western": WESTERN, **{c: _single_byte(c) for c in ("mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_15")}}
#: Wrong decodings by several bytes a character.
MULTI = ("gbk", "big5", "cp932", "cp949")
TRUE = ("utf-8", "cp949")


def undo(run: str, wrong: str, true: str, least: int = 4) -> str | None:
    """The run encoded back by the wrong codec and decoded by the true one; null if that fails."""
    try:
        if wrong in SINGLE:
            table = SINGLE[wrong]
            raw = bytes(table[ch] for ch in run)
        else:
            raw = run.encode(wrong)
        if true == "cp949" and (len(raw) < least or raw[0] < 0x81):
            return None
        text = raw.decode(true)
    except (UnicodeError, KeyError):
        return None
    return text if text != run else None


def encodable(wrong: str) -> Callable[[str], bool]:
    if wrong in SINGLE:
        return SINGLE[wrong].__contains__

    def test(ch: str) -> bool:
        try:
            ch.encode(wrong)
        except UnicodeError:
            return False
        return True

    return test


def sub_runs(run: str, wrong: str, memo: dict) -> Iterator[tuple[int, int]]:
    """Maximal parts of a non-ASCII run that the wrong codec can encode."""
    test = encodable(wrong)
    start = None
    for i, ch in enumerate(run):
        ok = memo.get((wrong, ch))
        if ok is None:
            ok = memo[wrong, ch] = test(ch)
        if ok and start is None:
            start = i
        elif not ok and start is not None:
            yield start, i
            start = None
    if start is not None:
        yield start, len(run)


def _undoable_hangul() -> str:
    """Hangul syllables whose CP949 bytes are one UTF-8 character."""
    found = []
    for lead in range(0xC2, 0xE0):
        for trail in range(0x80, 0xC0):
            try:
                ch = bytes([lead, trail]).decode("cp949")
            except UnicodeDecodeError:
                continue
            if "가" <= ch <= "힣":
                found.append(ch)
    return "".join(found)


#: Runs with something else than Hangul syllables in them.
SUSPECT_RUN = re.compile(r"(?<![^\x00-\x7f])[가-힣]*+[^\x00-\x7f가-힣][^\x00-\x7f]*")
#: Runs of Hangul alone that a chain can undo: CP949 is the only wrong codec that makes Hangul, and each syllable must be one character of it.
HANGUL_RUN = re.compile("[" + _undoable_hangul() + r"]{2,}+(?![^\x00-\x7f])")
#: What runs and characters came to is kept for so many of them.
MEMO = 300_000
CHAINS = [(wrong, true) for wrong in (*SINGLE, *MULTI) for true in TRUE if wrong != true]


def undone_run(run: str, memo: dict) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, replacement, chain) of every part of a run that a chain of one or two steps can undo."""
    for wrong in (*SINGLE, *MULTI):
        for start, end in sub_runs(run, wrong, memo):
            if end - start < 2:
                continue
            part = run[start:end]
            for true in TRUE:
                if wrong == true:
                    continue
                fixed = undo(part, wrong, true)
                if fixed is None:
                    continue
                yield start, end, fixed, f"{wrong}>{true}"
                first = next((ch for ch in fixed if not ch.isascii()), None)
                for w, t in CHAINS if first is not None else ():
                    # a second step must be able to encode the first character at least
                    if (ok := memo.get((w, first))) is None:
                        ok = memo[w, first] = encodable(w)(first)
                    if ok and (again := repeat(fixed, w, t)) is not None:
                        yield start, end, again, f"{wrong}>{true} {w}>{t}"


def candidates(text: str, memo: dict, hangul: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, replacement, chain) of every run that a chain can undo."""
    found = []
    for m in SUSPECT_RUN.finditer(text):
        run = m[0]
        if len(run) < 2:
            continue
        undone = memo.get(run)
        if undone is None:
            if len(memo) > MEMO:
                memo.clear()
            undone = memo[run] = list(undone_run(run, memo))
        found += [(m.start() + start, m.start() + end, fixed, chain) for start, end, fixed, chain in undone]
    for m in HANGUL_RUN.finditer(text) if hangul else ():
        # asked here, as the pattern is faster without a look behind at every character
        if m.start() and not text[m.start() - 1].isascii():
            continue
        fixed = undo(m[0], "cp949", "utf-8")
        if fixed is not None:
            found.append((m.start(), m.end(), fixed, "cp949>utf-8"))
    return found


def repeat(text: str, wrong: str, true: str) -> str | None:
    """A second chain applied to the non-ASCII runs of a first one's result; null if it does not apply throughout."""
    if text.isascii():
        return None
    parts = []
    at = 0
    for m in HIGH_RUN.finditer(text):
        fixed = undo(m[0], wrong, true)
        if fixed is None:
            return None
        parts += [text[at : m.start()], fixed]
        at = m.end()
    return "".join([*parts, text[at:]])


def char_codes(text: str) -> np.ndarray:
    """Code points, those beyond the basic plane folded into it."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) & 0xFFFF


def bigram_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(44)).astype(np.int64)


@dataclass
class Model:
    """Interpolated bigram model over hashed counts."""

    unigrams: np.ndarray
    bigrams: np.ndarray

    def __post_init__(self) -> None:
        total = self.unigrams.sum()
        self.base = (self.unigrams + 0.1) / (total + 0.1 * 65536)

    def log_likelihood(self, text: str) -> float:
        """Of the text's characters, each given the one before; the first is context only."""
        c = char_codes(text)
        if len(c) < 2:
            return 0.0
        a, b = c[:-1], c[1:]
        seen = np.minimum(self.bigrams[bigram_bucket(a, b)], self.unigrams[b])
        p = LAMBDA * seen / np.maximum(self.unigrams[a], 1) + (1 - LAMBDA) * self.base[b]
        return float(np.log(p).sum())

    def gain(self, text: str, start: int, end: int, replacement: str) -> float:
        """By how much the replacement is likelier than what stands there, in context; -inf if its characters are unknown."""
        known = self.unigrams[char_codes(replacement)] > 0
        if known.mean() < KNOWN_SHARE:
            return -np.inf
        before, after = text[max(0, start - 1) : start] or "\n", text[end : end + 1] or "\n"
        return self.log_likelihood(before + replacement + after) - self.log_likelihood(before + text[start:end] + after)


def spotless(text: str, memo: dict) -> bool:
    """Nothing lost and nothing that a chain could undo: a record to train on."""
    return text.isascii() and not QUESTION_RUN.search(text) or not (LOST.search(text) or QUESTION_RUN.search(text) or candidates(text, memo, hangul=False))


def train(texts: DataFrame) -> tuple[Model, Model]:
    """The models of the clean records among ``texts`` (text, held): of all of them, and of those that are not held out."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 65536 + BUCKETS), dtype=np.int64)
        memo: dict = {}
        for pdf in frames:
            for held in (False, True):
                # counted a batch at a time, line ends between the texts
                c = char_codes("\n".join(["", *(t for t in pdf["text"][pdf["held"] == held] if t and spotless(t, memo)), ""]))
                counts[int(held), :65536] += np.bincount(c, minlength=65536)
                counts[int(held), 65536:] += np.bincount(bigram_bucket(c[:-1], c[1:]), minlength=BUCKETS)
        for held in (False, True):
            at = np.nonzero(counts[int(held)])[0]
            yield pd.DataFrame({"held": held, "i": at, "n": counts[int(held)][at]})

    total = texts.mapInPandas(count, "held boolean, i int, n bigint").groupBy("held", "i").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros((2, 65536 + BUCKETS))
    flat[total["held"].to_numpy(dtype=np.int64), total["i"].to_numpy(dtype=np.int64)] = total["n"].to_numpy(dtype=np.float64)
    every = flat.sum(0)
    return Model(every[:65536], every[65536:]), Model(flat[0, :65536], flat[0, 65536:])


def best_repairs(text: str, model: Model, margin: float, memo: dict) -> list[tuple[int, int, str, str, float]]:
    """The likeliest accepted replacement of every run, not overlapping, in order."""
    scored = [(model.gain(text, s, e, r), s, e, r, c) for s, e, r, c in candidates(text, memo)]
    taken: list[tuple[int, int, str, str, float]] = []
    for gain, s, e, r, c in sorted(scored, key=lambda x: (-x[0], x[1])):
        if gain > margin * len(r) and all(e <= t[0] or s >= t[1] for t in taken):
            taken.append((s, e, r, c, gain))
    return sorted(taken + followers(text, model, taken, memo))


def followers(text: str, model: Model, taken: list[tuple[int, int, str, str, float]], memo: dict) -> list[tuple[int, int, str, str, float]]:
    """What the chains accepted in a text undo elsewhere in it: too short to be accepted alone, any gain will do."""
    chains = dict.fromkeys(c for *_, c, _ in sorted(taken, key=lambda t: -t[4]) if " " not in c)
    more: list[tuple[int, int, str, str, float]] = []
    for chain in chains:
        wrong, true = chain.split(">")
        for m in HIGH_RUN.finditer(text):
            for start, end in sub_runs(m[0], wrong, memo):
                s, e = m.start() + start, m.start() + end
                if any(e > t[0] and s < t[1] for t in (*taken, *more)):
                    continue
                fixed = undo(text[s:e], wrong, true, 2)
                if fixed is not None and (gain := model.gain(text, s, e, fixed)) > 0:
                    more.append((s, e, fixed, chain, gain))
    return more


def repair(text: str | None, model: Model, margin: float, memo: dict) -> tuple[str, str | None, str | None] | None:
    """(status, restored text, chains) of a garbled text; null for a clean one."""
    if not text:
        return None
    lost = bool(LOST.search(text) or QUESTION_RUN.search(text))
    if text.isascii() and not lost:
        return None
    repairs = best_repairs(text, model, margin, memo)
    if not repairs and not lost:
        return None
    out, at = [], 0
    for s, e, r, _, _ in repairs:
        out += [text[at:s], r]
        at = e
    fixed = "".join([*out, text[at:]])
    chains = ", ".join(sorted({c for *_, c, _ in repairs})) or None
    if LOST.search(fixed) or QUESTION_RUN.search(fixed):
        return ("partial" if repairs else "unrestorable", fixed if repairs else None, chains)
    return "restored", fixed, chains


GARBLERS: tuple[tuple[str, str], ...] = (("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("cp949", "latin-1"), ("cp949", "gbk"))


def gains_of(text: str, model: Model, memo: dict) -> tuple[float, float] | None:
    """The gains a character of the right repair and of the best wrong one of a clean text with a word garbled on purpose.

    Word and garbling follow from the text; none if it has no word to garble so.
    """
    words = [w for w in HIGH_RUN.findall(text) if len(w) >= 2]
    if not words:
        return None
    pick = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    right, wrong = GARBLERS[pick % len(GARBLERS)]
    word = words[pick // len(GARBLERS) % len(words)]
    try:
        garbled = word.encode(right).decode(wrong)
    except UnicodeError:
        return None
    at = text.index(word)
    spoilt = text[:at] + garbled + text[at + len(word) :]
    # wrong are those that share no character with the word: others restore a part of it; and all that the clean text itself offers
    worst = [model.gain(spoilt, s, e, r) / len(r) for s, e, r, _ in candidates(spoilt, memo) if not set(r) & set(word)]
    worst += [model.gain(text, s, e, r) / len(r) for s, e, r, _ in candidates(text, memo)]
    return model.gain(spoilt, at, at + len(garbled), word) / len(word), max(worst, default=-np.inf)


def validate(texts: DataFrame, shared: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Histograms of the gains of right and of wrong repairs over the clean ones of ``texts`` (column text)."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        memo: dict = {}
        bins = np.zeros((2, BINS), dtype=np.int64)
        for pdf in frames:
            for text in pdf["text"]:
                found = gains_of(text, model, memo) if text and not text.isascii() and spotless(text, memo) else None
                for kind, gain in enumerate(found or ()):
                    bins[kind, int(np.clip((gain - LOWEST) / STEP, 0, BINS - 1)) if np.isfinite(gain) else 0] += 1
        kind, at = np.nonzero(bins)
        yield pd.DataFrame({"kind": kind, "i": at, "n": bins[kind, at]})

    total = texts.mapInPandas(measure, "kind int, i int, n bigint").groupBy("kind", "i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, BINS))
    out[total["kind"].to_numpy(dtype=np.int64), total["i"].to_numpy(dtype=np.int64)] = total["n"].to_numpy(dtype=np.float64)
    return out[0], out[1]


def margin_between(right: np.ndarray, wrong: np.ndarray) -> float:
    """The middle between the gain that all but MISSED of the right repairs reach and the one that all but FALSE of the wrong ones stay below."""
    if not right.sum():
        return MARGIN
    edge = lambda i: LOWEST + STEP * i
    reached = edge(int(np.searchsorted(np.cumsum(right), MISSED * right.sum(), "right")))
    below = edge(int(np.searchsorted(np.cumsum(wrong), (1 - FALSE) * wrong.sum())) + 1) if wrong.sum() else 0.0
    return (reached + max(below, 0.0)) / 2


def error_rates(right: np.ndarray, wrong: np.ndarray, margin: float) -> tuple[float, float]:
    """Shares of the right repairs below the margin and of the wrong ones above it."""
    at = int(np.floor((margin - LOWEST) / STEP))
    return float(right[:at].sum() / max(right.sum(), 1)), float(wrong[at + 1 :].sum() / max(wrong.sum(), 1))


def fitted(documents: DataFrame, text_column: str = "text") -> tuple[Model, float, tuple[float, float]]:
    """The model of all clean texts, the validated margin and its error rates."""
    text = F.col(text_column)
    texts = documents.select(text.alias("text"), (F.pmod(F.xxhash64(text), F.lit(HELD_OUT)) == 0).alias("held")).filter("text IS NOT NULL AND text <> ''")
    model, partial = train(texts)
    shared = documents.sparkSession.sparkContext.broadcast((partial.unigrams, partial.bigrams))
    right, wrong = validate(texts.filter("held").select("text"), shared)
    margin = margin_between(right, wrong)
    return model, margin, error_rates(right, wrong, margin)


def find_garbled(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, status, chains, restored) of every record with garbled text."""
    model, margin, _ = fitted(documents, text_column)
    shared = documents.sparkSession.sparkContext.broadcast((model.unigrams, model.bigrams, margin))
    id_type = documents.schema[id_column].dataType.simpleString()

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unigrams, bigrams, accepted = shared.value
        known = Model(unigrams, bigrams)
        seen: dict = {}
        for pdf in frames:
            found = [(key, *result) for key, text in zip(pdf["id"], pdf["text"], strict=True) if (result := repair(text, known, accepted, seen))]
            yield pd.DataFrame(found, columns=["id", "status", "restored", "chains"])

    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("text IS NOT NULL AND text <> ''")
    return rows.mapInPandas(scan, f"id {id_type}, status string, restored string, chains string").withColumnRenamed("id", id_column)
