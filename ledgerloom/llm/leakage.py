"""Evaluation texts leaking into training text.

Template canonicalisation.  Texts are brought to NFKC and lower case and
stripped of everything but letters and digits; in that stream numbers and the
units after them become typed placeholders.  Windows of the resulting template
are hashed on both sides and joined by key, and the slots under the placeholders
are checked:

* *verbatim* leaks: windows of equal template whose slots are equal propose an
  alignment, around which an exact run of ``MIN_RUN`` characters is demanded;
* *re-parameterised* questions: sentences of the items with equal skeletons
  (names become placeholders too) are one template.  Its windows between the
  names are chained in a document; what stands in the gaps must map one to one
  to the names.

Every verbatim leak proposes itself: canonicalisation is local (a placeholder
depends on at most ``MARGIN`` characters around it), so a window that lies that
far inside a run of ``MIN_RUN`` characters has the same template in any context.
For every such run of an item the window that is *rarest* among the items is
registered; a run whose digits leave no whole template window registers a window
of its plain characters instead.

Scale: items are prepared in tasks (counts by key, nothing per character on the
driver); what goes through the driver is a bitmap of the registered windows of at
most ``2 ** MAX_BITS`` bits, however many items there are.  Documents are scanned
once, whole, in one narrow pass; only windows that the bitmap knows leave it,
with the 192 characters around them, and meet the items in a keyed join.  As the
rarest windows are registered, a window is shared by many items only if a whole
run of 50 characters is, and then all of them are results.  Items of one template
are one class: a re-parameterised document gives one row a template, not a row an
item.

Defined results: null, empty or short texts and items leak nothing; rows with a
null id are left out; a document and an item give one verbatim row.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_RUN = 50
#: Characters at either end of a run whose placeholders may depend on what stands outside of it.
MARGIN = 8
#: Template characters of a window.
WINDOW = 12
#: Characters kept before and after a window's start; a run through a registered window reaches at most 42 of them.
BEFORE = AFTER = 96
#: A template stretch of so many characters with consistent slots is a re-parameterised question.
MIN_TEMPLATE = 40
#: Longest text of a name's slot.
MAX_SLOT = 24
#: A word of letters in at most this share of the items (or two of them) is a name.
NAME_SHARE = 0.01
MAX_BITS = 28

NUMBER, UNIT, NAME = "", "", ""

# Units that follow a number; none is longer than MARGIN.
UNIT_WORDS = ("백만원", "천원", "억원", "조원", "원", "톤", "회", "도", "번째", "조", "일", "월", "년", "분기", "명", "개", "건", "기", "배", "천톤", "lots", "million", "billion", "thousand", "percent", "times", "days", "tons")

DROP = re.compile(r"[\W_]+")
WORDS = re.compile(r"[^\W_]+")
DIGITS = re.compile(r"\d+")
_UNITS = "|".join(sorted(UNIT_WORDS, key=len, reverse=True))
MEASURED = re.compile(r"\d+(?:" + _UNITS + ")")
SLOT = re.compile(r"(\d+)(" + _UNITS + r")?")
SENTENCE = re.compile(r"(?<=[.?!。])\s+")


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def stream(text: str | None) -> str:
    """NFKC, lower case, letters and digits only."""
    return DROP.sub("", folded(text)) if text else ""


def template(text: str) -> str:
    """A stream with its numbers and their units as placeholders."""
    return DIGITS.sub(NUMBER, MEASURED.sub(NUMBER + UNIT, text))


def places(text: str) -> np.ndarray:
    """The start in the stream of every template character, and at the end the stream's length."""
    starts: list[np.ndarray] = []
    at = 0
    for m in SLOT.finditer(text):
        starts += [np.arange(at, m.start()), [m.start(1)]]
        if m[2]:
            starts.append([m.start(2)])
        at = m.end()
    return np.concatenate([*starts, np.arange(at, len(text) + 1)]).astype(np.int64)


def window_hashes(text: str, k: int = WINDOW, seed: int = 0) -> np.ndarray:
    """A polynomial hash of every window of k characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(c) < k:
        return np.empty(0, dtype=np.uint64)
    h = np.full(len(c) - k + 1, seed, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : len(c) - k + 1 + i]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
    return h


def slots_hash(text: str) -> int:
    """Of what stands under a window, its slots included."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def around(text: str, at: int, pad: str) -> str:
    """The characters from BEFORE before a place to AFTER after it, padded at the ends of the text."""
    cut = text[max(0, at - BEFORE) : at + AFTER]
    return (pad * max(0, BEFORE - at) + cut).ljust(BEFORE + AFTER, pad)


PLAIN_SEED = 1


def item_windows(text: str) -> list[tuple[int, int, int, int]]:
    """(hash, slots, start, end) of every template window of a stream that a run may register."""
    at = places(text)
    short = template(text)
    out = []
    for i, h in enumerate(window_hashes(short).view(np.int64).tolist()):
        a, e = int(at[i]), int(at[i + WINDOW])
        if e - a <= MIN_RUN - 2 * MARGIN:
            out.append((h, slots_hash(text[a:e]), a, e))
    return out


def rarest_windows(text: str, windows: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(hash, slots, start): for every run of MIN_RUN characters its rarest window, (n, hash, slots, start, end) being given."""
    runs = len(text) - MIN_RUN + 1
    if runs <= 0:
        return []
    open_runs = np.ones(runs, dtype=bool)
    chosen = []
    for _, h, slots, a, e in sorted(windows):
        served = slice(max(0, e - MIN_RUN + MARGIN), max(0, min(runs, a - MARGIN + 1)))
        if open_runs[served].any():
            open_runs[served] = False
            chosen.append((h, slots, a))
    # digits left these runs no whole template window: plain characters, every slot taken literally
    plain = window_hashes(text, WINDOW, PLAIN_SEED).view(np.int64)
    for s in np.nonzero(open_runs)[0].tolist():
        if open_runs[s]:
            a = s + MIN_RUN - MARGIN - WINDOW
            open_runs[max(0, a + WINDOW - MIN_RUN + MARGIN) : a - MARGIN + 1] = False
            chosen.append((int(plain[a]), slots_hash(text[a : a + WINDOW]), a))
    return chosen


WINDOWS = "h bigint, slots bigint, item_id bigint, place int, around string"


def registered_windows(items: DataFrame) -> DataFrame:
    """The rarest windows of the runs of every item (columns id, text): WINDOWS, and whether plain."""

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, *w) for i, text in zip(pdf["id"], pdf["text"], strict=True) for w in item_windows(stream(text))]
            yield pd.DataFrame(rows, columns=["id", "h", "slots", "a", "e"])

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, text, windows in zip(pdf["id"], pdf["text"], pdf["windows"], strict=True):
                plain = stream(text)
                known = [(w["n"], w["h"], w["slots"], w["a"], w["e"]) for w in windows] if windows is not None else []
                rows += [(h, slots, i, a, around(plain, a, "\x00")) for h, slots, a in rarest_windows(plain, known)]
            yield pd.DataFrame(rows, columns=["h", "slots", "item_id", "place", "around"])

    every = items.mapInPandas(spread, "id bigint, h bigint, slots bigint, a int, e int")
    n = every.groupBy("h", "slots").agg(F.count(F.lit(1)).alias("n"))
    # an item's windows are as many as its characters
    of_item = every.join(n, ["h", "slots"]).groupBy("id").agg(F.collect_list(F.struct("n", "h", "slots", "a", "e")).alias("windows"))
    return items.join(of_item, "id", "left").mapInPandas(choose, WINDOWS)


def marked_names(plain: str, spans: list, start: int, end: int) -> str:
    """A stretch of a stream as template, each name kept between NAME signs."""
    out, at = [], start
    for a, e in spans:
        if start <= a and e <= end:
            out += [template(plain[at:a]), NAME, plain[a:e], NAME]
            at = e
    return "".join([*out, template(plain[at:end])])


def sentence_templates(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items' sentences as templates: (template windows, members).

    Windows: h, template (a hash of the skeleton), place (template position), and
    where no window without names begins right before or after it, lead and gap: the
    text up to the sentence's start and up to the next such window, names marked.
    Members: template, item_id, first (the smallest item) and items (their number).
    """

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, w) for i, text in zip(pdf["id"], pdf["text"], strict=True) for w in {w for w in WORDS.findall(folded(text)) if len(w) >= 3 and w.isalpha()}]
            yield pd.DataFrame(rows, columns=["id", "word"])

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, text, names in zip(pdf["id"], pdf["text"], pdf["names"], strict=True):
                own = re.compile("|".join(sorted(map(re.escape, names), key=len, reverse=True))) if names is not None and len(names) else None
                for sentence in SENTENCE.split(text):
                    plain = stream(sentence)
                    skeleton = template(own.sub(NAME, plain) if own else plain)
                    if len(skeleton) - skeleton.count(NAME) >= MIN_TEMPLATE:
                        spans = [(m.start(), m.end()) for m in own.finditer(plain)] if own else []
                        rows.append((slots_hash(skeleton), i, plain, [list(s) for s in spans]))
            yield pd.DataFrame(rows, columns=["template", "item_id", "plain", "spans"])

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for t, plain, spans in zip(pdf["template"], pdf["plain"], pdf["spans"], strict=True):
                at = places(plain)
                named = np.zeros(len(plain) + 1, dtype=bool)
                for a, e in spans:
                    named[a:e] = True
                hashes = window_hashes(template(plain)).view(np.int64).tolist()
                free = [p for p in range(len(hashes)) if not named[at[p] : at[p + WINDOW]].any()]
                for n, p in enumerate(free):
                    follower = free[n + 1] if n + 1 < len(free) else None
                    gap = marked_names(plain, spans, int(at[p + WINDOW]), len(plain) if follower is None else int(at[follower])) if follower != p + 1 else None
                    rows.append((hashes[p], t, p, gap, marked_names(plain, spans, 0, int(at[p])) if n == 0 else None))
            yield pd.DataFrame(rows, columns=["h", "template", "place", "gap", "lead"])

    number = F.greatest(F.lit(2), F.lit(NAME_SHARE) * F.col("n_items"))
    of = items.mapInPandas(words, "id bigint, word string")
    seen = of.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(items.agg(F.count(F.lit(1)).alias("n_items"))))
    names = of.join(seen.filter(F.col("n") <= number).select("word"), "word").groupBy("id").agg(F.collect_list("word").alias("names"))
    sentences = items.join(names, "id", "left").mapInPandas(split, "template bigint, item_id bigint, plain string, spans array<array<int>>")
    first = sentences.groupBy("template").agg(F.min_by(F.struct("plain", "spans"), F.struct("item_id", "plain")).alias("r"), F.min("item_id").alias("first"), F.count_distinct("item_id").alias("items"))
    members = sentences.select("template", "item_id").distinct().join(first.select("template", "first", "items"), "template")
    return first.select("template", "r.plain", "r.spans").mapInPandas(windows, "h bigint, template bigint, place int, gap string, lead string"), members


def bitmap(hashes: DataFrame) -> np.ndarray:
    """One bit a hash (column h), 512 bits room for each up to ``2 ** MAX_BITS``; built in tasks, read to the driver when the plan is built."""
    n = max(1, hashes.distinct().count())
    bits = min(MAX_BITS, max(16, int(np.ceil(np.log2(512 * n)))))
    place = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - bits}) & 63 AS INT))")).alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def known_windows(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Indices of the hashes whose bit is set."""
    bits = len(words).bit_length() - 1 + 6
    at = h >> np.uint64(64 - bits)
    return np.nonzero((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))[0]


def document_windows(documents: DataFrame, words: np.ndarray, plain: bool) -> DataFrame:
    """The windows of the documents (doc_id, text) that the bitmap knows: h, slots, doc_id, place, template_place, around."""
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in frames:
            ids = pdf["doc_id"].tolist()
            texts = [stream(t) for t in pdf["text"]]
            rows = []
            for seed in (0, PLAIN_SEED) if plain else (0,):
                short = [template(t) for t in texts] if not seed else texts
                starts = np.cumsum([0, *(len(t) + 1 for t in short)])
                # the whole batch together; windows that span two texts hold a separator and match nothing
                h = window_hashes("￿".join(short) + "￿", WINDOW, seed)
                hit = known_windows(h, known)
                owner = np.searchsorted(starts, hit, "right") - 1
                for n in np.unique(owner).tolist():
                    text = texts[n]
                    at = places(text) if not seed else np.arange(len(text) + 1)
                    for i in hit[owner == n].tolist():
                        p = i - int(starts[n])
                        if p + WINDOW < len(at):
                            a, e = int(at[p]), int(at[p + WINDOW])
                            rows.append((int(h[i].view(np.int64)), slots_hash(text[a:e]), ids[n], a, p, e - a, around(text, a, "\x01")))
            yield pd.DataFrame(rows, columns=["h", "slots", "doc_id", "place", "template_place", "span", "around"])

    return documents.mapInPandas(scan, "h bigint, slots bigint, doc_id bigint, place int, template_place int, span int, around string")


def verbatim_runs(met: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift, start, end) of every run of at least MIN_RUN equal characters around windows that met."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                continue
            a, b = (np.frombuffer("".join(pdf[c]).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(pdf), BEFORE + AFTER) for c in ("item_around", "around"))
            same = a == b
            left = np.cumprod(same[:, :BEFORE][:, ::-1], axis=1).sum(1)
            right = np.cumprod(same[:, BEFORE:], axis=1).sum(1)
            start = pdf["item_place"].to_numpy() - left
            found = pd.DataFrame({"doc_id": pdf["doc_id"], "item_id": pdf["item_id"], "shift": pdf["place"] - pdf["item_place"], "start": start, "end": start + left + right})
            yield found[found["end"] - found["start"] >= MIN_RUN]

    return met.mapInPandas(check, "doc_id bigint, item_id bigint, shift int, start int, end int")


def _prepared(frame: DataFrame, id_column: str, text_column: str, name: str) -> DataFrame:
    return frame.filter(F.col(id_column).isNotNull() & (F.length(text_column) > 0)).select(F.col(id_column).cast("bigint").alias(name), F.col(text_column).alias("text"))


def _verbatim(hits: DataFrame, windows: DataFrame) -> DataFrame:
    sought = windows.select("h", "slots", "item_id", F.col("place").alias("item_place"), F.col("around").alias("item_around"))
    return verbatim_runs(hits.join(sought, ["h", "slots"]))


def _has_plain(items: DataFrame) -> bool:
    """Whether digits leave some run of some item no template window."""

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = False
            for text in map(stream, pdf["text"]):
                covered = np.zeros(max(0, len(text) - MIN_RUN + 1), dtype=bool)
                for _, _, a, e in item_windows(text):
                    covered[max(0, e - MIN_RUN + MARGIN) : max(0, a - MARGIN + 1)] = True
                found |= not covered.all()
            yield pd.DataFrame({"plain": [found]})

    return bool(items.mapInPandas(test, "plain boolean").agg(F.max("plain")).first()[0])


def verbatim_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id) of every document that shares a run of MIN_RUN characters with an item."""
    docs, tests = _prepared(documents, doc_id, text, "doc_id"), _prepared(items, item_id, text, "id")
    windows = registered_windows(tests)
    hits = document_windows(docs, bitmap(windows.select("h")), _has_plain(tests))
    return _verbatim(hits, windows).select("doc_id", "item_id").distinct()


def slots_between(marked: str, text: str, from_end: bool, whole: bool) -> tuple[list[tuple[str, str]], int]:
    """(name, what stands in its slot) for the names of a marked stretch, and the other characters that agree.

    ``text`` is the document's; with ``whole`` it must match throughout, else as
    many parts as do, counted from the window the stretch lies at.
    """
    parts = marked.split(NAME)  # literal, name, literal, ...
    text = template(text)
    tokens = [(x, i % 2 == 1) for i, x in enumerate(parts) if x]
    for n in range(len(tokens), 0, -1):
        kept = tokens[-n:] if from_end else tokens[:n]
        pattern = "".join("(.{1,%d}?)" % MAX_SLOT if name else re.escape(x) for x, name in kept)
        if whole:
            m = re.fullmatch(pattern, text, re.S)
        else:
            # a name at the open end has no literal to end its slot
            if kept[0 if from_end else -1][1]:
                continue
            m = re.search(pattern + r"\Z", text, re.S) if from_end else re.match(pattern, text, re.S)
        if m:
            return list(zip([x for x, name in kept if name], m.groups(), strict=True)), sum(len(x) for x, name in kept if not name)
        if whole:
            break
    return [], -1 if whole and tokens else 0


def chained(group: list[tuple]) -> int:
    """Template characters of the longest chain of windows whose slots map one to one to the names.

    ``group`` holds the windows of a document that met a template, (template place
    in the document, place in it, its span, template place in the template, text
    around, gap, lead), in order of the document.
    """
    best = covered = 0
    forth: dict[str, str] = {}
    back: dict[str, str] = {}

    def agree(slots: list[tuple[str, str]]) -> bool:
        return all(forth.setdefault(name, slot) == slot and back.setdefault(slot, name) == name for name, slot in slots)

    last: tuple | None = None
    for row in [*group, None]:
        if row is not None and last is not None and row[3] - last[3] == row[0] - last[0] == 1:
            covered += 1
            last = row
            continue
        if last is not None:
            after = last[4][BEFORE + last[2] :]
            if row is not None and last[5] is not None and 0 < row[1] - last[1] - last[2] <= AFTER - last[2]:
                slots, literal = slots_between(last[5], after[: row[1] - last[1] - last[2]], False, True)
                if literal >= 0 and row[3] > last[3] and agree(slots):
                    covered += literal + WINDOW
                    last = row
                    continue
            if last[5] is not None:
                slots, literal = slots_between(last[5], after, False, False)
                covered += literal if agree(slots) else 0
            best = max(best, covered)
        if row is not None:
            covered, forth, back = WINDOW, {}, {}
            if row[6] is not None:
                slots, literal = slots_between(row[6], row[4][:BEFORE], True, False)
                covered += literal if agree(slots) else 0
        last = row
    return best


def template_leaks(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, template, template_run) of the documents that follow a template with consistent slots."""

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["template_place", "item_place"]).sort_values(["template_place", "item_place"])
        columns = [pdf[c].where(pdf[c].notna(), None).tolist() for c in ("template_place", "place", "span", "item_place", "around", "gap", "lead")]
        run = chained(list(zip(*columns, strict=True)))
        return pd.DataFrame({"doc_id": pdf["doc_id"][:1], "template": pdf["template"][:1], "template_run": run})[: int(run >= MIN_TEMPLATE)]

    met = hits.join(windows.withColumnRenamed("place", "item_place"), "h")
    return met.groupBy("doc_id", "template").applyInPandas(check, "doc_id bigint, template bigint, template_run int")


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, kind, run, template_run, items).

    kind is verbatim (a row a document and item; run is its longest shared run),
    or reparameterised: a row a document and template, named by the template's
    smallest item, ``items`` being the number of items that share the template;
    not listed where the document holds one of them verbatim.
    """
    docs, tests = _prepared(documents, doc_id, text, "doc_id"), _prepared(items, item_id, text, "id")
    windows = registered_windows(tests)
    of_templates, members = sentence_templates(tests)
    hits = document_windows(docs, bitmap(windows.select("h").unionByName(of_templates.select("h"))), _has_plain(tests))
    # overlapping runs of one alignment are one run; an alignment has at most as many as the item has characters
    runs = _verbatim(hits, windows).groupBy("doc_id", "item_id", "shift").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"))
    longest = F.expr(
        "aggregate(runs, named_struct('s', 0, 'e', -1, 'best', 0), (acc, r) -> named_struct('s', if(r.start <= acc.e, acc.s, r.start), 'e', if(r.start <= acc.e, greatest(acc.e, r.end), r.end), "
        "'best', greatest(acc.best, if(r.start <= acc.e, greatest(acc.e, r.end) - acc.s, r.end - r.start)))).best"
    )
    verbatim = runs.select("doc_id", "item_id", longest.alias("run")).groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))
    held = verbatim.join(members.select("item_id", "template"), "item_id").select("doc_id", "template").distinct()
    followed = template_leaks(hits, of_templates).join(held, ["doc_id", "template"], "left_anti")
    named = followed.join(members.select("template", "first", "items").distinct(), "template").groupBy("doc_id", F.col("first").alias("item_id")).agg(F.max("template_run").alias("template_run"), F.max("items").alias("items"))
    return verbatim.select("doc_id", "item_id", F.lit("verbatim").alias("kind"), "run", F.lit(0).alias("template_run"), F.lit(1).cast("bigint").alias("items")).unionByName(
        named.select("doc_id", "item_id", F.lit("reparameterised").alias("kind"), F.lit(0).alias("run"), "template_run", "items")
    )
