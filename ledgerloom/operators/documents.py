"""Document processing: repair, span grids, statement cells, tagged facts, passages and claims.

Parsing is one Arrow-batched pass per document; what comes out are flat rows,
and everything after that is DataFrame algebra.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.finance import unique_or_null
from ledgerloom.operators.nested import decode, parse_document

# Statement kinds by words of their heading, and units of amounts.
STATEMENTS = (("CF", "현금흐름표"), ("BS", "재무상태표"), ("SCE", "자본변동표"), ("CIS", "포괄손익계산서"), ("IS", "손익계산서"))
AMOUNT_UNITS = {"원": 1, "천원": 10**3, "백만원": 10**6, "억원": 10**8, "십억원": 10**9, "조원": 10**12}
ENTITY = re.compile(r"&(#\d+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
ELEMENT = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9_.:-]*(?:\s[^<>]*)?/?|!--.*?--|\?.*?\?|!\[CDATA\[.*?\]\])>", re.S)


def repair(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Well-formed text and a ledger of (offset, length, replacement) of what was changed.

    Stray < and & are escaped, named entities become numeric ones; a document
    type definition is refused.
    """
    if re.search(r"<!DOCTYPE|<!ENTITY", text, re.I):
        raise ValueError("document type definitions are not accepted")
    ledger: list[tuple[int, int, str]] = []
    out: list[str] = []
    at = 0

    def plain(part: str, base: int) -> str:
        def fix(m: re.Match) -> str:
            if m[0] == "<":
                new = "&lt;"
            elif m[0] == "&":
                new = "&amp;"
            else:
                name = m[1]
                if name.startswith("#") or name in ("lt", "gt", "amp", "quot", "apos"):
                    return m[0]
                char = html.unescape(m[0])
                new = "&amp;" + m[0][1:] if char == m[0] else "".join(f"&#{ord(c)};" for c in char)
            ledger.append((base + m.start(), len(m[0]), new))
            return new

        return re.sub(r"&(#\d+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|&|<", fix, part)

    for m in ELEMENT.finditer(text):
        out += [plain(text[at : m.start()], at), m[0]]
        at = m.end()
    out.append(plain(text[at:], at))
    return "".join(out), ledger


def lexical_text(text: str) -> str:
    """All character data of a document without white space."""
    return "".join(html.unescape(ELEMENT.sub("", text)).split())


def grid(rows: list[list[dict]]) -> list[dict]:
    """Cells with their place on the grid; a cell spanning rows or columns occupies them, an overlap is an error.

    Spans are kept as intervals per row, so their size costs nothing; a rowspan
    ends with the table.
    """
    taken: list[list[tuple[int, int]]] = [[] for _ in rows]
    out = []
    for r, cells in enumerate(rows):
        c = 0
        for cell in cells:
            height, width = max(1, cell["rowspan"] or 1), max(1, cell["colspan"] or 1)
            while (hit := next((stop for start, stop in taken[r] if start <= c < stop), None)) is not None:
                c = hit
            for row in taken[r : r + height]:
                if any(start < c + width and c < stop for start, stop in row):
                    raise ValueError("cells overlap")
                row.append((c, c + width))
            out.append({**cell, "row": r, "column": c})
            c += width
    return out


def number(text: str | None, multiplier: int = 1) -> int | None:
    """An amount: commas, (n), - and triangle for negatives, times the unit; null unless integral."""
    if not text:
        return None
    s = re.sub(r"[,\s]", "", text)
    negative = bool(re.fullmatch(r"\(.+\)", s)) or s[:1] in "-−△▲"
    s = s.strip("()").lstrip("-−△▲")
    if not re.fullmatch(r"\d+(\.\d+)?", s):
        return None
    try:
        value = Decimal(s) * multiplier
    except InvalidOperation:
        return None
    if value != value.to_integral_value():
        return None
    return -int(value) if negative else int(value)


def number_column(text: Column, multiplier: Column | int = 1) -> Column:
    """``number`` as a built-in expression (decimal, exact)."""
    s = F.regexp_replace(text, r"[,\s]", "")
    negative = s.rlike(r"^\(.+\)$") | s.rlike("^[-−△▲]")
    bare = F.regexp_replace(F.regexp_replace(s, r"^[(]|[)]$", ""), "^[-−△▲]", "")
    value = F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)?$"), bare.try_cast("decimal(30,4)") * (F.lit(multiplier) if isinstance(multiplier, int) else multiplier).cast("decimal(14,0)"))
    whole = F.when(value == F.floor(value), value.try_cast("bigint"))
    return F.when(negative, -whole).otherwise(whole)


def account_label(text: Column) -> Column:
    """A label without footnotes, leading numbering and white space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\((?:주|Note)[^)]*\)|주\d+\)?", ""), r"^\s*(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVX]+|[0-9]+|[가-하])[.)]\s*", ""), r"\s+", "")


def grid_cells(documents: DataFrame, raw: str = "raw_xml", key: str = "document_id") -> DataFrame:
    """One row per cell with its row and column on its table's grid; tables that overlap are left out with ``valid`` false."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, body in zip(pdf["k"], pdf["raw"], strict=True):
                for t in parse_document(body)["tables"]:
                    try:
                        placed = grid([r["cells"] for r in t["rows"]])
                        out += [(k, t["table_no"], c["row"], c["column"], c["text"], c["acode"], True) for c in placed]
                    except ValueError:
                        out.append((k, t["table_no"], None, None, None, None, False))
            yield pd.DataFrame(out, columns=["k", "table_no", "row", "column", "text", "acode", "valid"]).astype({"row": "Int32", "column": "Int32"})

    rows = documents.groupBy(F.col(key).alias("k")).agg(F.min_by(raw, "loaded_at").alias("raw"))
    return rows.mapInPandas(scan, "k string, table_no int, row int, column int, text string, acode string, valid boolean").withColumnRenamed("k", key)


def carried_labels(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell with the label of its row: the first text of the row, or of the nearest row above that has one."""
    from pyspark.sql.window import Window

    first = cells.filter(F.col("column") == 0).select(*keys, "row", F.nullif(F.trim("text"), F.lit("")).alias("label"))
    w = Window.partitionBy(*keys).orderBy("row")
    carried = first.select(*keys, "row", F.last("label", ignorenulls=True).over(w).alias("label"))
    return cells.join(carried, [*keys, "row"], "left")


TERM = re.compile(r"제\s*(\d+)\s*\(?(?:기|분기|반기)|(당기|당분기|당반기)")


def current_term(cells: list[dict]) -> int:
    """The column of the current term: headed by the highest term number or by the words for the current one, else the first after the labels."""
    best = (-1, 1)
    for c in cells:
        m = TERM.search(c["text"] or "")
        if m and c["column"] > 0:
            best = max(best, (10**6 if m[2] else int(m[1]), -c["column"]), key=lambda x: (x[0], x[1]))
    return -best[1] if best[0] >= 0 else 1


def statement_facts(raw: bytes | None) -> list[tuple[str, str, str, int, int]]:
    """(statement, basis, label, value, column) of the statement tables of one document.

    The heading between the table before and this one tells the statement and
    basis, one declared unit the multiplier; only the column of the current term
    counts and a row needs exactly one number there.  A table whose cells
    overlap, or without one known unit, gives nothing and harms no other.
    """
    if not raw:
        return []
    text = decode(raw)
    out = []
    end = 0
    for m in re.finditer(r"<table\b.*?</table\s*>", text, re.S | re.I):
        before = re.sub(r"<[^>]*>", " ", text[end : m.start()])
        end = m.end()
        heading = re.sub(r"\s+", "", before)
        found = [(heading.rfind(word), kind) for kind, word in STATEMENTS if word in heading]
        if not found:
            continue
        at, kind = max(found)
        basis = "CFS" if heading.rfind("연결", 0, at) >= max(0, at - 4) and "연결" in heading else "OFS"
        units = set(re.findall(r"단위\s*[:：]\s*([가-힣]+)", before + re.sub(r"<[^>]*>", " ", m[0])))
        if len(units) != 1 or (unit := units.pop()) not in AMOUNT_UNITS:
            continue
        table = parse_document(m[0].encode())["tables"]
        try:
            placed = grid([x["cells"] for x in table[0]["rows"]]) if table else []
        except ValueError:
            continue
        term = current_term(placed)
        for row in sorted({c["row"] for c in placed}):
            cells = [c for c in placed if c["row"] == row]
            values = [v for c in cells if c["column"] == term and (v := number(c["text"], AMOUNT_UNITS[unit])) is not None]
            label = next((c["text"] for c in cells if c["column"] == 0), "")
            if len(values) == 1:
                out.append((kind, basis, re.sub(r"\s+", "", label), values[0], term))
    return out


CONTEXT = re.compile(r"^(?P<kind>[CP])?FY(?P<year>\d{4})(?P<period>[a-zA-Z]*)(?:_(?P<basis>Consolidated|Separate)\w*)?", re.I)


def tagged_facts(documents: DataFrame, raw: str = "raw_xml", key: str = "document_id") -> DataFrame:
    """One row per cell with a fact code: acode, decimals, text, value (scaled by its precision)."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = re.compile(r"<(t[dehu])\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</\1\s*>", re.S | re.I)
        attribute = re.compile(r"([A-Za-z_:-]+)\s*=\s*[\"']([^\"']*)[\"']")
        for pdf in frames:
            out = []
            for k, body in zip(pdf["k"], pdf["raw"], strict=True):
                if not body:
                    continue
                for m in pattern.finditer(re.sub(r"<!--.*?-->", "", decode(body), flags=re.S)):
                    a = {n.lower(): v for n, v in attribute.findall(m[2])}
                    if "acode" not in a or re.search(r"<t[dehu]\b", m[3], re.I):
                        continue
                    decimals = a.get("adecimal", "0")
                    scale = 10 ** -int(decimals) if re.fullmatch(r"-?\d{1,2}", decimals) and int(decimals) <= 0 else None
                    shown = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", m[3])).split())
                    value = number(shown, scale) if scale else None
                    if value is not None and a.get("anegated", "").upper() in ("Y", "TRUE", "1"):
                        value = -value
                    out.append((k, a["acode"], a.get("acontext"), decimals, shown, value))
            yield pd.DataFrame(out, columns=["k", "acode", "acontext", "adecimal", "text", "value"]).astype({"value": "Int64"})

    rows = documents.groupBy(F.col(key).alias("k")).agg(F.min_by(raw, "loaded_at").alias("raw"))
    return rows.mapInPandas(scan, "k string, acode string, acontext string, adecimal string, text string, value bigint").withColumnRenamed("k", key)


def receipt_proof(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and receipt the one value its documents carry; a key is proven where two receipts carry one equal value."""
    per = facts.groupBy(*keys, "rcept").agg(unique_or_null(F.col("value")).alias("value"))
    return per.groupBy(*keys).agg(unique_or_null(F.col("value")).alias("value"), F.count("value").alias("receipts"), ((F.min("value") == F.max("value")) & (F.count("value") >= 2)).alias("proven"))


def reconcile(stored: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Stored values against found ones: keep (match or nothing found), replace (mismatch), drop (not approved), with the action as audit."""
    j = stored.join(found.select(*keys, F.col("value").alias("found")), keys, "left")
    action = F.when(F.coalesce(F.col("review_status"), F.lit("")) != "approved", "drop").when(F.col("found").isNull() | (F.col("found") == F.col("value")), "keep").otherwise("replace")
    return j.withColumn("action", action).withColumn("result", F.when(action == "keep", F.col("value")).when(action == "replace", F.col("found")))


# Passages and claims

SENTENCE_END = re.compile(r"(?<=[.!?。])\s+|\n+")


def passages_of(text: str | None) -> list[tuple[int, int, str]]:
    """Lines, then sentences, with their place in the text."""
    out = []
    at = 0
    for m in [*SENTENCE_END.finditer(text or ""), None]:
        end = m.start() if m else len(text or "")
        part = (text or "")[at:end]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            out.append((at + lead, at + len(part.rstrip()), part.strip()))
        if m:
            at = m.end()
    return out


def per_text(rows: DataFrame, text: str, f: Callable[[str | None], list[tuple]], schema: str) -> DataFrame:
    """Flat rows of a function of a text; all other columns are repeated."""
    names = [x.split()[0] for x in schema.split(",")]
    kept = [c for c in rows.columns if c != text]
    types = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields if x.name != text)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            lists = [[dict(zip(names, x, strict=True)) for x in f(v if isinstance(v, str) else None)] for v in pdf[text]]
            yield pdf[kept].assign(items=lists)

    struct = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in schema.split(","))
    return rows.mapInPandas(scan, f"{types}, items array<struct<{struct}>>").select(*kept, F.inline("items"))


def passages(rows: DataFrame, text: str = "text") -> DataFrame:
    return per_text(rows, text, passages_of, "start int, stop int, passage string")


def prose_gate(text: Column) -> Column:
    """At least 20 characters, no free-standing numbers or table bars, a sentence's ending."""
    ok = (F.length(text) >= 20) & ~text.contains("|") & ~text.rlike(r"(?:^|\s)[0-9][0-9,.]*(?:\s+[0-9][0-9,.]*){2,}") & text.rlike(r"(?:다|요|음|함)\.?$|[a-z][.!?]$")
    return F.coalesce(ok, F.lit(False))


def citation_id(*parts: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of the parts joined by NUL."""
    return F.substring(F.sha2(F.array_join(F.array(*(p.cast("string") for p in parts)), "\x00"), 256), 1, 24)


def evidence_score(f: Column, u: Column, c: Column, t: Column, penalties: Column) -> Column:
    """25 * (0.4 F + 0.3 U + 0.2 C + 0.1 T) less penalties."""
    return 25 * (0.4 * f + 0.3 * u + 0.2 * c + 0.1 * t) - penalties


def evidence_suitable(f: Column, c: Column, score: Column) -> Column:
    return (f >= 3) & (c >= 3) & (score >= 75)


MONEY = re.compile(r"(?<![\d.])(\d[\d,]*(?:\.\d+)?)\s*(조|억|만|천)?\s*(\d[\d,]*)?\s*(억|만)?\s*원")
PERCENT = re.compile(r"(-?\d[\d,]*(?:\.\d+)?)\s*(%p|%포인트|%)")
SIZES = {"조": 10**12, "억": 10**8, "만": 10**4, "천": 10**3, None: 1, "": 1}


def claims_of(text: str | None) -> list[tuple[str, int, float, float]]:
    """(kind, place, value, tolerance) of the amounts and percentages of a text; tolerance is half of the last digit."""
    out = []
    for m in MONEY.finditer(text or ""):
        whole = m[1].replace(",", "")
        size = SIZES[m[2]]
        value = float(Decimal(whole) * size)
        last = size * 10.0 ** -(len(whole.split(".")[1]) if "." in whole else 0)
        if m[3]:
            size2 = SIZES[m[4]]
            value += float(Decimal(m[3].replace(",", "")) * size2)
            last = float(size2)
        out.append(("money", m.start(), value, last / 2))
    for m in PERCENT.finditer(text or ""):
        digits = m[1].replace(",", "")
        last = 10.0 ** -(len(digits.split(".")[1]) if "." in digits else 0)
        out.append(("percent" if m[2] == "%" else "points", m.start(), float(digits), last / 2))
    return out


def claims(rows: DataFrame, text: str = "text") -> DataFrame:
    return per_text(rows, text, claims_of, "kind string, place int, value double, tolerance double")


def check_claims(claimed: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Money claims with whether a fact of the same scope lies within the tolerance.

    A band join: facts and claims meet by scope and by the power of two of the
    value, neighbours included, never all with all.
    """
    level = lambda v: F.floor(F.log2(F.greatest(F.lit(1.0), F.abs(v)))).cast("int")
    c = claimed.filter("kind = 'money'").withColumn("_id", F.monotonically_increasing_id())
    probes = c.select(*keys, "_id", "value", "tolerance", F.explode(F.array(*(level(F.col("value")) + i for i in (-1, 0, 1)))).alias("_l"))
    known = facts.filter("value IS NOT NULL").select(*keys, F.col("value").cast("double").alias("fact"), level(F.col("value").cast("double")).alias("_l")).distinct()
    met = probes.join(known, [*keys, "_l"]).filter(F.abs(F.abs("fact") - F.abs("value")) <= F.col("tolerance")).select("_id").distinct().withColumn("supported", F.lit(True))
    return c.join(met, "_id", "left").withColumn("supported", F.coalesce("supported", F.lit(False))).drop("_id")


def located(text: str | None, quote: str | None) -> tuple[int, int] | None:
    """Where a quote stands in a text, white space apart."""
    if not text or not quote or not quote.strip():
        return None
    places = [i for i, ch in enumerate(text) if not ch.isspace()]
    packed, wanted = "".join(text[i] for i in places), "".join(quote.split())
    at = packed.find(wanted)
    return None if at < 0 else (places[at], places[at + len(wanted) - 1] + 1)


def located_passages(text: str) -> list[tuple[int, int]]:
    """Where the passages of a text are found again in it, white space apart; repeated ones at their own place."""
    places = [i for i, ch in enumerate(text) if not ch.isspace()]
    packed = "".join(text[i] for i in places)
    out, at = [], 0
    for _, _, passage in passages_of(text):
        wanted = "".join(passage.split())
        found = packed.find(wanted, at)
        if wanted and found >= 0:
            at = found + len(wanted)
            out.append((places[found], places[at - 1] + 1))
    return out


def dedupe_text(rows: DataFrame, scope: list[str], text: str, key: str) -> DataFrame:
    """Every row with the key of the first row of its scope that has the same text; ``sent`` marks that row."""
    first = rows.groupBy(*scope, F.xxhash64(text).alias("_h"), F.md5(text).alias("_m")).agg(F.min(key).alias("same_as"))
    j = rows.withColumns({"_h": F.xxhash64(text), "_m": F.md5(text)}).join(first, [*scope, "_h", "_m"])
    return j.withColumn("sent", F.col(key) == F.col("same_as")).drop("_h", "_m")


# Failure classes in their order of precedence, by status code and by words; anything else is want of evidence.
FAILURES = (
    ("configuration", (401, 403, 404), ("인증", "권한", "api key", "안전 예산", "단일 요청 입력")),
    ("rate_limit", (429,), ("할당량", "사용량 제한", "rate limit")),
    ("unavailable", (408, 500, 502, 503, 504, 800), ("네트워크", "연결 실패", "timeout")),
    ("verification", (), ("검증", "json", "근거 id", "응답")),
)
STATUS = r"(?:http\s*(?:error\s*)?|상태\s*코드\s*[:：]?\s*)([0-9]{3})\b"


def failure_class(reason: Column) -> Column:
    """The class of a failure's text; null for null."""
    low = F.lower(reason)
    code = F.nullif(F.regexp_extract(low, STATUS, 1), F.lit("")).cast("int")
    chain = F.lit("insufficient_evidence")
    for name, codes, words in reversed(FAILURES):
        told = F.coalesce(code.isin(*codes), F.lit(False)) if codes else F.lit(False)
        for word in words:
            told = told | low.contains(word)
        chain = F.when(told, name).otherwise(chain)
    return F.when(reason.isNotNull(), chain)


RESPECTIVELY = re.compile(r"각각|respectively", re.I)


def bound_claims(text: str | None, labels: list[str]) -> list[tuple[str, float]]:
    """Labels and amounts of a sentence with "respectively", paired in order; empty unless their numbers agree."""
    if not text or not RESPECTIVELY.search(text):
        return []
    found = sorted((text.index(x), x) for x in labels if x in text)
    amounts = [c for c in claims_of(text) if c[0] in ("money", "percent")]
    return [(label, amount[2]) for (_, label), amount in zip(found, amounts, strict=True)] if len(found) == len(amounts) and found else []


def recovered_fragment(text: str | None, quote: str | None, share: float = 0.25, least: int = 20) -> tuple[int, int] | None:
    """The longest part of a quote that a partial document still holds, if it is long enough."""
    from difflib import SequenceMatcher

    if not text or not quote:
        return None
    m = SequenceMatcher(None, text, quote, autojunk=False).find_longest_match()
    return (m.a, m.a + m.size) if m.size >= max(least, share * len(quote)) else None


def chosen_occurrence(text: str | None, quote: str | None, section: str | None) -> int | None:
    """Where a repeated quote stands: the first occurrence after the section's heading, else the first."""
    if not text or not quote:
        return None
    heading = text.find(section) if section else -1
    after = text.find(quote, heading) if heading >= 0 else -1
    at = after if after >= 0 else text.find(quote)
    return at if at >= 0 else None
