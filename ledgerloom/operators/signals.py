"""Keyword signals: frequency, change and spread of terms over periods and companies.

The counting steps are ordinary partial aggregations over exploded terms; every
later step works on one row per keyword and scope.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.finance import entropy_score
from ledgerloom.operators.ranking import percentile_score

Tokenizer = Callable[[str], list[tuple[str, int, int]]]

WORD = re.compile(r"[가-힣A-Za-z][가-힣A-Za-z0-9&+-]*")
# Particles that end a Korean word.
PARTICLES = ("으로부터", "에서는", "으로는", "에서", "으로", "에게", "까지", "부터", "하고", "이며", "이고", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로")


def word_tokenizer(text: str) -> list[tuple[str, int, int]]:
    """Words without their particle, with their place: the default in place of a morphological analyser."""
    out = []
    for m in WORD.finditer(text):
        word = m[0]
        for p in PARTICLES:
            if word.endswith(p) and len(word) - len(p) >= 2:
                word = word[: -len(p)]
                break
        out.append((word, m.start(), m.start() + len(word)))
    return out


@dataclass(frozen=True)
class Vocabulary:
    """What a sector adds to the extraction rules."""

    aliases: dict[str, str] = field(default_factory=dict)
    compounds: tuple[str, ...] = ()
    stopwords: frozenset[str] = frozenset()
    companies: frozenset[str] = frozenset()
    context_required: frozenset[str] = frozenset()


# Noise classes by pattern, first match wins.
NOISE = (
    ("통화/환율", r"^(?:USD|JPY|KRW|EUR|CNY|GBP|CHF|CAD|AUD|HKD|SGD)$|(?:환율|환산|외화|원화|통화위험)"),
    ("기간 비교", r"(?:전년|전기|전분기|전월|당기|동기|전년도|기간 대비)"),
    ("홍보·수식", r"(?:업계 최초|세계 최초|국내 최초|최고 수준|업계 최고|경쟁 우위)"),
    ("회계·보고서 관용", r"(?:재고 자산|매출액|재무|회계|충당금|감가상각|장부가액|보고기간)"),
    ("공시 메타", r"(?:기업\s*공시|공시)\s*서식|서식\s*(?:작성|기준)|기재\s*(?:예정|생략)|(?:분\s*[ㆍ·ᆞ]\s*반기|분반기)|분석\s*의견"),
    ("특허 법률 문구", r"(?i)\b(?:comprising|thereof|wherein)\b|\b(?:inhibitors?|compositions?)\s+and\s+methods?\b"),
    ("문서성 표현", r"^(?:기존\s*대비|기저\s*효과)$|^[가-힣]+(?:특별시|광역시|특별자치시|특별자치도|도|시|군|구)\s*소재$"),
    ("일반 경영", r"(?:부가 가치|자금 조달|수주 상황|경영 전략|사업 계획)"),
)
# Classes that are dropped, and the one that costs points; what is in neither stays.
DROPPED = ("통화/환율", "기간 비교", "회계·보고서 관용", "공시 메타", "특허 법률 문구", "문서성 표현")
PENALISED = {"일반 경영": 2.0}

#: Words that are no candidates whatever their class: numbers, dates and words of grammar.
NO_WORD = re.compile(r"^(?:[0-9.,%]+|[0-9]{4}년|[0-9]{1,2}[월일]|있습니다|합니다|입니다|하였습니다|됩니다|및|등|약|또는|위하여|대한|관련)$")


def noise_class(keyword: Column, classes: tuple[tuple[str, str], ...] = NOISE) -> Column:
    chain = F.lit(None).cast("string")
    for name, pattern in reversed(classes):
        chain = F.when(keyword.rlike(pattern), name).otherwise(chain)
    return chain


def is_dropped(noise: Column) -> Column:
    return F.coalesce(noise.isin(*DROPPED), F.lit(False))


def noise_penalty(noise: Column) -> Column:
    chain = F.lit(0.0)
    for name, points in PENALISED.items():
        chain = F.when(noise == name, points).otherwise(chain)
    return chain


def canonical_keyword(value: str, v: Vocabulary) -> str:
    folded = " ".join(unicodedata.normalize("NFKC", value).split())
    return v.aliases.get(folded.casefold(), folded)


def is_candidate(word: str, v: Vocabulary) -> bool:
    return 2 <= len(word) <= 30 and word not in v.stopwords and word not in v.companies and not NO_WORD.match(word) and not any(re.search(p, word) for name, p in NOISE if name in DROPPED)


def keywords_of(text: str, v: Vocabulary, tokenizer: Tokenizer) -> set[str]:
    """Compounds first (their text is masked), then words, then adjacent pairs with at least one Hangul word."""
    found: set[str] = set()
    text = unicodedata.normalize("NFKC", text)
    for pattern in v.compounds:
        for m in re.finditer(pattern, text):
            found.add(canonical_keyword(m[0], v))
        text = re.sub(pattern, lambda m: "\n" * len(m[0]), text)
    words = [(w, s, e) for w, s, e in tokenizer(text) if is_candidate(w, v)]
    found |= {canonical_keyword(w, v) for w, _, _ in words}
    for (a, _, end), (b, start, _) in zip(words, words[1:], strict=False):
        if text[end:start] in ("", " ") and re.search("[가-힣]", a + b):
            found.add(canonical_keyword(f"{a} {b}", v))
    return found


def extract_keywords(chunks: DataFrame, v: Vocabulary = Vocabulary(), tokenizer: Tokenizer = word_tokenizer) -> DataFrame:
    """chunk_id and keyword, each keyword once a chunk; other columns stay, text goes."""
    keep = [c for c in chunks.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields if f.name != "text")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            lists = [sorted(keywords_of(t, v, tokenizer)) if isinstance(t, str) and t else [] for t in pdf["text"]]
            yield pdf[keep].assign(keywords=lists)

    return chunks.mapInPandas(scan, f"{schema}, keywords array<string>").withColumn("keyword", F.explode("keywords")).drop("keywords")


def mention_rates(hits: DataFrame, totals: DataFrame, scope: list[str]) -> DataFrame:
    """df and rate per keyword and scope: chunks with the keyword over all chunks of the scope."""
    df = hits.groupBy("keyword", *scope).agg(F.count(F.lit(1)).alias("df"))
    return df.join(totals, scope).withColumn("rate", F.when(F.col("total") > 0, F.col("df") / F.col("total")))


def blended_change(rates: DataFrame, years: list[int]) -> DataFrame:
    """Change per keyword: 0.4 of what came before plus 0.6 of the newest delta, folded over consecutive years; none gives 0.

    ``rates`` has keyword, year and rate; a year without the keyword counts as
    rate 0 and the first delta enters whole.
    """
    by_year = rates.groupBy("keyword").agg(*(F.coalesce(F.max(F.when(F.col("year") == y, F.col("rate"))), F.lit(0.0)).alias(f"_{y}") for y in years))
    deltas = F.array(*(F.col(f"_{b}") - F.col(f"_{a}") for a, b in zip(years, years[1:], strict=False)))
    fold = F.aggregate(deltas, F.lit(None).cast("double"), lambda acc, d: F.when(acc.isNull(), d).otherwise(acc * 0.4 + d * 0.6), lambda acc: F.coalesce(acc, F.lit(0.0)))
    return by_year.select("keyword", (fold if len(years) > 1 else F.lit(0.0)).alias("change_raw"))


def comparable_change(counts: DataFrame, totals: DataFrame, years: list[int]) -> DataFrame:
    """Change per keyword, the newest year compared only on the report types that it and the year before have.

    ``counts`` has keyword, year, report_type and df, ``totals`` year, report_type
    and total.  Completed years are compared whole.  A comparison with a year (or
    shared types) without chunks is skipped, a year that has chunks but none with
    the keyword counts as rate 0; otherwise as ``blended_change``.
    """
    before, latest = (years[-2], years[-1]) if len(years) > 1 else (None, years[-1])
    of = lambda c, y: F.coalesce(F.sum(F.when(F.col("year") == y, F.col(c))), F.lit(0))
    # one row per report type, then one row
    types = totals.filter("report_type IS NOT NULL").groupBy("report_type").agg(of("total", before).alias("_p"), of("total", latest).alias("_l"))
    shared = types.filter("_p > 0 AND _l > 0")
    whole = totals.agg(*(of("total", y).alias(f"_t{y}") for y in years[:-1]), F.lit(0).alias("_"))
    sizes = whole.join(F.broadcast(shared.agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("_p"), F.coalesce(F.sum("_l"), F.lit(0)).alias("_l"))))
    marked = counts.join(F.broadcast(shared.select("report_type", F.lit(True).alias("_s"))), "report_type", "left")
    alike = lambda y: F.coalesce(F.sum(F.when((F.col("year") == y) & F.col("_s"), F.col("df"))), F.lit(0))
    per = marked.groupBy("keyword").agg(*(of("df", y).alias(f"_n{y}") for y in years[:-1]), alike(before).alias("_np"), alike(latest).alias("_nl")).join(F.broadcast(sizes))
    rate = lambda n, t: F.when(F.col(t) > 0, F.col(n) / F.col(t))
    deltas = [rate(f"_n{b}", f"_t{b}") - rate(f"_n{a}", f"_t{a}") for a, b in zip(years, years[1:-1], strict=False) if b == a + 1]
    if before is not None and latest == before + 1:
        deltas.append(rate("_nl", "_l") - rate("_np", "_p"))
    known = F.filter(F.array(*deltas).cast("array<double>"), lambda d: d.isNotNull())
    fold = F.aggregate(known, F.lit(None).cast("double"), lambda acc, d: F.when(acc.isNull(), d).otherwise(acc * 0.4 + d * 0.6), lambda acc: F.coalesce(acc, F.lit(0.0)))
    return per.select("keyword", fold.alias("change_raw"))


def sector_spread(per_company: DataFrame, companies: Column) -> DataFrame:
    """Per keyword: coverage, entropy and 0.6 * coverage + 0.4 * entropy; needs keyword, df and total per company."""
    g = per_company.groupBy("keyword")
    out = g.agg(
        F.count(F.lit(1)).alias("companies"),
        (F.max("df") / F.sum("df")).alias("max_share"),
        entropy_score(F.col("df").cast("double"), F.col("total").cast("double"), F.max(companies)).alias("entropy"),
        (F.count(F.lit(1)) / F.max(companies) * 100).alias("coverage"),
    )
    return out.withColumn("spread", 0.6 * F.col("coverage") + 0.4 * F.col("entropy"))


def concentration_penalty(max_share: Column) -> Column:
    return F.least(F.lit(15.0), F.greatest(F.lit(0.0), (max_share - 0.5) * 30))


def signal_scores(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Percentiles, weighted signal, penalties and final rank of one row per keyword and scope.

    Needs keyword, current (count), change_raw, spread, max_share.
    """
    kept = rows.withColumn("noise", noise_class(F.col("keyword"))).filter(~is_dropped(F.col("noise")))
    scored = kept.withColumns({f"{n}_score": percentile_score(F.col(c), scope) for n, c in (("current", "current"), ("change", "change_raw"), ("spread", "spread"))})
    signal = 0.5 * F.col("current_score") + 0.3 * F.col("change_score") + 0.2 * F.col("spread_score")
    penalty = concentration_penalty(F.col("max_share")) + noise_penalty(F.col("noise"))
    final = scored.withColumn("signal", signal).withColumn("penalty", penalty).withColumn("final_score", F.col("signal") - F.col("penalty"))
    return final.withColumn("final_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("final_score"), "keyword")))


def suppress_components(rows: DataFrame, scope: list[str], context_required: list[str]) -> DataFrame:
    """Drops single words that need context where a phrase of the same scope contains them."""
    parts = rows.filter(F.col("keyword").contains(" ")).select(*scope, F.explode(F.split("keyword", " ", -1)).alias("keyword")).distinct().withColumn("_p", F.lit(True))
    j = rows.join(parts, [*scope, "keyword"], "left")
    return j.filter(~(F.col("keyword").isin(*context_required) & F.coalesce(F.col("_p"), F.lit(False)))).drop("_p") if context_required else rows


def spelling_key(value: Column) -> Column:
    """What the spellings of a keyword have in common."""
    return F.lower(F.regexp_replace(value, r"[\s\-_/·.&+]", ""))


def merge_spellings(rows: DataFrame, scope: list[str]) -> DataFrame:
    """One row per spelling key: summed count, shown as the most frequent, then the one with most capitals, then the longest form."""
    capitals = F.length(F.regexp_replace("keyword", "[^A-Z]", ""))
    best = F.struct("n", capitals, F.length("keyword"), "keyword")
    return rows.withColumn("key", spelling_key(F.col("keyword"))).groupBy(*scope, "key").agg(F.max_by("keyword", best).alias("keyword"), F.sum("n").alias("n"))


def context_signature(text: Column) -> Column:
    """A text in NFKC and lower case, numbers as #, white space, dashes and quotes folded."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(nfkc(text)), r"[‐-―]", "-"), r"[‘’“”\"]", "'")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[0-9][0-9.,]*", "#"), r"\s+", " "))


def context_diversity(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Per keyword: chunks, share of distinct contexts (c2) and of distinct co-occurrence sets (c3), and the supported score.

    ``pairs`` is (keyword, chunk_id), ``texts`` (chunk_id, text).  Contexts and sets
    are compared by 64-bit hashes, so no set of a chunk meets another task.
    """
    sets = pairs.groupBy("chunk_id").agg(F.xxhash64(F.array_sort(F.collect_set("keyword"))).alias("cooc"))
    j = pairs.join(texts.select("chunk_id", F.xxhash64(context_signature(F.col("text"))).alias("context")), "chunk_id").join(sets, "chunk_id")
    per = j.groupBy("keyword").agg(F.count_distinct("chunk_id").alias("n"), F.count_distinct("context").alias("contexts"), F.count_distinct("cooc").alias("sets"))
    c2, c3 = F.col("contexts") / F.col("n"), F.col("sets") / F.col("n")
    support = F.least(F.lit(1.0), F.col("n") / F.lit(10.0))
    return per.select("keyword", "n", c2.alias("c2"), c3.alias("c3"), support.alias("support"), ((c2 * 0.4 + c3 * 0.6) * support).alias("adjusted"))


def mention_pattern(keyword: str, aliases: dict[str, str] | None = None) -> str:
    """A pattern for a keyword and the aliases that stand for it, longest first.

    Any white space or none between the words, no Latin letter or digit beside it,
    letter case aside; to be tried on text in NFKC.
    """
    fold = lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold()
    surfaces = {keyword} | {alias for alias, target in (aliases or {}).items() if fold(target) == fold(keyword)}
    terms = [r"\s*".join(map(re.escape, x.split())) for x in sorted(surfaces, key=lambda x: (-len(x), x))]
    return "(?iu)" + "|".join(rf"(?<![A-Za-z0-9]){term}(?![A-Za-z0-9])" for term in terms)


def nfkc(text: Column | str) -> Column:
    """A text in NFKC, in Arrow batches: Spark has no built-in for it."""

    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return F.pandas_udf(fold, "string")(text)


def related_filings(chunks: DataFrame, documents: DataFrame, keyword: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Per company the filing with most mentions, then the latest, then the larger receipt; each chunk counts once.

    ``documents`` (corp_code, rcept_no, rcept_dt) are the filings that may be named.
    """
    n = chunks.filter("text IS NOT NULL").withColumn("mentions", F.regexp_count(nfkc("text"), F.lit(mention_pattern(keyword, aliases)))).filter("mentions > 0")
    per = n.groupBy("corp_code", "rcept_no").agg(F.sum("mentions").alias("mentions"))
    known = per.join(documents.groupBy("corp_code", "rcept_no").agg(F.max("rcept_dt").alias("rcept_dt")), ["corp_code", "rcept_no"])
    return known.groupBy("corp_code").agg(F.max("mentions").alias("mentions"), F.max_by("rcept_no", F.struct("mentions", F.coalesce("rcept_dt", F.lit("0001-01-01").cast("date")), "rcept_no")).alias("rcept_no"))
