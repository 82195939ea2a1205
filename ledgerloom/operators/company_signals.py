"""Company keyword signals: candidate evidence, approval, promotion and suppression.

Candidate observations are rows (keyword, kind, chunk, section, neighbours); every
rule after that is an aggregate over them with a threshold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import top_per_group
from ledgerloom.operators.signals import Vocabulary, is_candidate, spelling_key, word_tokenizer

OBSERVATION = "keyword string, kind string, start int, stop int, left_word string, right_word string, number string"

LATIN = re.compile(r"(?<![A-Za-z0-9])[A-Z][A-Za-z0-9]*(?:[-/&+][A-Za-z0-9]+)*(?![A-Za-z0-9])")
GENERATION = re.compile(r"(?<![A-Za-z0-9])([A-Z][A-Z0-9]{1,9})[ -]?(\d{1,3}[a-zA-Z]?)(?![A-Za-z0-9])")
# Designators of legal entities, words of corporate events, verbs of action and the subjects that own them.
LEGAL = ("주식회사", "유한회사", "㈜", "(주)", "Inc", "Corp", "Co.,", "Ltd", "LLC", "GmbH")
EVENTS = re.compile(r"(?:Day|Week|Forum|Conference|Expo)\b")
ACTIONS = ("개발", "출시", "양산", "공급", "수주", "인수", "투자", "증설")
OWN_SUBJECTS = ("당사", "회사", "그룹", "연결실체", "지배기업")


@dataclass(frozen=True)
class Thresholds:
    """The approval rules' numbers."""

    sections: int = 2
    neighbours: int = 3
    depth: int = 5
    short_english: int = 3
    generation_chunks: int = 8
    generation_numbers: int = 2
    generation_contexts: int = 2
    generation_length: int = 3
    longer_share: float = 0.8
    longer_top_two: float = 0.75
    korean_pair: float = 0.6
    own_actions: int = 2
    own_share: float = 0.5
    promote_occurrences: int = 4
    promote_chunks: int = 2
    promote_latest: int = 2
    promote_share: float = 0.5
    contained: float = 0.75


def is_entity(text: str, start: int, stop: int) -> bool:
    """Whether a span stands beside a legal designator or in the name of an event."""
    around = text[max(0, start - 6) : start] + "|" + text[stop : stop + 8]
    return any(x in around for x in LEGAL) or bool(EVENTS.match(text[stop:].lstrip()))


def observe(text: str, v: Vocabulary) -> list[tuple]:
    """Candidate evidence of one text: direct words, English words, generations and phrase spans."""
    words = word_tokenizer(text)
    out = []
    for i, (w, s, e) in enumerate(words):
        if is_entity(text, s, e) or not is_candidate(w, v):
            continue
        left = words[i - 1][0] if i and text[words[i - 1][2] : s].strip() == "" else None
        right = words[i + 1][0] if i + 1 < len(words) and text[e : words[i + 1][1]].strip() == "" else None
        kind = "english" if LATIN.fullmatch(w) else "direct"
        out.append((w, kind, s, e, left, right, None))
        if right and is_candidate(right, v) and re.search("[가-힣]", w + right):
            out.append((f"{w} {right}", "phrase", s, words[i + 1][2], left, None, None))
    for m in GENERATION.finditer(text):
        if not is_entity(text, m.start(), m.end()):
            out.append((m[1], "generation", m.start(), m.end(), None, None, m[2]))
    return out


def observations(chunks: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """One row per candidate occurrence; the columns of ``chunks`` but the text are kept."""
    from ledgerloom.operators.documents import per_text

    return per_text(chunks, "text", lambda t: observe(t, v) if t else [], OBSERVATION.replace(", ", ","))


def approved_english(obs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """English words by breadth of sections, breadth of neighbours or depth in one section; very short ones need all breadth."""
    g = obs.filter("kind = 'english'").groupBy("corp_code", "keyword").agg(
        F.count_distinct("section_name").alias("sections"),
        F.count_distinct(F.coalesce("left_word", "right_word")).alias("neighbours"),
        F.count_distinct("chunk_id").alias("chunks"),
    )
    rule = F.when(F.col("sections") >= t.sections, "section breadth").when(F.col("neighbours") >= t.neighbours, "neighbour breadth").when(F.col("chunks") >= t.depth, "section depth")
    short = F.length("keyword") < t.short_english
    return g.withColumn("rule", F.when(short & (F.col("sections") < t.sections), None).otherwise(rule)).filter("rule IS NOT NULL")


def approved_generations(obs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    g = obs.filter("kind = 'generation'").groupBy("corp_code", "keyword").agg(F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("number").alias("numbers"), F.count_distinct("section_name").alias("contexts"))
    return g.filter((F.col("chunks") >= t.generation_chunks) & (F.col("numbers") >= t.generation_numbers) & (F.col("contexts") >= t.generation_contexts) & (F.length("keyword") >= t.generation_length))


def longer_form_share(obs: DataFrame) -> DataFrame:
    """Per keyword: share of occurrences inside a longer form and share of its two commonest longer forms."""
    single = obs.filter("kind IN ('direct', 'english')")
    longer = single.withColumn("longer", F.when(F.col("right_word").isNotNull(), F.concat_ws(" ", "keyword", "right_word")).when(F.col("left_word").isNotNull(), F.concat_ws(" ", "left_word", "keyword")))
    total = longer.groupBy("corp_code", "keyword").agg(F.count(F.lit(1)).alias("n"), F.count("longer").alias("inside"))
    forms = longer.filter("longer IS NOT NULL").groupBy("corp_code", "keyword", "longer").agg(F.count(F.lit(1)).alias("m"))
    two = top_per_group(forms, ["corp_code", "keyword"], [F.desc("m"), F.col("longer")], 2).groupBy("corp_code", "keyword").agg(F.sum("m").alias("top_two"))
    j = total.join(two, ["corp_code", "keyword"], "left")
    return j.select("corp_code", "keyword", "n", (F.col("inside") / F.col("n")).alias("inside_share"), (F.coalesce("top_two", F.lit(0)) / F.greatest(F.col("inside"), F.lit(1))).alias("top_two_share"))


def suppressed_by_longer(obs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Keywords that hardly ever stand alone: English by both shares, Korean by the pair share."""
    s = longer_form_share(obs)
    english = F.col("keyword").rlike("^[A-Za-z0-9&+/-]+$")
    return s.filter(F.when(english, (F.col("inside_share") >= t.longer_share) & (F.col("top_two_share") >= t.longer_top_two)).otherwise((F.col("inside_share") >= t.korean_pair) & (F.col("top_two_share") >= t.longer_top_two)))


def action_owners(chunks: DataFrame) -> DataFrame:
    """Per chunk and action verb the subject of its sentence: own, other or none."""
    own, verbs = "|".join(OWN_SUBJECTS), "|".join(ACTIONS)
    sentence = F.explode(F.split("text", r"(?<=[.다])\s+", -1))
    s = chunks.filter("text IS NOT NULL").select("corp_code", "chunk_id", sentence.alias("sentence")).withColumn("action", F.nullif(F.regexp_extract("sentence", f"({verbs})", 1), F.lit(""))).filter("action IS NOT NULL")
    subject = F.when(F.col("sentence").rlike(rf"(?:{own})(?:은|는|이|가|의)"), "own").when(F.col("sentence").rlike(r"^[^ ]+(?:은|는|이|가) "), "other").otherwise("none")
    return s.select("corp_code", "chunk_id", "action", subject.alias("subject"))


def owned_actions(chunks: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Actions a company owns: at least two own subjects, at least half of all named subjects."""
    g = action_owners(chunks).groupBy("corp_code", "action").agg(F.count_if(F.col("subject") == "own").alias("own"), F.count_if(F.col("subject") != "none").alias("named"))
    return g.filter((F.col("own") >= t.own_actions) & (F.col("own") >= t.own_share * F.col("named")))


def promotions(obs: DataFrame, latest: int, t: Thresholds = Thresholds()) -> DataFrame:
    """Words replaced by a phrase that holds most of their occurrences: corp_code, keyword, phrase."""
    words = obs.filter("kind IN ('direct', 'english')").groupBy("corp_code", "keyword").agg(F.count(F.lit(1)).alias("n"))
    phrases = obs.filter("kind = 'phrase'").groupBy("corp_code", F.col("keyword").alias("phrase")).agg(F.count(F.lit(1)).alias("m"), F.count_distinct("chunk_id").alias("chunks"), F.count_distinct(F.when(F.col("year") == latest, F.col("chunk_id"))).alias("recent"))
    good = phrases.filter((F.col("m") >= t.promote_occurrences) & (F.col("chunks") >= t.promote_chunks) & (F.col("recent") >= t.promote_latest))
    parts = good.select("corp_code", "phrase", "m", F.explode(F.split("phrase", " ", -1)).alias("keyword"))
    j = parts.join(words, ["corp_code", "keyword"]).filter(F.col("m") >= t.promote_share * F.col("n"))
    return top_per_group(j, ["corp_code", "keyword"], [F.desc("m"), F.col("phrase")], 1).select("corp_code", "keyword", "phrase")


def contained_spans(counts: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Keywords three quarters of whose occurrences lie in one extension: meets extensions by their parts, not all with all."""
    longer = counts.filter(F.col("keyword").contains(" ")).select("corp_code", F.col("keyword").alias("extension"), F.col("n").alias("m"))
    parts = longer.select("corp_code", "extension", "m", F.explode(F.split("extension", " ", -1)).alias("keyword"))
    return counts.join(parts, ["corp_code", "keyword"]).filter(F.col("m") >= t.contained * F.col("n")).select("corp_code", "keyword", "extension")


def without_sector_context(obs: DataFrame, texts: DataFrame, context: str, protected: list[str]) -> DataFrame:
    """Candidates never seen in a chunk with sector context and not protected.

    ``texts`` (chunk_id, text) are matched once a chunk; only a flag meets the observations.
    """
    flags = texts.select("chunk_id", F.coalesce(F.col("text").rlike(context), F.lit(False)).alias("_seen"))
    g = obs.join(flags, "chunk_id").groupBy("corp_code", "keyword").agg(F.bool_or("_seen").alias("seen"))
    return g.filter(~F.col("seen") & ~F.col("keyword").isin(*protected)).select("corp_code", "keyword")


# Provenance categories in their order.
PROVENANCE = ("generation", "english", "phrase", "direct")


def provenance(obs: DataFrame) -> DataFrame:
    """The first category of every keyword and all its categories joined."""
    order = F.array_position(F.array(*map(F.lit, PROVENANCE)), F.col("kind"))
    return obs.groupBy("corp_code", "keyword").agg(F.min_by("kind", order).alias("category"), F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("reasons"))


def phrase_category(modifiers: list[str], heads: list[str]):
    """Modifier-head phrases: both known, one known, none."""
    left, right = F.split("keyword", " ", -1)[0], F.element_at(F.split("keyword", " ", -1), -1)
    known = left.isin(*modifiers).cast("int") + right.isin(*heads).cast("int")
    return F.when(known == 2, "modifier and head").when(known == 1, "one role").otherwise("free")


def promotion_forms(text: str, start: int, stop: int) -> list[str]:
    """Contiguous spans of two to five English words around a span, and its whole-word extension to the left in Korean."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9가-힣&+-]+", text)]
    at = next((i for i, (s, e) in enumerate(words) if s <= start < e), None)
    if at is None:
        return []
    out = []
    for size in range(2, 6):
        for first in range(max(0, at - size + 1), at + 1):
            part = words[first : first + size]
            span = text[part[0][0] : part[-1][1]]
            if len(part) == size and re.fullmatch(r"[A-Za-z0-9&+ -]+", span):
                out.append(span)
    if at and re.search("[가-힣]", text[words[at][0] : words[at][1]]) and text[words[at - 1][1] : words[at][0]] == " ":
        out.append(text[words[at - 1][0] : stop])
    return out


def company_result(obs: DataFrame, latest: int) -> DataFrame:
    """Latest document frequency of at least two per company and keyword, spelling variants merged."""
    df = obs.filter(F.col("year") == latest).groupBy("corp_code", "keyword").agg(F.count_distinct("chunk_id").alias("n"))
    best = F.struct("n", F.length("keyword"), "keyword")
    return df.withColumn("key", spelling_key(F.col("keyword"))).groupBy("corp_code", "key").agg(F.max_by("keyword", best).alias("keyword"), F.sum("n").alias("n")).filter("n >= 2")
