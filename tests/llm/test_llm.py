"""The llm problems against brute force, exact round trips and public libraries."""

import base64
import datetime as dt
import os
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import bpe, knn, leakage, mojibake, terms

T0 = dt.datetime(2024, 1, 1)


# p1


def vectors(seed=1, n=300, dim=64):
    """Clusters of close vectors, exact copies, scaled copies and far ones."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    near = base + 0.12 * rng.normal(size=base.shape)
    rest = np.concatenate([base[:20], base[:20] * 3.0, rng.normal(size=(n - 2 * (n // 3) - 40, dim))])
    return np.concatenate([base, near, rest]).astype(np.float32)


def brute(ids, x, k, floor):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    c = u @ u.T
    found = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(c[i, j], 12), ids[j]))[:k]
        found |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if c[i, j] >= floor}
    return found


def frame(spark, ids, x):
    rows = [(int(i), [float(v) for v in r], "clash") for i, r in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, "embedding_id bigint, embedding array<float>, class string")


def pairs(df, h, k=5, floor=0.93):
    return {(r.id_1, r.id_2) for r in knn.similar_pairs(df, "embedding_id", "embedding", k, floor, h).collect()}


def test_similar_pairs_agree_with_brute_force(spark):
    x = vectors()
    ids = np.random.default_rng(5).permutation(len(x)) + 10
    expected = brute(ids, x, 5, 0.93)
    got = pairs(frame(spark, ids, x), knn.Hashing())
    assert got <= expected and len(got) >= 0.97 * len(expected) > 0


@pytest.mark.parametrize("cosine", [0.931, 0.94, 0.95])
def test_pairs_planted_near_the_floor_are_found(spark, cosine):
    rng = np.random.default_rng(17)
    a, b = rng.normal(size=(2, 600, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    x = np.concatenate([a, cosine * a + (1 - cosine**2) ** 0.5 * b]).astype(np.float32)
    expected = brute(range(1200), x, 5, 0.93)
    got = pairs(frame(spark, range(1200), x), knn.Hashing())
    assert len(expected) >= 600 and got <= expected and len(got) >= 0.9 * len(expected)


def test_a_hot_bucket_is_compared_in_blocks(spark):
    x = vectors(n=240)
    ids = np.arange(len(x))
    # one cell for everything: every bucket is hot, and blocks are smaller than it
    one = knn.Hashing(tables=1, functions=1, width=1e6, probes=1, bucket_rows=8, block_rows=50)
    assert pairs(frame(spark, ids, x), one) == brute(ids, x, 5, 0.93)


@pytest.mark.parametrize("size", [2, 8, 512])
def test_pairs_do_not_depend_on_the_size_of_a_hot_bucket(spark, size):
    x = np.concatenate([vectors(seed=3, n=240), 1 + 0.05 * np.random.default_rng(4).normal(size=(60, 64)).astype(np.float32)])
    h = knn.Hashing(tables=2, functions=6, bucket_rows=size, block_rows=7, row_bits=64, sketch_bits=128)
    assert pairs(frame(spark, range(300), x), h, k=5) == pairs(frame(spark, range(300), x), knn.Hashing(tables=2, functions=6, bucket_rows=10**6, row_bits=64, sketch_bits=128), k=5)


def test_functions_and_tables_follow_the_number_of_vectors():
    small, large = knn.sized(knn.Hashing(), 1000), knn.sized(knn.Hashing(), 50_000_000)
    assert small == knn.Hashing() and large.functions > small.functions and large.tables > small.tables
    assert 1 - (1 - knn.found_per_table(large)) ** large.tables >= 0.95


def test_many_copies_give_k_pairs_each(spark):
    x = np.tile(vectors()[:1], (40, 1))
    got = pairs(frame(spark, range(40), x), knn.Hashing())
    assert got == brute(list(range(40)), x, 5, 0.93)


def test_search_is_exact(spark, monkeypatch):
    x = vectors(n=120)
    ids = np.random.default_rng(3).permutation(120)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    df = frame(spark, ids, x)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    got = knn.top_k_search(df, df.filter("embedding_id % 20 = 0"), "embedding_id", "embedding", 3)
    for i in range(0, 120, 20):
        c = u @ u[list(ids).index(i)]
        expected = sorted(sorted((-round(c[j], 9), int(ids[j])) for j in range(120) if ids[j] != i)[:3])
        assert sorted((-round(r.cosine, 9), r.neighbour) for r in got.filter(f"id = {i}").collect()) == expected
    assert knn.top_k_search(df.limit(0), df.limit(0), "embedding_id", "embedding").count() == 0


def test_unusable_vectors_are_in_no_pair(spark):
    good = [0.5] * 64
    rows = [(1, good), (2, good), (3, None), (4, []), (5, good[:32]), (6, [*good, 1.0]), (7, [float("nan"), *good[1:]]), (8, [float("inf"), *good[1:]]), (9, [0.0] * 64), (10, [None, *good[1:]]), (None, good), (1, good)]
    df = spark.createDataFrame(rows, "embedding_id bigint, embedding array<float>")
    assert pairs(df, knn.Hashing()) == {(1, 2)}
    assert pairs(df.limit(0), knn.Hashing()) == set()


def test_perturbations_are_ordered_and_valid():
    sets = knn.perturbations(6, 20)
    assert sets[0] == (1,) and len(set(sets)) == 20
    assert all(13 - r not in s for s in sets for r in s)


# p7


def test_terms_agree_with_brute_force(spark):
    rng = random.Random(2)
    words = ["매출", "매출액", "ABC", "ＡＢＣ", "12", "3d", "가́", "x" * 300]
    data = []
    for i in range(120):
        text = rng.choice([None, "", " ".join(rng.choices(words, k=6))])
        data.append((f"c{i}", text, rng.choice([None, "", "A b; a  B,x|y/ z ", ";;", "사업"]), T0))
    data += [(*data[0][:3], T0 + dt.timedelta(days=1)), (None, "매출", "매출", T0)]
    df = spark.createDataFrame(data, "chunk_id string, text string, keyword string, loaded_at timestamp_ntz")
    first = {r[0]: r for r in reversed(data) if r[0] is not None}
    expected = {}
    for at, field in ((1, "text"), (2, "keyword")):
        occurrences, records, filled = Counter(), Counter(), 0
        for r in first.values():
            if not r[at]:
                continue
            filled += 1
            folded = unicodedata.normalize("NFKC", r[at]).lower()
            found = [w for w in re.findall("[가-힣a-z0-9]+", folded) if not w.isdigit()] if field == "text" else [x for x in (re.sub(r"\s+", " ", p.strip()) for p in re.split("[;,|/]", folded)) if x]
            occurrences.update(found)
            records.update(set(found))
        for term, n in records.items():
            expected[field, term] = (occurrences[term], n, "rare" if n < 3 else "common" if n > 0.3 * filled else None)
    for heavy, light in ((4, 3), (2048, 200_000)):
        counts = terms.term_counts(terms.once_per_record(df, "chunk_id", ["text", "keyword"]), df.select("text", "keyword"), heavy=heavy, light_table=light)
        got = {(r.field_name, r.term): (r.occurrences, r.records, r.mark) for r in terms.marked(counts).collect()}
        assert got == expected
    assert terms.marked(terms.term_counts(df.limit(0).select("text", "keyword"), df.limit(0).select("text", "keyword"))).count() == 0


# p8

VOCABULARY = bpe.DEFAULT_VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the public vocabulary")
TEXTS = [None, "", " ", "\n\n \t", "Hello  world's don't 1234", "리스부채의 장부금액은 69,924백만원입니다.", "<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "한́글 👩‍🔬 𝒳 ﷺ", "the " * 5000, "가나다" * 3000, "\u0000�"]


@needs_vocabulary
def test_encoding_equals_the_public_tokenizer(spark):
    import tiktoken

    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, id string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()}
    assert got == {i: encoding.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    decode = {v: k for k, v in ranks.items()}
    assert all(b"".join(decode[x] for x in got[i]).decode() == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.encode(df.limit(0)).count() == 0


@needs_vocabulary
def test_replay_equals_merging_word_by_word():
    ranks = bpe.read_ranks(VOCABULARY)

    def alone(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    rng = random.Random(4)
    words = list({bytes(rng.choices(b"abeinrst \xea\xb0\x80", k=rng.randint(1, 24))) for _ in range(400)})
    assert bpe.replay(words, ranks) == [alone(w) for w in words]


# p9


def shared_run(a, b, n=50):
    grams = {b[i : i + n] for i in range(len(b) - n + 1)}
    return any(a[i : i + n] in grams for i in range(len(a) - n + 1))


def test_leaks_agree_with_brute_force(spark):
    rng = random.Random(6)
    name = lambda: "".join(rng.choices("곤헤졸뎀샤벡윌눔켄넬", k=3))
    latin = lambda: "".join(rng.choices(["Dra", "zel", "Nul", "vrin", "tem"], k=3)).capitalize()
    items = [f"{name()} 규정 제{rng.randint(1, 999)}조에 따르면 {name()} 설비를 멈춘 {name()} 법인은 {name()} 보고서를 이틀 안에 내야 하지만 {rng.randint(1, 99)}.{rng.randint(1, 99)} 이하이면 면제된다." for _ in range(15)]
    items += [f"When {latin()} deferred its {latin()} covenant, auditors compared {latin()} against tranche {rng.randint(1, 999)} and concluded that {latin()} had drifted by {rng.randint(1, 99)}.5 overall." for _ in range(15)]
    items += [None, "", "짧다"]
    docs = [None, "", "무관한 문장입니다. 당사는 설비를 31기 운영하고 있습니다."]
    for _ in range(150):
        item = rng.choice(items[:30])
        a, b = sorted(rng.sample(range(len(item)), 2))
        cut = item[a:b]
        cut = rng.choice([cut, cut.upper(), unicodedata.normalize("NFD", cut), "​".join(cut), re.sub(" ", "\n  ", cut), re.sub(r"\d+", "7", cut)])
        docs.append(f"머리말 {rng.randint(1, 99)}{cut}{rng.choice(['', ' 끝', '5회'])}")
    docs.append("앞 " * 4000 + items[3] + items[4] + " 뒤" * 4000)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    e = spark.createDataFrame([(100 + i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, e).filter("kind = 'verbatim'").collect()}
    plain = [leakage.stream(t) for t in docs]
    expected = {(i, 100 + j) for i, a in enumerate(plain) for j, t in enumerate(items) if shared_run(a, leakage.stream(t))}
    assert got == expected and len(expected) > 20
    assert leakage.leaks(d.limit(0), e).count() == 0 and leakage.leaks(d, e.limit(0)).count() == 0


def test_reparameterised_question_is_reported_with_consistent_names_only(spark):
    items = [f"다음 중 {a} 협약에 서명한 {b} 조합이 {c} 부담금을 {n}회로 나누어 낼 때 {a} 조항이 먼저 적용되는 경우를 고르고 이유를 쓰시오." for a, b, c, n in (("곤헤졸", "뎀샤벡", "윌눔켄", 91), ("넬겔륜", "욘델칸", "톨뉴르", 5), ("추뷔젠", "뮤딤쿱", "힐랑홉", 286))]
    e = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    changed = items[0].replace("91", "12").replace("뎀샤벡", "욘델칸").replace("윌눔켄", "힐랑홉").replace("곤헤졸", "넬겔륜")
    mixed = changed.replace("넬겔륜 조항", "뮤딤쿱 조항")
    d = spark.createDataFrame([(1, changed), (2, mixed)], "doc_id bigint, text string")
    kinds = {(r.doc_id, r.item_id): r.kind for r in leakage.leaks(d, e).collect()}
    assert kinds.get((1, 0)) == "reparameterised" and (2, 0) not in kinds


def test_runs_of_digits_are_found_without_template_windows(spark):
    digits = "".join(random.Random(2).choices("0123456789", k=70))
    items = [f"표본 {digits} 끝", "1" * 60, f"{digits[:20]} 년 {digits[20:60]} 회 반복"]
    docs = [f"머리 {digits[5:58]} 꼬리", digits[5:50], "3" * 80, f"값 {'1' * 55}", f"{digits[2:20]}년{digits[20:60]}회 반복", f"가나다 {digits[:20]} 년 {digits[20:52]}"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    e = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    expected = {(i, j) for i, a in enumerate(docs) for j, b in enumerate(items) if shared_run(leakage.stream(a), leakage.stream(b))}
    assert {(r.doc_id, r.item_id) for r in leakage.verbatim_leaks(d, e).collect()} == expected and len(expected) == 4


def test_only_templates_find_changed_numbers(spark, monkeypatch):
    sentence = "표에 나온 값을 {}단계 기준으로 환산한 뒤 {}지점과 비교하면 항목은 몇 단계 차이가 나는지 {}.{}를 써서 답하라."
    e = spark.createDataFrame([(i, sentence.format(12 * i, 345, 6 * i, 78)) for i in (1, 2, 3)], "item_id bigint, text string")
    d = spark.createDataFrame([(7, sentence.format(9, 1, 777, 5))], "doc_id bigint, text string")
    assert [(r.doc_id, r.item_id, r.kind, r.items) for r in leakage.leaks(d, e).collect()] == [(7, 1, "reparameterised", 3)]
    monkeypatch.setattr(leakage, "template", lambda text: text)
    monkeypatch.setattr(leakage, "places", lambda text: np.arange(len(text) + 1))
    assert leakage.leaks(d, e).count() == 0


# p10

KOREAN = ["당사는 금리 상승 대응 및 공급망 실사를 점검합니다.", "리스부채의 장부금액은 {}백만원이며 유동 항목은 약 {}억원입니다.", "종업원 수는 {}명이며 평균 근속연수는 {}년입니다.", "감가상각은 정액법을 적용하며 설비의 내용연수는 {}년입니다.", "주요 고객에 대한 매출 비중은 전체의 {}%를 차지하고 있습니다."]
DECOYS = ["株式會社 寶林電子有限公司 當期純利益", "Ärger über Gebühr, crème brûlée – “à part”", "①②③ ㈜ ㎡ …………… ━━━━", "𝒳𝒴 = 𝟙 👩‍🔬 ๑๒๓ ﷺ", "costs were £2,051; the Company’s façade, €4 million", "한́글 ‮abc‬", unicodedata.normalize("NFD", "어긋나므로 담당자는"), "Really? No."]
CHAINS = [("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp949", "latin-1"), ("cp949", "gbk")]


def test_garbled_texts_are_found_and_restored(spark):
    rng = random.Random(8)
    clean = [" ".join(rng.choice(KOREAN).format(rng.randint(1, 9999), rng.randint(1, 99)) for _ in range(4)) for _ in range(400)]
    rows, truth = [], {}
    for i, text in enumerate(clean):
        rows.append((i, text + ("\n" + rng.choice(DECOYS) if i % 4 == 0 else "")))
    for n, (right, wrong) in enumerate(CHAINS * 4):
        key, text = 1000 + n, clean[n]
        words = text.split(" ")
        a = 0 if n % 2 else rng.randrange(len(words) - 3)
        b = len(words) if n % 2 else a + 3
        garbled = " ".join(words[a:b]).encode(right).decode(wrong)
        rows.append((key, " ".join([*words[:a], garbled, *words[b:]])))
        truth[key] = text
    twice = clean[0].encode().decode("latin-1").encode().decode("latin-1")
    rows += [(2000, twice), (2001, clean[1].encode("cp949").decode("utf-8", "replace")), (2002, "| ??? ?? | 31,839 |\n" + clean[2]), (2003, "although â\x80\x9cpass-throughâ\x80\x9d clauses"), (2004, None), (2005, "")]
    rows += [(3000 + i, "The “core” units limit it, although “pass-through” clauses apply.") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in mojibake.find_garbled(df).collect()}
    assert set(got) == {*truth, 2000, 2001, 2002, 2003}
    assert {k: got[k].restored for k in truth} == truth
    assert got[2000].restored == clean[0] and got[2003].restored == "although “pass-through” clauses"
    assert got[2001].status == "unrestorable" and got[2002].status == "unrestorable"


def test_garbled_on_empty_input(spark):
    assert mojibake.find_garbled(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_margin_follows_the_texts_and_not_their_order(spark):
    rng = random.Random(4)
    words = "매출액 영업이익 당기순이익 종업원 설비 투자 자산 부채 자본 계약 공급 생산 판매".split()
    rows = [(i, " ".join(rng.choices(words, k=12))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    fits = [mojibake.fitted(x) for x in (df.repartition(1), df.repartition(5), df.orderBy("text"))]
    assert len({(margin, rates) for _, margin, rates in fits}) == 1 and fits[0][1] > 0 and max(fits[0][2]) <= 0.02


def test_chains_of_two_codecs_and_hangul_alone(spark):
    rng = random.Random(4)
    words = "매출액 영업이익 당기순이익 종업원 설비 투자 자산 부채 자본 계약 공급 생산 판매".split()
    clean = [" ".join(rng.choices(words, k=12)) for _ in range(300)]
    twice = "당기순이익".encode().decode("latin-1").encode().decode("mac_roman")
    df = spark.createDataFrame([*enumerate(clean), (1000, f"{clean[0]} {twice} {clean[1]}")], "doc_id bigint, text string")
    assert {(r.doc_id, r.restored) for r in mojibake.find_garbled(df).collect()} == {(1000, f"{clean[0]} 당기순이익 {clean[1]}")}
    hangul = "éü".encode().decode("cp949")
    assert re.fullmatch("[가-힣]+", hangul) and [c[2:] for c in mojibake.candidates(f"a {hangul} b", {})] == [("éü", "cp949>utf-8")]
