"""Encodings, scanned pages, containers and mixtures."""

import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import canonical, mixture, mojibake as moji, packing, scans, sizes  # noqa: E402

CLEAN = [
    "Le réseau complète les données déjà calculées – très élevée, “naïve” s’accélère.", "Für die Lösung genügt ein Prüfkörper, Größe außerdem ähnlich.", "O código não altera a avaliação após a solução: ATENÇÃO!",
    "Każdy układ wymaga, żeby wartość była wcześniej sprawdzona; błąd rośnie.", "Каждый узел меняет, если память становится длиннее. Поэтому выборка зависит от того.", "We write Ã for the padded adjacency and Â = D⁻¹Ã for its form.",
    "Let Ð be the graph and Þ the rest; Ð ∩ Þ is empty. Â·â stays small.", "Exports once showed “Ã©” where “é” was meant; “�” is a placeholder and “â€™” is quoted.", "┌────┬────┐ │ 24 │ 56 │ └────┴────┘ ± 1½ Ægir²", "plain ascii",
]
DOCS = "doc_id bigint, text string, word string, fixes string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "w", "f") for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"])
@pytest.mark.parametrize("text", CLEAN[:5])
def test_multi_byte_mistakes_are_undone(text, wrong):
    garbled = moji._read(text.encode("utf-8"), wrong)
    fixed, whole = moji.repair(garbled, {})
    assert (fixed, whole) == (text, True)


def test_twice_garbled_is_undone():
    for text in CLEAN[:4]:
        garbled = moji._read(moji._read(text.encode(), "cp1252").encode(), "cp1252")
        assert moji.repair(garbled, {}) == (text, True)


def test_mixed_text_stays_untouched_around_the_span():
    text = "début correct, " + moji._read("généralité".encode(), "cp1252") + " et fin élevée"
    assert moji.repair(text, {})[0] == "début correct, généralité et fin élevée"


def test_found_and_restored(spark):
    one_byte = [CLEAN[0].encode("cp1252", "replace").decode("mac_roman"), CLEAN[4].encode("cp1251").decode("cp1252"), CLEAN[4].encode("koi8_r").decode("cp1251"), CLEAN[3].encode("cp1250").decode("cp1252", "replace")]
    bad = [moji._read(CLEAN[1].encode(), "cp1252"), *one_byte, "Pe�arvil calls this the �stable� one", "Figure – sâ€™accÃ©lÃ¨re", moji._read(CLEAN[1].encode(), "cp1252")]
    texts = CLEAN * 4 + bad + [None, "", "x" * 300_000]
    df = documents(spark, texts)
    want = set(range(len(CLEAN) * 4, len(CLEAN) * 4 + len(bad)))
    assert {r.doc_id for r in moji.affected(df).collect()} == want
    back = {r.doc_id: r for r in moji.restore(df).collect()}
    assert set(back) == want
    first = len(CLEAN) * 4
    assert back[first].restored == CLEAN[1] and back[first + 2].restored == CLEAN[4] and back[first + 3].restored == CLEAN[4]
    assert not back[first + 5].whole
    assert moji.affected(df.limit(0)).count() == 0 and moji.restore(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [200, 1000])
def test_copies_of_a_garbled_text_do_not_hide_it(spark, copies):
    one_byte = CLEAN[0].encode("cp1252", "replace").decode("mac_roman")
    assert not moji.sequence_spans(one_byte) and not moji.lost_spans(one_byte)
    clean = [f"{t} {i}" for i in range(4) for t in CLEAN]
    df = documents(spark, clean + [one_byte] * copies)
    want = set(range(len(clean), len(clean) + copies))
    assert {r.doc_id for r in moji.affected(df).collect()} == want
    back = {r.doc_id: r.restored for r in moji.restore(df).collect()}
    assert set(back) == want and all("réseau complète les données" in t for t in back.values())


SCRIPTS = ["😀 hi 🎉 there", "中文字符测试", "これはテストです", "שלום עולם", "مرحبا بالعالم", "ภาษาไทย", "Ελληνικά, έκδοση ήταν", "oﬁx ﬁeld", "costs ₹5", "a ≡ b", "Kağıt üzerinde", "한국어 문장"]


@pytest.mark.parametrize("text", SCRIPTS)
@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "cp437", "cp1251"])
def test_sequences_of_every_script(text, wrong):
    assert moji.repair(moji._read(text.encode("utf-8"), wrong), {}) == (text, True)
    assert moji.sequence_spans(text) == []


@pytest.mark.parametrize("text", ["«\xa0employé\xa0»", "“employé…”", "so „groß”", "à «\xa0mot\xa0»", "CAFÉ»", "работа так тел раб", "«слово…»", "使用BERT模型进行测试，结果如下", "Ærø ½²", "żółć gęślą", "日本語のテスト", "русский — «цитата»…"])
def test_correct_text_is_left_alone(text):
    assert moji.sequence_spans(text) == []


@pytest.mark.parametrize("wrong", ["gbk", "cp949"])
def test_multi_byte_encodings(wrong):
    assert moji.repair("déjà élevé".encode().decode(wrong), {}) == ("déjà élevé", True)
    assert moji.repair("中文测试".encode("gb2312").decode("latin_1"), {}) == ("中文测试", True)


def test_scripts_are_found_in_a_collection(spark):
    bad = [moji._read(t.encode(), "cp1252") for t in ("emoji 😀", "中文字符", "שלום", "été")]
    assert {r.doc_id for r in moji.affected(documents(spark, [*SCRIPTS, *bad])).collect()} == set(range(len(SCRIPTS), len(SCRIPTS) + 4))


def test_more_garbled_words_than_fit_the_automaton(spark, monkeypatch):
    monkeypatch.setattr(moji, "PATTERNS", 1)
    test_found_and_restored(spark)


BODY = "The reader compresses the passage only for redundant inputs and the careful decoder selects every low-rank sentence. "


def pages(n=40):
    out = []
    rng = random.Random(5)
    for i in range(n):
        words = (BODY * 3).split()
        ls = [" ".join(words[j : j + 8]) for j in range(0, len(words), 8)]
        at = rng.randint(2, len(ls) - 2)
        out.append("\n".join([*ls[:at], "", "Annals of Inferred Machines, vol. 3", str(10 + i), "", *ls[at:]]))
    return out


CHUNKS = "chunk_key bigint, content string, metadata struct<source:string>, key string, heads string"


def chunks(spark, texts):
    return spark.createDataFrame([(i, t, ("paper.md",), "k", "h") for i, t in enumerate(texts)], CHUNKS)


def test_lines_of_scanned_pages(spark):
    odd = "\n".join([
        "The rcader compresses the passage only for redun-", "dant inputs and the careful low-", "rank sentence. The decoder selects", "Annals of Inferrcd Machines, vol. 3", "- 57 -", "every sen¬", "tence.", "", "Widths tried:", "32", "64", "128",
    ])
    texts = pages() + [odd, None, "", "Clean text about the reader and the passage.", "word " * 50_000]
    got = defaultdict(set)
    for r in scans.line_kinds(chunks(spark, texts)).collect():
        got[r.chunk_key].add((r.line_no, r.kind))
    assert got[40] == {(1, "misread"), (1, "hyphen"), (4, "header"), (5, "page_number"), (6, "hyphen")}
    assert not {41, 42, 43, 44} & set(got)
    for i in range(40):
        assert Counter(k for _, k in got[i]) == {"header": 1, "page_number": 1}
    mended = {r.chunk_key: r.text for r in scans.mended(chunks(spark, texts)).collect()}
    assert mended[40].startswith("The reader compresses the passage only for redundant inputs and the careful low-rank sentence. The decoder selects every sentence.")
    assert "Annals" not in mended[0] and mended[0].replace("\n\n", " ").split() == (BODY * 3).split()
    assert scans.line_kinds(chunks(spark, [])).count() == 0 and scans.mended(chunks(spark, [None, ""])).count() == 0


def test_automaton_finds_every_reading():
    words = {"unclear": 50, "clear": 40, "modern": 30, "corner": 30, "burns": 9, "window": 9}
    v = scans.Trie(words)
    for w in words:
        for plain, misread in scans.CONFUSIONS:
            at = w.find(plain)
            while at >= 0:
                garbled = w[:at] + misread + w[at + len(plain) :]
                if garbled not in words:
                    assert (1, True, w) in v.candidates(garbled) and (1, True, w) in v.candidates(garbled, False), (w, garbled)
                at = w.find(plain, at + 1)


def test_automaton_finds_every_word_within_the_edits():
    rng = random.Random(7)
    letters = "abcde"
    words = {"".join(rng.choices(letters, k=rng.randint(3, 9))): 5 for _ in range(300)} | {"reader": 9, "memory": 9, "attention": 9}
    v = scans.Trie(words)
    for garbled in ["reoder", "memoty", "attenton", "rreader", *("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(60))]:
        got = {w for _, _, w in v.candidates(garbled)}
        edited = {w for _, sure, w in v.candidates(garbled) if not sure}
        frequent = scans.Trie({w: 1000 for w in words})
        assert frequent.may_edit(garbled, 1000) or not edited, (garbled, edited)
        for w in words:
            edits = canonical.swap_distance(garbled, w, 2)
            if w != garbled and edits * 2 <= scans.budget(len(garbled)):
                assert w in got, (garbled, w)
    assert all(any(w in words for _, _, w in v.candidates(g)) for g in ("reoder", "memoty", "attenton", "rreader"))


def test_plain_edits_need_the_word_in_the_same_text(spark):
    texts = [BODY * 3 + f"\nPage {i} of it wraps\nover four\nlines" for i in range(100)]
    odd = (BODY + "The reoder sees it.").replace("only for", "only\nfor").replace("careful", "care-\nful") + "\nEnd"
    far = "Some reoder in a text\nthat has not the other\nword and wraps over\nlines"
    inflected = odd.replace("reoder", "readers")
    got = {(r.chunk_key, r.kind) for r in scans.line_kinds(chunks(spark, [*texts, odd, far, inflected])).collect()}
    assert {k for k, kind in got if kind == "misread"} == {100}


def test_a_correct_rare_word_stays_whatever_the_size(spark):
    body = [BODY * 3 for _ in range(300)] + ["A modem is no modern thing, and a bum can burn."] * 4
    assert {r.kind for r in scans.line_kinds(chunks(spark, body)).collect()} <= {"header"}


def test_findings_beyond_the_broadcast_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(scans, "FINDINGS", 1)
    test_lines_of_scanned_pages(spark)


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_everything_within_capacity(seed):
    rng = random.Random(seed)
    capacity = rng.choice([64, 512, 3000])
    histogram = Counter(min(capacity, max(1, int(rng.expovariate(1 / rng.choice([5, 60, 900]))))) for _ in range(rng.choice([1, 50, 4000])))
    rows = packing.plan(dict(histogram), capacity)
    packed = Counter()
    for many, config in rows:
        assert sum(n * m for n, m in config.items()) <= capacity
        for n, m in config.items():
            packed[n] += many * m
    assert packed == histogram
    total = sum(n * c for n, c in histogram.items())
    lower = -(-total // capacity)
    assert sum(m for m, _ in rows) <= max(lower + 2, 1.12 * lower)
    assert packing.plan({}, capacity) == []


def test_packing_splits_only_what_exceeds(spark):
    docs = [(1, 10), (2, 0), (3, 25), (4, 10), (5, 7), (6, 3), (7, 10), (8, None)] + [(i, 4) for i in range(100, 160)]
    df = spark.createDataFrame([(i, n, "c") for i, n in docs], "doc_id bigint, tokens bigint, container string")
    kinds = spark.createDataFrame([("s", 10), ("l", 30)], "container_kind string, capacity_tokens int")
    out = packing.pack_all(df, "doc_id", kinds).collect()
    held = defaultdict(int)
    size = defaultdict(int)
    for r in out:
        held[r.container_kind, r.container] += r.length
        size[r.container_kind, r.doc_id] += r.length
        if r.pieces > 1:
            assert (r.container_kind, r.doc_id) == ("s", 3)
    assert all(v <= {"s": 10, "l": 30}[k] for (k, _), v in held.items())
    want = {i: n for i, n in docs if n}
    assert {k: {i: v for (kk, i), v in size.items() if kk == k} for k in "sl"} == {"s": want, "l": want}
    assert packing.pack_all(df.limit(0), "doc_id", kinds).count() == 0 and packing.pack_all(df, "doc_id", kinds.limit(0)).count() == 0


def test_raking_meets_the_source_shares_and_caps():
    cells = [("a", "en", 1, 600), ("a", "de", 2, 400), ("b", "en", 1, 100), ("b", "fr", 2, 50), ("c", "en", 2, 500)]
    w = mixture.rake(cells, {"a": 0.5, "b": 0.3, "c": 0.1, "gone": 0.1}, {"a": 1, "b": 3, "c": 2, "gone": 9})
    made = Counter()
    for c in cells:
        made[c[0]] += w[c[:3]] * c[3]
        assert w[c[:3]] <= {"a": 1, "b": 3, "c": 2}[c[0]] + 1e-9
    total = sum(made.values())
    assert {s: made[s] / total for s in "abc"} == pytest.approx({"a": 5 / 9, "b": 3 / 9, "c": 1 / 9})
    assert mixture.rake([], {"a": 1.0}, {"a": 1}) == {}


def test_mixture_reaches_shares_without_exceeding_repeats(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "no target"]), rng.choice(["en", "DE", None]), rng.choice(["x", "y", None]), rng.randint(1, 60), 9) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, tokens bigint, copies int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(sized, targets)
    report = {r.source: r for r in mixture.share_report(mixed, targets).collect()}
    assert report["none"].share == 0 and report["none"].documents == 0
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert report[s].share == pytest.approx(share / 0.95, rel=0.01)
        assert report[s].most_uses <= report[s].max_repeats
    assert mixed.where("source is null or source = 'no target'").count() == 0
    empty = mixture.mix(sized.limit(0), targets)
    assert empty.count() == 0 and {r.tokens for r in mixture.share_report(empty, targets).collect()} == {0}


def test_raking_meets_the_share_of_every_topic(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("aabc"), rng.choice(["en", "de"]), f"paper {rng.randrange(700)}", rng.randint(1, 60)) for i in range(20_000)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.45, 6), ("b", 0.3, 6), ("c", 0.25, 6)], "source string, target_share double, max_repeats int")
    cells = {rows[r.doc_id][1:4]: r.weight for r in mixture.mix(sized, targets, total=1_200_000.0).collect()}
    have, made = Counter(), Counter()
    for _, source, lang, topic, tokens in rows:
        have[topic] += tokens
        made[topic] += tokens * cells.get((source, lang, topic), 0.0)
    share = sum(made.values()) / sum(have.values())
    assert max(abs(made[t] / have[t] / share - 1) for t in have) < 0.02


def test_token_sizes(spark):
    import os

    if not os.path.exists(sizes.DEFAULT_TOKENIZER):
        pytest.skip("no tokenizer files here")
    df = documents(spark, ["Hello world", None, "", "<|endoftext|>", "a" * 200_000])
    got = {r.doc_id: r.tokens for r in sizes.token_sizes(df).collect()}
    assert (got[0], got[1], got[2]) == (2, 0, 0) and got[3] > 1 and got[4] > 1000
