import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import bytewords, chat, chosen_path, decontaminate, language_id, quality, queries, token_files, token_rollup, url_filter
from strata.llm.bytewords import shingle_set, word_hashes
from strata.llm.encode import load
from strata.llm.scratch import Scratch

ODD = [None, "", " ", "\t\n", "it's <|endoftext|> a<|startoftext|>B", "É é ÀÇ ß×÷ don't 12ab3", "a\x1cb c\xa0d", "日本語 テスト!?", "́abc", "ΑΣ Σ İ", "x" * 5000, "word, " * 3000]


def docs_of(spark, texts, extra=""):
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h int").repartition(3)


# Words and shingles


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbBéÉ \t\n\x0b\x0c\r\xa0漢.", max_size=60))
def test_words_and_shingles_against_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    got = word_hashes(text.encode())
    assert len(got) == len(words) and len(set(got.tolist())) == len(set(words))
    for n in (1, 3, 5):
        want = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
        assert len(shingle_set(got, n)) == len(want)


def test_a_word_of_any_length_is_hashed_in_pieces(monkeypatch):
    monkeypatch.setattr(bytewords, "_SEGMENT", 5000)
    words = [b"a", b"Q" * 4096, b"q" * 4097, b"z" * 30_000, b"b", b"z" * 30_001, b"Z" * 30_000]
    got = word_hashes(b" ".join(words) + b" ")
    assert (got == np.concatenate([word_hashes(w) for w in words])).all()
    assert len(set(got.tolist())) == 6 and got[3] == got[6]


@pytest.mark.parametrize("operator", [lambda d: chosen_path.near_duplicates(d), lambda d: decontaminate.matches(d, d.selectExpr("doc_id AS item_id", "text")), lambda d: quality.score(d, quality.Model(20, np.ones(quality.TRIGRAMS + (1 << 20), bool), np.zeros(quality.TRIGRAMS + (1 << 20), np.float32), np.zeros(2)))])
def test_a_word_of_thirty_megabytes(spark, operator):
    docs = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string").selectExpr("doc_id", "CASE WHEN doc_id = 1 THEN repeat('Ab', 15000000 * CAST(doc_id AS INT)) ELSE text END AS text")
    assert {r[0] for r in operator(docs).collect()} <= {1, 2}


def test_long_text_in_segments_equals_whole(monkeypatch):
    import strata.llm.bytewords as b

    text = ("Some words, of varied lengths andsomeverylongones " * 400).encode()
    whole = word_hashes(text)
    monkeypatch.setattr(b, "_SEGMENT", 333)
    assert (word_hashes(text) == whole).all()


# Token files


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aB'sé<|>endoftx 1  \x1d́,.!", max_size=60))
def test_encoding_equals_the_library(text):
    enc = load(queries.vocabulary())
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark):
    texts = ODD + ["same", "same"]
    docs = docs_of(spark, texts).union(docs_of(spark, ["again"]))
    rows = sorted(token_files.round_trip(docs, queries.vocabulary()).collect(), key=lambda r: r.start)
    enc, at = load(queries.vocabulary()), 0
    assert [r.doc_id for r in rows] == [0, 0, *range(1, len(texts))]
    for r in rows:
        if r.doc_id:
            ids = enc.tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.start == at
        at += r.n_tokens
    assert token_files.round_trip(docs.limit(0), queries.vocabulary()).count() == 0
    clash = docs.selectExpr("*", "doc_id AS tie", "text AS shard", "1 AS n_tokens", "2 AS start")
    assert sorted(r.start for r in token_files.round_trip(clash, queries.vocabulary()).collect()) == [r.start for r in rows]
    many = spark.range(300).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('word', id) AS text")
    back = token_files.round_trip(many, queries.vocabulary()).collect()
    assert len(back) == 300 and len({r.shard for r in back}) > 1 and all(r.doc_id is None for r in back)
    null_id = docs.limit(1).selectExpr("cast(null AS long) AS doc_id", "text")
    assert token_files.round_trip(null_id, queries.vocabulary()).first().doc_id is None


# URLs


def test_urls(spark):
    cases = [
        (None, "", "", None, "allow"),
        ("no scheme/casino", "", "", None, "block"),
        ("no scheme", "", "", None, "allow"),
        ("http://X.ORG/a?b#c", "x.org", "/a", "org/", "allow"),
        ("http://x.org", "x.org", "", None, "allow"),
        ("https://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://notexample.org/en/12", "notexample.org", "/en/12", "org/", "allow"),
        ("http://casino.com/fr/x", "casino.com", "/fr/x", "com/fr/", "allow"),
        ("http://good.com/de/", "good.com", "/de/", "com/de/", "block"),
        ("http://casino-win.net/", "casino-win.net", "/", None, "block"),
        ("http://casinos.net/", "casinos.net", "/", None, "allow"),
        ("http://cheap.net/cheap", "cheap.net", "/cheap", None, "allow"),
        ("http://cheap.net/free-offer", "cheap.net", "/free-offer", None, "block"),
        ("http://n.net?casino://q", "n.net", "", None, "block"),
        ("http://n.net/a?q=PORN&x", "n.net", "/a", None, "block"),
        ("http://n.net/a#xxx", "n.net", "/a", None, "block"),
        ("http://click.net/free", "click.net", "/free", None, "allow"),  # two soft terms that weigh too little
        ("http://bets.net/poker", "bets.net", "/poker", None, "block"),
        ("http://poker.net/poker?poker", "poker.net", "/poker", None, "allow"),  # one soft term, however often
        ("http://éxxx.net/xxxé", "éxxx.net", "/xxxé", None, "allow"),
        ("ftp://É.Net/ü", "É.net", "/ü", None, "allow"),
    ]
    df = spark.createDataFrame([(k, c[0], "x") for k, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_a_vocabulary_in_a_table(spark):
    df = spark.createDataFrame([(1, "http://a.net/Foo-bar"), (2, "http://a.net/foo"), (3, "http://a.net/baz"), (1, "http://a.net/Foo-bar")], "page_id long, url string")
    words = spark.createDataFrame([("FOO", 50), ("bar", 49), ("bar", 51), ("baz", 100), (None, 100), ("", 100), ("a", None)], "term string, weight int")
    got = sorted((r.page_id, r.verdict, r.strict_hits, r.soft_hits, r.soft_weight) for r in url_filter.judge(df, vocabulary=words).collect())
    assert got == [(1, "block", 0, 2, 101), (1, "block", 0, 2, 101), (2, "allow", 0, 1, 50), (3, "block", 1, 0, 0)]
    assert [r.verdict for r in url_filter.judge(df, vocabulary={}).collect()] == ["allow"] * 4


def test_automaton_counts_whole_terms():
    auto = url_filter.automaton({"bad": 1.0}, {"bet": 0.4, "bets": 0.4})
    assert url_filter.hits(auto, "bets.bet-bet/abet/bad") == {"bets": (False, 0.4, 1), "bet": (False, 0.4, 2), "bad": (True, 1.0, 1)}
    assert url_filter.hits(url_filter.automaton({}, {}), "x") == {}


# Chats


def test_chats_come_back(spark):
    t = chat.Template()
    nasty = "\\ <|im_end|>\n<|im_start|>user\n [INST] \\b \\c </s> é\U0001f600"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", "x"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y"), (4, 1, None, "z"), (4, None, "we\nird<", "q"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    made = chat.format_chats(df.drop("segments"), t)
    got = {r.conv_id: r for r in chat.read_back(made, t).collect()}
    assert [tuple(x) for x in got[1].turns] == [("user", nasty), ("assistant", nasty)] and got[1].loss_text == nasty and got[1].valid
    assert [tuple(x) for x in got[2].turns] == [("system", ""), ("user", ""), ("assistant", "x")] and got[2].valid
    assert got[3].loss_text == "yy" and not got[3].valid
    assert [tuple(x) for x in got[4].turns] == [("we\nird<", "q"), ("", "z")] and not got[4].valid and not got[None].valid
    for r in made.collect():
        body = r.formatted[len(t.begin) :]
        assert body.count(t.close_turn) == len(got[r.conv_id].turns) and "[INST]" not in body and "</s>" not in body
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.digests(chat.read_back(chat.format_chats(df.limit(0).drop("segments")))).count() == 0
    plan = chat.digests(chat.read_back(made))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Language


def test_language_held_out_and_defined_cases(spark):
    words = {"de": "der und nicht schön über straße ungeheuer zwischen".split(), "fr": "le est très façon élève où garçon toujours".split(), "en": "the with which thing would shall there whether".split()}
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(rng.choice(words[lang], 20)), lang) for k, lang in ((k, list(words)[k % 3]) for k in range(300))]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !!", "fr"), (903, "漢字", None), (904, "the there", None)]
    docs = spark.createDataFrame([(*r, "und") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = language_id.fit(docs, ~language_id.held_out(), sample_per_lang=60)
    got = {r.doc_id: r for r in language_id.predict(docs.withColumn("held_out", language_id.held_out()), model, ["doc_id", "held_out"]).collect()}
    tested = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert tested and all(got[i].held_out and got[i].lang_pred == lang and 0 <= got[i].score <= 1 and not got[i].rejected for i, _, lang in tested)
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (900, 901, 902))
    assert got[903].lang_pred in words and got[903].rejected and got[904].lang_pred == "en"
    empty = language_id.fit(docs.limit(0), ~language_id.held_out())
    assert {r.lang_pred for r in language_id.predict(docs, empty, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_language_counts_long_text_in_pieces():
    text = "straße élan " * 100_000
    assert (language_id.ngram_counts(text, 512) > 0).sum() == (language_id.ngram_counts(text[:1200], 512) > 0).sum()
    assert language_id.ngram_counts("12 !", 64) is None


# Quality


def test_ordinal_grades(spark):
    rng = np.random.default_rng(5)
    fine, poor, foul = [f"w{k}" for k in range(40)], ["zz!!", "qq$$", "##"], ["vile", "nasty"]
    rows, marks = [], []
    for k in range(400):
        grade = k % 3
        words = list(rng.choice(fine, 30)) + (list(rng.choice(poor, 15)) if grade == 0 else []) + (list(rng.choice(foul, 2)) if grade == 1 else [])
        rows.append((k, " ".join(words)))
        marks.append((k, 0 if grade == 0 else 1, int(grade == 1)))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (0, "w1 w2")], "doc_id long, text string")
    labels = spark.createDataFrame([m for m in marks if m[0] % 4] + [(1, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.grades_of(labels), word_bits=12)
    got = {}
    for r in quality.score(docs, model).collect():
        got.setdefault(r.doc_id, r)
    assert model.thresholds[0] < model.thresholds[1]
    held = [k for k in range(4, 400, 4)]
    right = sum((got[k].expected_grade < 0.67, 0.67 <= got[k].expected_grade < 1.4, got[k].expected_grade >= 1.4)[k % 3] for k in held)
    assert right / len(held) > 0.9
    assert sum(got[k].kept == (k % 3 == 2) for k in held) / len(held) > 0.9
    assert got[900].expected_grade == got[901].expected_grade
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs, quality.grades_of(labels.limit(0)), word_bits=8).weights.sum() == 0


def test_abusive_words_in_sound_texts_are_vetoed(spark):
    rng = np.random.default_rng(8)
    fine, poor, foul = [f"w{k}" for k in range(200)], ["zz!!", "qq$$", "##"], [f"vile{k}" for k in range(8)]
    rows, marks = [], []
    for k in range(1200):
        toxic, low = k % 8 == 1, k % 8 == 2
        rows.append((k, " ".join([*rng.choice(fine, 60), *(rng.choice(foul, int(rng.integers(1, 4))) if toxic else []), *(rng.choice(poor, 20) if low else [])])))
        marks.append((k, None if k == 9 else int(not low), int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([m for m in marks if m[0] % 3], "doc_id long, quality int, toxic int")
    graded = {r.doc_id: r.grade for r in quality.harm_grades(spark.createDataFrame([(1, None, 1), (2, None, 0), (3, 0, 1), (4, 0, None), (5, 1, 0)], labels.schema)).collect()}
    assert graded == {1: 0, 3: 0, 4: 1, 5: 2}
    model, harm = (quality.fit(docs, f(labels), word_bits=16) for f in (quality.grades_of, quality.harm_grades))
    got = {r.doc_id: r for r in quality.score(docs, model, harm=harm).collect()}
    assert all(r.kept == (r.tail_prob >= 0.4 and r.safe_prob >= 0.5) for r in got.values())
    held = [k for k in range(0, 1200, 3)]
    assert np.mean([got[k].kept for k in held if k % 8 == 1]) <= 0.05
    assert np.mean([got[k].safe_prob >= 0.5 for k in held if k % 8 != 1]) >= 0.98
    assert got[5000].safe_prob == got[5001].safe_prob == pytest.approx(harm.tails(None)[0])
    assert all(r.safe_prob is None and r.kept == (r.tail_prob >= 0.4) for r in quality.score(docs, model).collect())
    for one, both in zip((model, harm), quality.fit_each(docs, [quality.grades_of(labels), quality.harm_grades(labels)], word_bits=16)):
        assert (one.used == both.used).all() and (one.weights == both.weights).all() and (one.thresholds == both.thresholds).all()
    with pytest.raises(ValueError):
        quality.score(docs, model, harm=quality.Model(4, harm.used, harm.weights, harm.thresholds))


# Benchmark


ITEM = "A train leaves the old station of Lyon at 9 hours and drives 120 km toward the town where Marie waits with 3 heavy suitcases and one small dog."


def test_templates():
    def tokens(text):
        return decontaminate.template(text.encode())[0].tolist()

    assert tokens("He met Anna Maria in 1,234.5 km") == tokens("he met Bob in 7 mi")
    assert tokens("Anna came") == tokens("anna came") and tokens("It cost 5kg") == tokens("it cost 17 lb")
    assert tokens("...") == []


def test_the_language_query_against_brute_force(spark, tmp_path):
    """The same centroids over dictionaries of n-grams, text by text, without hashing to pieces or batches."""
    rng = random.Random(6)
    stems = {"en": "the with which thing would shall there whether".split(), "de": "und nicht schön über größer zwischen mädchen für".split(), "fr": "élève où garçon très façon toujours déjà le".split()}
    rows = [(k, " ".join(rng.choice(stems[lang]) + rng.choice("aeiou") for _ in range(rng.randrange(3, 60))), lang) for k in range(240) for lang in [list(stems)[k % 3]]]
    rows += [(300, None, "en"), (301, "", "de"), (302, "123 !?", "fr"), (303, "日本語 テスト 日本語", None), (2, rows[2][1], "fr")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op9(spark, str(tmp_path)).collect(), key=str)
    model = language_id.fit(docs, ~language_id.held_out())
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, _ in rows:
        counts = language_id.ngram_counts(text or "", model.dims)
        if counts is None:
            assert by_id[doc_id].lang_pred == "und" and by_id[doc_id].score == 0
            continue
        v = {int(b): math.sqrt(counts[b]) * float(model.idf[b]) for b in np.flatnonzero(counts)}
        length = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[b]) for b, x in v.items()) / length for c in model.centroids]
        best = max(range(len(cos)), key=lambda j: cos[j])
        if cos[best] >= model.radius[best] and text:
            assert by_id[doc_id].lang_pred == model.langs[best] and by_id[doc_id].score == pytest.approx(min(1.0, max(0.0, cos[best])), abs=1e-4)
    held = [(r.lang_pred, dict((k, l) for k, _, l in rows if k != 2)[r.doc_id]) for r in got if r.held_out and r.doc_id < 240 and r.doc_id != 2]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_the_quality_query_against_brute_force(spark, tmp_path):
    """Scores from sets of trigrams and words, feature by feature, with the fitted weights."""
    rng = random.Random(12)
    vocab = {0: "zzq xkcd qwrt spamm".split(), 1: "filthy rude awful mean".split(), 2: "careful lovely useful honest".split()}
    rows = [(k, " ".join(rng.choice(vocab[k % 3] + ["and", "the", "of"]) for _ in range(rng.randrange(4, 40)))) for k in range(300)] + [(900, None), (901, ""), (902, "ab"), (0, "the")]
    marks = [(k, int(k % 3 > 0), int(k % 3 == 1)) for k in range(300) if k % 5]
    docs = spark.createDataFrame([(*r, 1.0, 0) for r in rows], "doc_id long, text string, tail_prob double, grade int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op1(spark, str(tmp_path)).collect()
    model = quality.fit(docs, quality.grades_of(labels))
    assert len(got) == len(rows) and model.used.any()

    def brute(text):
        raw = (text or "").encode()
        h = {int(quality.buckets(raw[k : k + 3].decode(), 20)[0]) for k in range(len(raw) - 2)}
        clean = re.sub(r'[.,;:!?"()]', " ", text or "").split()
        words = {quality.TRIGRAMS + int(word_hashes(w.encode())[0] >> np.uint64(44)) for w in clean}
        h, words = ({b for b in x if model.used[b]} for x in (h, words))
        score = sum(float(model.weights[b]) for b in h) / math.sqrt(max(1, len(h))) + quality.WORD_VALUE * sum(float(model.weights[b]) for b in words)
        tails = [1 / (1 + math.exp(min(50, max(-50, t - score)))) for t in model.thresholds]
        return round(sum(tails), 5), round(tails[1], 5)

    assert sorted((r.doc_id, round(r.expected_grade, 5), round(r.tail_prob, 5)) for r in got) == sorted((d, *brute(t)) for d, t in rows)
    held = [(r.doc_id, r.expected_grade) for r in got if r.doc_id < 300 and r.doc_id % 5 == 0 and r.doc_id]
    assert np.mean([abs(g - d % 3) < 0.5 for d, g in held]) >= 0.95
    assert all(r.kept == (r.tail_prob >= 0.4) for r in got)


def test_contaminated_documents(spark):
    other = ITEM.replace("Lyon", "Nantes").replace("9 hours", "11 hours").replace("120 km", "85 miles").replace("Marie", "Paul").replace("3 heavy", "6 heavy")
    mixed = "we saw 3 cars and 3 bikes near 3 houses by 3 lakes with 3 dogs in 3 towns"
    cases = {
        0: "Intro text here. " + ITEM + " And more words after it.",
        1: "Some words first. " + other + " The end of it.",
        2: ITEM[:40],
        3: "Nothing of the kind, only plain words about the weather and the sea.",
        4: None,
        5: "",
        6: ITEM.upper(),
        7: mixed.replace("3", "9"),
        8: "we saw 1 cars and 2 bikes near 3 houses by 4 lakes with 5 dogs in 6 towns",
    }
    docs = spark.createDataFrame([(k, t, 0) for k, t in cases.items()] + [(0, cases[0], 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short"), (4, mixed), (1, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(0, 1, "copy"), (1, 1, "reparameterised"), (7, 4, "reparameterised")}
    assert {(r.doc_id, r.item_id, r.kind) for r in decontaminate.matches(docs, bench, block_chars=100).collect()} == got
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [2, 3, 4, 5, 6, 8]
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 == decontaminate.matches(docs, bench.limit(0)).count()


def test_a_copy_behind_a_sibling_is_found():
    item = "Tom has 3 red apples and gives 4 of them to his sister, then Tom buys 3 more apples while 4 birds watch and Tom eats 3 of the 4 pears"
    sibling = "Tom has 7 red apples and gives 8 of them to his sister, then Tom buys 7 more apples while 8 birds watch"
    table = decontaminate.Items([(1, item.encode())], 5)
    for text in (f"{sibling}. {item}.", f"{sibling}. {sibling}. {item}. {sibling}.", f"{item}. {sibling}."):
        assert [(x[0], x[3]) for x in table.find(text.encode(), 80)] == [(1, 1.0)]
    assert table.find((sibling + ".").encode(), 80) == []


def test_copies_in_another_case_are_found(spark, tmp_path):
    german = "Die Ärztin Änne Übel fährt um 9 Uhr mit der Straßenbahn nach Köln, wo der Bäcker Öhler 3 große Brötchen für Frau Özil bäckt und isst"
    texts = [ITEM, ITEM.upper(), ITEM.lower(), german.upper(), german.lower(), "Nothing of the kind, only plain words about the weather and the sea."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, german)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.item_id, r.kind) for r in queries.op2(spark, str(tmp_path)).collect())
    assert got == [(k, 1 if k < 3 else 2, "copy") for k in range(5)]


PEOPLE = "Anna Bob Carl Dora Émile Frank Grete Hugo Ida Jörg Kofi Lena Mia Nils Olga Paul".split()
THINGS = "apples lemons ribbons candles marbles stamps pencils kites".split()
UNIT_WORDS = "km miles kg hours minutes litres".split()


def question(rng, k, people, numbers, unit):
    """The k-th template of three with its slots; names open sentences and stand inside them."""
    a, b = people
    x, y, z = numbers
    t = THINGS[k % 8]
    return [
        f"{a} keeps {x} {t} in a blue box while {b} carries {y} {unit} of rope along the river. After lunch {a} finds {z} more {t} under the old bridge. How many {t} does {a} own now and how much rope is left for {b}?",
        f"On the way home {b} counts {x} {t} near the market and {a} counts {y} of them again. If the walk takes {z} {unit} and {a} stops twice, which of the two friends has seen more {t} at the end of the day?",
        f"{a} and {b} share {x} {t} between {y} baskets before the train leaves. Every basket weighs {z} {unit}, yet {b} insists that two more {t} fit into each. What is the largest number of {t} that {a} can pack?",
    ][k % 3]


def slots(rng):
    return rng.sample(PEOPLE, 2), [str(x) for x in rng.sample(range(2, 900), 3)], rng.choice(UNIT_WORDS)


def test_reparameterised_questions_recall_and_false_hits():
    rng = random.Random(5)
    items = [(k, question(rng, k, *slots(rng)).encode()) for k in range(24)]
    table = decontaminate.Items(items, 5, case_blind=True)
    found = wrong = 0
    for n in range(600):
        k = n % 24
        text = question(rng, k, *slots(rng))
        text = "Some other words stand before. " + (text.replace("?", " …").replace(" a blue", " a\u00a0blue") if n % 3 == 0 else text) + " And behind."
        held = {x[0] for x in table.find(text.encode(), 80)}
        same = {i for i in range(24) if i % 24 == k or (i % 3 == k % 3 and i % 8 == k % 8)}
        found += bool(held & same)
        wrong += bool(held - same)
    assert found >= 0.95 * 600 and wrong == 0
    clean = wrong = 0
    for n in range(300):  # one number for all, or one name: no re-parameterisation of different values
        people, numbers, unit = slots(rng)
        text = question(rng, n, [people[0]] * 2, [numbers[0]] * 3, unit)
        clean += not table.find(text.encode(), 80)
    assert clean >= 0.9 * 300


def brute_matches(docs, items, window=5, percent=80):
    """By regular expressions over plain ASCII texts, first places of windows only."""

    def tokens(text):
        out, before = [], None
        for m in re.finditer(r"[0-9]+|[A-Za-z]+", text):
            w = m[0]
            gap = text[before.end() : m.start()] if before else None
            number, after_number = w[0].isdigit(), before is not None and before[0][0].isdigit()
            kind = w.lower()
            if number:
                if after_number and len(gap) == 1 and gap not in " \t\n":
                    out[-1] = ("#", out[-1][1] + w)
                    before = m
                    continue
                kind = "#"
            elif after_number and len(gap) <= 1 and w.lower() in decontaminate.UNITS:
                kind = "%"
            elif w[0].isupper() and len(w) > 1 and not w[1].isupper():
                if out and out[-1][0] == "@" and gap in (" ", "\t", "\n"):
                    out[-1] = ("@", out[-1][1] + " " + w.lower())
                    before = m
                    continue
                kind = "@"
            out.append((kind, w.lower() if kind in "#%@" else None))
            before = m
        return out

    def windows(t):
        first = {}
        for k in range(len(t) - window + 1):
            first.setdefault(tuple(x[0] for x in t[k : k + window]), k)
        return first

    out = set()
    for d, text in docs:
        t = tokens(text or "")
        mine = windows(t)
        for i, item in items:
            u = tokens(item or "")
            theirs = windows(u)
            both = theirs.keys() & mine.keys()
            if not theirs or 100 * len(both) < percent * len(theirs):
                continue
            pairs = {}
            for w in sorted(both):
                for k in range(window):
                    if t[mine[w] + k][1] and u[theirs[w] + k][1]:
                        pairs.setdefault(mine[w] + k, (u[theirs[w] + k][1], t[mine[w] + k][1]))
            pairs = list(pairs.values())
            agree = min((sum(max(sum(p[1 - s] == q for p in pairs if p[s] == v) for q in {p[1 - s] for p in pairs}) for v in {p[s] for p in pairs}) for s in (0, 1)), default=0)
            if not pairs or 100 * agree >= percent * len(pairs):
                out.add((d, i))
    return out


def test_the_query_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    items = [(k, question(rng, k, *slots(rng)).replace("É", "E").replace("ö", "o")) for k in range(12)] + [(50, "short one"), (51, None), (None, "there stood exactly 14 grey stones around the well of Marta")]
    docs = []
    for k in range(90):
        filler = " ".join(rng.choice("alpha beta gamma delta rho sigma tau".split()) for _ in range(rng.randrange(30)))
        body = [question(rng, rng.randrange(24), *slots(rng)).replace("É", "E").replace("ö", "o"), items[k % 12][1], "", items[14][1], items[k % 12][1][: 40 + k]][k % 5]
        docs.append((k, f"{filler} {body}. {filler}"))
    docs += [(100, None), (101, ""), (0, docs[0][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.item_id) for r in queries.op2(spark, str(tmp_path)).collect()]
    want = brute_matches(docs, items)
    assert set(got) == want and len(want) > 40 and any(i is None for _, i in want)
    kept = decontaminate.clean(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"), case_blind=True)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


@pytest.mark.parametrize("change", [
    lambda t: t.replace('"', "\u201c").replace("-", "\u2013").replace(" ", "\u00a0", 3),
    lambda t: t.replace("Émile", "Óscar"),
    lambda t: t.replace("Nadia", "Ruth"),
    lambda t: unicodedata.normalize("NFD", t),
])
def test_marks_accents_and_names_at_the_start(change):
    item = 'Nadia reads "the long way" to Émile for 12 minutes - then Nadia walks 4 km and says "well done" to the other children'
    assert [x[0] for x in decontaminate.Items([(1, item.encode())], 5).find(change(item).encode(), 80)] == [1]


def test_one_number_for_all_is_not_consistent():
    item = "we saw 3 cars and 4 bikes near 5 houses by 6 lakes with 7 dogs in 8 towns"
    table = decontaminate.Items([(1, item.encode())], 5)
    assert table.find(re.sub("[0-9]", "9", item).encode(), 80) == []
    assert len(table.find(re.sub("[0-9]", lambda m: str(9 * int(m[0])), item).encode(), 80)) == 1


# Rollup


def test_rollup(spark):
    rollup = token_rollup.Rollup(spark, Scratch(spark, "rollup-test").base)
    assert rollup.totals().count() == 0
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    rows = spark.createDataFrame([(1, "a", "en", "v1", 5, 0), (2, "a", "en", "v1", 7, 0), (3, None, None, "v1", None, 0), (2, "a", "en", "v1", 7, 0)], schema)
    assert rollup.commit("b1", token_rollup.inserts(rows)) and not rollup.commit("b1", token_rollup.inserts(rows))
    rollup.commit("b2", token_rollup.deletes(rows.filter("doc_id = 2").limit(1)))
    rollup.commit("b3", token_rollup.revisions(spark.createDataFrame([(1, "a", "en", "v1", 9, 5)], schema)))
    rollup.commit("b4", token_rollup.deletes(rows.filter("doc_id = 3")))
    rollup.commit("b5", token_rollup.inserts(rows.limit(0)))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 2, 16)]
    assert rollup.published() == ["b1", "b2", "b3", "b4", "b5"]
    with pytest.raises(ValueError):
        rollup.commit("../x", rows)


def test_compaction_keeps_totals_and_ids(spark):
    folder = Scratch(spark, "compact").base
    rollup = token_rollup.Rollup(spark, folder)
    assert rollup.compact() and rollup.totals().count() == 0
    rows = spark.createDataFrame([("a", "en", "v1", 5), ("a", "en", "v1", 5), ("b", None, "v1", 2)], "source string, lang string, tokenizer string, n_tokens long")

    def totals():
        return sorted((r.source, r.docs, r.tokens) for r in rollup.totals().collect())

    for n in range(3):
        assert rollup.commit(f"b{n}", token_rollup.inserts(rows))
    before = totals()
    assert rollup.compact() and totals() == before == [("a", 6, 30), ("b", 3, 6)]
    assert rollup.published() == ["b0", "b1", "b2"] and rollup._names("batches") == []
    assert not rollup.commit("b1", token_rollup.inserts(rows)) and totals() == before
    # A writer that had looked before the compaction publishes an id the base holds: it counts once.
    token_rollup.inserts(rows).write.parquet(f"{folder}/batches/b2")
    assert totals() == before
    assert rollup.commit("d", token_rollup.deletes(rows.filter("source = 'b'"))) and rollup.compact()
    assert totals() == [("a", 6, 30), ("b", 2, 4)] and rollup._names("batches") == []


def test_the_rollup_query_against_brute_force(spark, tmp_path):
    rng, enc = random.Random(3), load(queries.vocabulary())
    rows = [(k, " ".join(rng.choice(["word", "Straße", "x1", "é"]) for _ in range(rng.randrange(9))), rng.choice(["a", "b", None]), rng.choice(["en", None])) for k in range(80)]
    rows += [(k, t, "c", "en") for k, t in enumerate(ODD)] + [rows[0]]
    docs = spark.createDataFrame([(*r, 9, "v") for r in rows], "doc_id long, text string, source string, lang string, n_tokens long, tokenizer string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for _, text, source, lang in rows:
        n = len(enc.tok.encode(text or "", add_special_tokens=False).ids)
        if n:
            d, t = want.get((source, lang), (0, 0))
            want[source, lang] = (d + 1, t + n)
    got = queries.op7(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in got} == want and len(got) == len(want)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op7(spark, f"{tmp_path}/none").count() == 0


def test_token_counts_against_the_library(spark):
    docs = docs_of(spark, ODD)
    enc = load(queries.vocabulary())
    for r in token_rollup.count_tokens(docs, queries.vocabulary(), "v").collect():
        assert r.n_tokens == len(enc.tok.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids)
