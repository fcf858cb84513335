"""Toxicity, BPE, secrets, language."""

import base64
import hashlib
import json
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobharbor.llm import bpe, common, language, secrets, toxicity
from tests.llm.frames import DOCUMENTS, awkward_texts, documents, prose, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")


# --- toxicity ---


def toxic_corpus():
    texts, toxic = [], []
    for k in range(240):
        sentences = [prose(1000 * k + j, 8).rstrip(".") for j in range(6)]
        if k % 4 == 0:
            sentences[k % 6] = f"you {('grumbel', 'snarkit', 'vexorum', 'vexorar')[k // 4 % 4]} " + sentences[k % 6]
        texts.append(". ".join(sentences))
        toxic.append(int(k % 4 == 0))
    return texts, toxic


@pytest.fixture(scope="module")
def toxic_model(spark):
    texts, toxic = toxic_corpus()
    rows = documents(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    return toxicity.fit(rows, labels.where("doc_id % 3 != 1"))


def test_toxic_documents_and_sentences(spark, toxic_model):
    texts, toxic = toxic_corpus()
    rows = documents(spark, texts)
    for r in toxicity.score_toxicity(rows, toxic_model, drop_text=False).where("doc_id % 3 = 1").collect():
        assert (r["score"] >= toxicity.REJECT) == bool(toxic[r["doc_id"]])
        if toxic[r["doc_id"]]:
            (found,) = [r["text"][s["start"] : s["end"]] for s in r["offending"]]
            assert re.search("grumbel|snarkit|vexor", found)
            # noisy-or over the sentences
    clean = toxicity.keep_clean(rows, toxic_model)
    assert clean.schema == rows.schema
    assert {r["doc_id"] for r in clean.collect()} == {i for i, y in enumerate(toxic) if not y}


def test_score_is_the_noisy_or_of_sentences(spark):
    model = toxicity.Model(-3.0, {"bad": 4.0, "^wors": 2.0})
    rows = documents(spark, ["A bad day. Worse things! Fine.", "Fine.", "", None])
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(rows, model).collect()}
    p = lambda z: 1 / (1 + np.exp(-z))
    assert got[0] == pytest.approx(1 - (1 - p(1)) * (1 - p(-1)) * (1 - p(-3)))
    assert got[1] == got[2] == got[3] == pytest.approx(p(-3))


def test_toxicity_on_awkward_rows(spark, toxic_model):
    rows = with_clashes(documents(spark, awkward_texts()), "score", "offending")
    got = toxicity.score_toxicity(rows, toxic_model)
    assert got.count() == rows.count() and got.where("score_ between 0 and 1").count() == rows.count()
    assert toxicity.score_toxicity(spark.createDataFrame([], DOCUMENTS), toxic_model).count() == 0
    assert toxicity.keep_clean(rows, toxic_model).columns == rows.columns


@pytest.mark.parametrize("labels", [[], [(0, 1), (1, None)], [(0, 0), (None, 1), (0, 0)], [(0, 7)]])
def test_labels_of_one_kind_or_none(spark, labels):
    rows = documents(spark, ["a b", "c d"])
    model = toxicity.fit(rows, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    scores = [r["score"] for r in toxicity.score_toxicity(rows, model).collect()]
    assert all(0 <= s <= 1 for s in scores)


# --- BPE ---


def strange_texts():
    r = random.Random(4)
    kinds = ["abenstrioe", "abc XYZ éßñ '’ 0123 \n\t́Σς!?", "".join(chr(c) for c in range(0x20, 0x250)), "".join(chr(c) for c in range(0x300, 0x3100, 7) if c < 0x370 or not unicodedata.combining(chr(c)))]
    made = ["".join(r.choice(k) for _ in range(r.randrange(50))) for k in kinds for _ in range(250)]
    return made + ["<|endoftext|>x<|startoftext|>", "a<|endoftext|>́", "a\x1cb  c\x85d e\xa0f", "can't 're''s it's'", "ΑΣ İ Å Ω", "q" * 20_000, "ab" * 20_000]


def test_encoding_and_decoding_equal_the_library():
    library, own = Tokenizer.from_file(PATH), bpe.load(PATH)
    for text in strange_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids, text[:50]
        assert own.decode(np.array(ids, dtype=np.uint32)).decode() == library.decode(ids, skip_special_tokens=False)


def test_free_memory_is_given_back():
    """What a task leaves free below something that is still in use goes back to the system."""

    def held():
        return int(re.findall(r"\nRssAnon:\s+(\d+)", open("/proc/self/status").read())[0]) / 1024

    many = [bytes(1000) for _ in range(200_000)]
    last = many[-1]
    del many
    before = held()
    common.give_back()
    assert held() < before - 100 and len(last) == 1000


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    own, library = bpe.WordBpe(PATH), Tokenizer.from_file(PATH)
    for text in strange_texts()[:200]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_on_awkward_rows(spark):
    library = Tokenizer.from_file(PATH)
    rows = with_clashes(documents(spark, awkward_texts()), "ids")
    encoded = bpe.bpe_encode(rows, PATH)
    assert encoded.columns == ["doc_id", "lang", "source", "n_chars", "ids", "ids_"]
    for r in bpe.bpe_decode(encoded, PATH, "ids_", "text").collect():
        ids = library.encode(awkward_texts()[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids_"]) == ids and r["text"] == library.decode(ids, skip_special_tokens=False) and r["ids"] == "mine"
    assert bpe.bpe_encode(spark.createDataFrame([], DOCUMENTS), PATH).count() == 0


# --- secrets ---

CASES = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in CASES.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(secrets.BASE[k], a, b) for a, k, b in sorted(found)]


def test_base_spans_equal_a_plain_scan():
    r = random.Random(2)
    parts = ["password", "Secret", "token", "api_key", "APIKEY", "passwd", "AKIA", "=", ":", " ", '"', "'", "abcdef12", "0123456789abcdef" * 2, "é", "İ",
             "ſecret", "K", "ABCDEFGHIJKL", "0", "f", "z", "\n", "secret=token: abcdefgh"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert [s for s in secrets.find_secrets(text) if s[0] in secrets.BASE] == base_spans(text), text


def signed(body, prefix):
    value, check = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        check = secrets.BASE62[digit] + check
    return prefix + body + check


def test_checksums_decide():
    good = signed("Ab" * 15, "ghp_")
    bad = good[:-1] + ("a" if good[-1] != "a" else "b")
    kinds = lambda text: [s[0] for s in secrets.find_secrets(text) if s[0] not in secrets.BASE]
    assert kinds(f"x {good} y") == ["host_token"] and kinds(f"x {bad} y") == []
    assert kinds(signed("Zz9" * 10, "npm_")) == ["package_token"]
    assert kinds("Card: 4111 1111 1111 1111.") == ["card"] and kinds("Card: 4111 1111 1111 1112.") == []
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    assert kinds(f"{part({'alg': 'none', 'a': 1})}.{part({'a': 2})}.abc") == ["signed_token"]
    assert kinds(f"{part({'typ': 'x', 'aa': 1})}.{part({'a': 2})}.abc") == []
    raw = bytes([0x30, 0x82, 0x01, 0x00]) + bytes(256)
    key = lambda b: f"-----BEGIN RSA PRIVATE KEY-----\n{base64.b64encode(b).decode()}\n-----END RSA PRIVATE KEY-----"
    assert kinds(key(raw)) == ["private_key"] and kinds(key(raw[:-1])) == []


def test_secrets_on_awkward_rows(spark):
    texts = [*awkward_texts(), "my password=abcdefgh1 and token: zyxwvuts9", "0123456789abcdef" * 4000]
    rows = with_clashes(documents(spark, texts), "secrets")
    got = secrets.scan_secrets(rows)
    assert got.columns == [*rows.columns, "secrets_"]
    for r in got.collect():
        assert [tuple(s) for s in r["secrets_"]] == [s for s in secrets.find_secrets(r["text"] or "")]
    hidden = secrets.redact(rows)
    assert hidden.schema == rows.schema
    shown = {r["doc_id"]: r["text"] for r in hidden.collect()}
    assert shown[len(texts) - 2] == "my [SECRET] and [SECRET]" and shown[len(texts) - 1] == "[SECRET]"
    assert all(shown[i] == t for i, t in enumerate(awkward_texts()) if not secrets.find_secrets(t or ""))
    assert secrets.redact(spark.createDataFrame([], DOCUMENTS)).count() == 0


# --- language ---


def languages():
    r = random.Random(6)
    stems = {"aa": "ka lo mi ta", "bb": "schö ung ein ver", "cc": "tion eau ment oi", "dd": "ción que ez ado"}
    rows = []
    for k in range(400):
        lang = list(stems)[k % 4]
        parts = stems[lang].split()
        rows.append((k, " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 40))), lang))
    return rows


def test_held_out_languages(spark):
    rows = spark.createDataFrame(languages(), "doc_id bigint, text string, lang string")
    test = toxicity.held_out("doc_id", 4, 2)
    model = language.fit(rows.where(~test))
    got = language.predict_language(rows.where(test), model)
    assert got.where("lang_pred = lang and score between 0 and 1").count() == got.count() > 50


def test_filters_hold_every_gram_and_mistakes_are_counted(spark):
    words = [prose(k, 30) for k in range(60)]
    kept = [(f"l{k:02}", g) for k, text in enumerate(words) for w in text.split() for g in language.grams(w)]
    languages = sorted({lang for lang, _ in kept})
    own = spark.createDataFrame(sorted(set(kept)), "lang string, gram string")
    model = language._model(languages, 1 << 14, language._bits(own, languages, 1 << 14))
    table = language._Grams(model.table, len(model.languages))
    for lang, gram in kept:
        lane = language.LANE * (model.languages.index(lang) + 1)
        assert table[gram] >> lane & 1
    strangers = [f"Q{i}Z" for i in range(20_000)]
    rate = sum(table[g] >> language.LANE & 1 for g in strangers) / len(strangers)
    assert rate == pytest.approx(model.mistakes[0], abs=0.01)


def test_more_than_64_languages(spark):
    r = random.Random(1)
    rows = [(k, " ".join(chr(0x4E00 + 20 * (k % 80) + r.randrange(20)) * 3 for _ in range(30)), f"l{k % 80:02}") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.predict_language(frame, language.fit(frame))
    assert got.where("lang_pred = lang").count() == 400


def test_runs_of_letters_are_found_fast():
    """The same runs as with every number in the class, in a fraction of its time."""
    every = "".join(chr(c) for c in range(0x110000))
    between = "".join(f"a{chr(c)}b" for c in range(0x110000))
    for text in (every, between, "", "x1y²z½ Ⅳb a_c 十二", "plain words only"):
        assert language.letter_runs(text) == language.LETTERS.findall(text)
    prose = "wie schön das Wetter où ça été " * 3000
    seconds = {}
    for find in (language.letter_runs, language.LETTERS.findall):
        tries = []
        for _ in range(3):
            began = time.perf_counter()
            find(prose)
            tries.append(time.perf_counter() - began)
        seconds[find] = min(tries)
    assert seconds[language.letter_runs] * 3 < seconds[language.LETTERS.findall]


def test_ngrams_of_many_words_are_made_at_once(monkeypatch):
    """The same n-grams and sums as word by word, in a fraction of the time."""
    every = "".join(f"a{chr(c)}b{chr(c)} " for c in range(0x20000) if not 0xD800 <= c < 0xE000)
    texts = ["", "1 2", "x1y²z½ Ⅳb a_c 十二", "plain words, only plain words", "İstanbul ĞÜŞ É" + "é" * 100, *(every[i : i + 50_000] for i in range(0, len(every), 50_000))]
    r = random.Random(3)
    texts += [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyzäöüß", k=r.randrange(1, 16))) for _ in range(20_000)) for _ in range(3)]

    def plain(text):
        return sum((table[g] for w in language.LETTERS.findall(text.lower()) for g in language.grams(w)), 0)

    wide = "".join(chr(c) for c in range(0x10000, 0x31350) if chr(c).isalpha()) + " b"
    table = language._Grams(np.random.default_rng(5).integers(0, 8, (1 << 12, 1), dtype=np.uint64) | np.uint64(4), 3)
    for at_once, remembered in ((1 << 18, 200_000), (1000, 300)):
        monkeypatch.setattr(language, "AT_ONCE", at_once)
        monkeypatch.setattr(language, "REMEMBERED", remembered)
        words = language._Words(np.array([[m] for m in (0,)], dtype=np.uint64), 3)
        words.grams = table
        for text in [*texts[:8], texts[-1], wide]:
            found = language.pieces(text)
            words.learn(set(found))
            assert sum(map(words.__getitem__, found)) == plain(text)
            assert len(words) <= max(remembered, len(set(found)))
        words.learn(set())
        assert all(len(piece) <= language.SHORT for piece in words)
    monkeypatch.undo()
    runs = language.LETTERS.findall(texts[-1])
    counts = Counter(g for w in runs for g in language.grams(w))
    different, which, owner = language.all_grams(runs)
    assert dict(zip(different, np.bincount(which).tolist(), strict=True)) == counts
    assert np.bincount(owner).tolist() == [len(language.grams(w)) for w in runs]

    def seconds(run):
        tries = []
        for _ in range(3):
            began = time.process_time()
            run()
            tries.append(time.process_time() - began)
        return min(tries)

    for text in texts[-3:]:
        plain(text)
    fresh = language._Words(np.zeros((1, 1), dtype=np.uint64), 3)
    fresh.grams = table

    def quick():
        fresh.clear()
        found = language.pieces(texts[-1])
        fresh.learn(set(found))
        sum(map(fresh.__getitem__, found))

    assert seconds(quick) * 1.25 < seconds(lambda: plain(texts[-1]))


def test_language_on_awkward_rows(spark):
    rows = with_clashes(documents(spark, awkward_texts()), "lang_pred", "score")
    model = language.fit(rows.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise(F.lit(None))))
    got = language.predict_language(rows.withColumn("text", F.col("text")), model).collect()
    by = {r["doc_id"]: (r["lang_pred_"], r["score_"]) for r in got}
    assert all((by[i][0] == "und") == (not re.search(r"[^\W\d_]", t or "")) for i, t in enumerate(awkward_texts()))
    nothing = language.fit(spark.createDataFrame([], DOCUMENTS))
    assert language.predict_language(documents(spark, ["abc"]), nothing).first()["lang_pred"] == "und"
    assert language.predict_language(spark.createDataFrame([], DOCUMENTS), model).count() == 0


def test_letters_are_the_letters_of_unicode():
    import sys
    import unicodedata

    for c in map(chr, range(sys.maxunicode + 1)):
        # what has a category of letters, and nothing else, is found
        assert bool(language.LETTERS.fullmatch(c)) == unicodedata.category(c).startswith("L"), hex(ord(c))


def test_language_against_plain_counts(spark):
    """The filters' answer is that of the n-grams themselves where these are few enough for hardly any mistake."""
    texts = [(k, t, lang) for lang, seeds in (("aa", range(5)), ("bb", range(100, 105))) for k, t in ((s, prose(s, 120)) for s in seeds)]
    texts = [(k, t.replace("a", "o") if lang == "aa" else t.replace("o", "a"), lang) for k, t, lang in texts]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    counts = {lang: Counter(g for _, t, own in texts if own == lang for w in language.LETTERS.findall(t.lower()) for g in language.grams(w)) for lang in ("aa", "bb")}
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    held = {
        lang: {g for g, n in c.items() if n >= language.LEAST and rate[lang][g] / sum(r.get(g, 0) for r in rate.values()) >= language.PART / 2} for lang, c in counts.items()
    }
    asked = [(k, prose(k, 60).replace(*("ao" if k % 2 else "oa")), "") for k in range(200, 220)]
    got = {r["doc_id"]: r for r in language.predict_language(spark.createDataFrame(asked, "doc_id bigint, text string, lang string"), language.fit(frame)).collect()}
    for k, text, _ in asked:
        found = [g for w in language.LETTERS.findall(text.lower()) for g in language.grams(w)]
        shares = {lang: sum(g in held[lang] for g in found) / len(found) for lang in ("aa", "bb")}
        best = min(shares, key=lambda lang: (-shares[lang], lang))
        assert got[k]["lang_pred"] == best and got[k]["score"] == pytest.approx(shares[best], abs=0.02)


@pytest.mark.parametrize("unit", ["eyJ", "eyJa.", "AKIA", "token=", "password ", "-----BEGIN ", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "card ", "deadbeef", "QUJD"])
def test_work_is_in_proportion_to_the_text(unit):
    import time

    start = time.perf_counter()
    secrets.find_secrets(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - start < 20
