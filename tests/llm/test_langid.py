import binascii

import numpy as np

from factledger.llm import langid, queries


def path_of(scores, switch):
    """Viterbi of one text, plainly."""
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        k = int(best.argmax())
        back.append([k if best[k] - switch > best[j] else j for j in range(len(row))])
        best = np.array([max(best[j], best[k] - switch) for j in range(len(row))], np.float32) + row
    at = int(best.argmax())
    out = [at]
    for b in reversed(back):
        at = b[at]
        out.append(at)
    return out[::-1]


def test_viterbi_equals_the_plain_form():
    rng = np.random.default_rng(1)
    sizes = [0, 5, 1, 30, 0, 12]
    scores = rng.normal(0, 5, (sum(sizes), 3)).astype(np.float32)
    first = np.cumsum([0, *sizes])
    got = langid.viterbi(scores, first, 6.0)
    for a, b in zip(first, first[1:]):
        assert b == a or got[a:b].tolist() == path_of(scores[a:b], np.float32(6.0))


def test_words_and_scripts():
    words = langid.Letters(["Ab12cд", "", "ß"])
    assert [(int(a), int(b)) for a, b in zip(words.start - words.doc_start[words.doc], words.end - words.doc_start[words.doc])] == [(0, 2), (4, 5), (5, 6), (0, 1)]
    assert words.script.tolist() == [0, 0, 2, 0]


def test_mixed_text_nulls_and_scripts(spark):
    en, de, ru = "the house and the garden with water ", "der Hund und die Katze nicht schön ", "дом и сад с водой "
    rows = [(i, t * 5, lang, "x") for i, (t, lang) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(docs)
    tests = spark.createDataFrame([(1, en * 3 + de * 3), (2, None), (3, "123 ..."), (4, ""), (5, "вода"), (6, "日本")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(tests, model).collect()}
    assert [s.lang for s in got[1].lang_spans] == ["en", "de"] and abs(got[1].lang_spans[1].start - len(en) * 3) < 12
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0
    assert got[5].lang_pred == "ru" and 0 <= got[6].score <= 1
    none = langid.fit(docs.limit(0))
    assert [r.lang_pred for r in langid.identify(tests, none).collect()] == ["und"] * 6
    assert langid.identify(tests.limit(0), model).collect() == []


def test_query_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, sf_dir).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(right) >= 0.95 * len(right)


def test_more_than_127_languages():
    rng = np.random.default_rng(2)
    scores = rng.normal(0, 9, (400, 250)).astype(np.float32)
    first = np.array([0, 150, 400])
    got = langid.viterbi(scores, first, 6.0)
    assert got.max() > 200
    for a, b in zip(first, first[1:]):
        assert got[a:b].tolist() == path_of(scores[a:b], np.float32(6.0))


def test_word_scores_against_a_plain_form(spark):
    """Scores of a fitted model, summed n-gram by n-gram with dictionaries; scripts narrow the languages."""
    rows = [(i, t, g) for i, (t, g) in enumerate([("the house", "en"), ("das haus", "de"), ("дом", "ru")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    text = "the дом haus"
    words = langid.Letters([text])
    got = langid.word_scores(model, words)
    for k, word in enumerate(text.split()):
        framed = [1, *map(ord, word), 1]
        total = np.zeros(len(model.languages), np.float64)
        for order, n in enumerate(langid.ORDERS):
            for i in range(len(framed) - n + 1):
                value = 0
                for c in framed[i : i + n]:
                    value = (value * 0x01000193 ^ c * 0x9E3779B1) & 0xFFFFFFFF
                mixed = (value ^ value >> 15) * 0x85EBCA6B & 0xFFFFFFFF
                total += model.scores[(mixed >> 17) + order * langid.BUCKETS]
        script = 2 if word == "дом" else 0
        for j, name in enumerate(model.languages):
            if (name == "ru") == (script == 2):
                assert abs(got[k, j] - total[j]) < 1e-3
            else:
                assert got[k, j] == -1e4
    assert [r.lang_pred for r in langid.identify(docs, model).orderBy("doc_id").collect()] == [g for _, _, g in rows]


def test_rarer_languages_than_the_bound_are_not_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "word", g) for i, g in enumerate("aabbcb")], "doc_id long, text string, lang string")
    assert langid.fit(docs).languages == ["a", "b"]
