import numpy as np
import pytest
from pyspark.sql import functions as F

from custos.llm import langid
from custos.llm.queries import QUERIES
from tests.llm.conftest import SF001, SF01

SAMPLES = {"en": "the quick brown fox jumps over the lazy dog while the children watch them from the window",
           "de": "der schnelle braune Fuchs springt über den faulen Hund und die Kinder schauen zu dabei",
           "ru": "быстрая коричневая лиса прыгает через ленивую собаку пока дети смотрят из окна",
           "zh": "敏捷的棕色狐狸跳过懒狗 孩子们从窗户看着"}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i * 10 + j, t, lang) for i, (lang, t) in enumerate(SAMPLES.items()) for j in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return langid.learn(docs, docs["text"], docs["lang"], docs["doc_id"])


def labels(model, *texts):
    return langid.Labeller(model).label([t.encode() if t is not None else None for t in texts])


def test_scripts_narrow_the_candidates(model):
    assert model.languages == ("de", "en", "ru", "zh")
    scores, letters = model.word_scores(["собака".encode(), b"dog", b"123", "狗".encode(), "קפה".encode()])
    ru = model.languages.index("ru")
    assert scores[0, ru] == 0 and (np.delete(scores[0], ru) == -langid.WORD_RANGE).all()
    assert scores[1, ru] == -langid.WORD_RANGE and scores[1].max() == 0
    assert letters.tolist() == [6, 3, 0, 1, 3] and (scores[2] == 0).all() and (scores[4] == 0).all()


def test_spans_of_a_mixed_text(model):
    (lang, score, spans), = labels(model, f"{SAMPLES['en']}. {SAMPLES['ru']} {SAMPLES['ru']}")
    assert lang == "ru" and 0.5 < score < 1
    assert [s[2] for s in spans] == ["en", "ru"] and spans[0][0] == 0 and spans[0][1] + 1 == spans[1][0]


def test_texts_without_letters(model):
    assert labels(model, None, "", "12 34 ... !", " \n") == [("und", 0.0, [])] * 4
    assert labels(model, "Ж")[0][0] == "ru"


def test_letters_of_unlearned_scripts_count_for_no_language(model):
    foreign = "שועל חום מהיר קופץ מעל הכלב העצלן"
    (_, score, spans), = labels(model, foreign)
    assert score == 0 and len(spans) == 1
    (lang, score, _), = labels(model, f"the quick brown fox {foreign} {foreign} {foreign}")
    assert lang == "en" and 0 < score < 0.25
    (_, score, _), = labels(model, "dog" + "שועלחוםמהיר")
    assert score == pytest.approx(3 / 14)


def test_runs_without_blanks_can_be_spans(model):
    run = "敏捷的棕色狐狸，跳过懒狗。孩子们从窗户看着" * 25
    (lang, score, spans), = labels(model, f"the quick fox {run} over the dog")
    assert lang == "zh" and score > 0.9 and [s[2] for s in spans] == ["en", "zh", "en"]


def test_words_end_at_marks_and_where_a_script_without_blanks_begins():
    cut = lambda t: [w.decode() for w in langid.letter_words(t.encode())]
    assert cut("abc中文字符号def") == ["abc", "中文字符", "号", "def"]
    assert cut("日本語のテスト、です。") == ["日本語", "のテスト", "です"]
    assert cut("«Größe» – ‘été’ naïve") == ["größe", "été", "naïve"]
    assert cut("ภาษาไทย") == ["ภาษา", "ไทย"] and cut("собака 𠀀𠀁") == ["собака", "𠀀𠀁"]


def best_path(scores, penalty):
    value, back = scores[0].astype(float), []
    for row in scores[1:]:
        step = value[None, :] - penalty * (1 - np.eye(len(value)))
        back.append(step.argmax(1))
        value = step.max(1) + row
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], value.max()


def path_value(scores, path, penalty):
    return sum(scores[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    texts = [-rng.random((int(n), 3)).astype(np.float32) * 6 for n in rng.integers(1, 60, 40)]
    for scores, path in zip(texts, langid.viterbi(texts, 4.0)):
        assert path_value(scores, path, 4.0) == pytest.approx(best_path(scores, 4.0)[1], abs=1e-3)


def test_one_span_texts_are_proved(model):
    """Where the search is skipped, the one-language path is the best one."""
    rng = np.random.default_rng(9)
    words = " ".join(SAMPLES.values()).split()
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(200)] + list(SAMPLES.values())
    labeller = langid.Labeller(model)
    searched = 0
    for text, (_, _, spans) in zip(texts, labeller.label([t.encode() for t in texts])):
        own = langid.letter_words(text.encode())
        scores, _ = model.word_scores(own)
        path = [model.languages.index(lang) for first, last, lang in spans for _ in range(first, last + 1)]
        assert len(path) == len(own)
        searched += len(spans) > 1
        assert path_value(scores, path, labeller.penalty) == pytest.approx(best_path(scores, labeller.penalty)[1], abs=1e-2)
    assert 0 < searched < len(texts)


def test_held_out_accuracy(spark):
    rows = QUERIES["op1_language_spans"](spark, SF01).join(
        spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held >= 0.97
    assert rows.filter("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_labels_of_held_out_documents_are_not_used(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "zz").otherwise(F.col("lang")))
    train = other.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    assert "zz" not in langid.learn(train, train["text"], train["lang"], train["doc_id"]).languages


def test_odd_rows(spark, odd, none, model):
    rows = odd.select("doc_id", "text", langid.identify(odd["text"], model, spark).alias("f")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["f"]["lang"], r["f"]["score"], r["f"]["spans"]) == ("und", 0.0, [])
        else:
            assert r["f"]["lang"] in model.languages and 0 < r["f"]["score"] <= 1
    assert none.select(langid.identify(none["text"], model, spark)).count() == 0
    empty = langid.learn(none, none["text"], none["lang"], none["doc_id"])
    assert empty.languages == () and labels(empty, "abc") == [("und", 0.0, [])]
    assert langid.learn(odd, odd["text"], odd["lang"], odd["doc_id"]).languages == ("en", "fr")
