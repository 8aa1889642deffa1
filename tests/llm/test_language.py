import itertools
import random

import numpy as np

from driftline.llm import language
from driftline.llm.language import LanguageModel, best_paths, fit_languages, identify

DOCS = "doc_id long, text string, lang string, score string"


def best_path_by_enumeration(emissions, switch):
    def value(path):
        return (sum(emissions[t][s] for t, s in enumerate(path))
                - switch * sum(a != b for a, b in itertools.pairwise(path)))
    return max(value(p) for p in itertools.product(range(emissions.shape[1]),
                                                   repeat=len(emissions))), value


def test_paths_are_optimal():
    rng = np.random.default_rng(2)
    lengths = np.array([6, 5, 5, 2, 1])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for _ in range(40):
        emissions = rng.normal(size=(lengths.sum(), 3)) * 2
        path = best_paths(emissions, starts, lengths, 1.5)
        for a, n in zip(starts, lengths):
            best, value = best_path_by_enumeration(emissions[a:a + n], 1.5)
            assert np.isclose(value(path[a:a + n]), best)


def test_word_scores_equal_a_plain_sum():
    rng = np.random.default_rng(4)
    model = LanguageModel(["a", "b"], rng.normal(size=(64, 2)), np.ones((
        len(language.SCRIPTS), 2), bool), 3.0)
    words = ["x", "abc", "ñandú", "строка", "\U00020000\U00020001", "abcabcabc"]
    for word, row in zip(words, language.word_scores(words, model)):
        alone = language.word_scores([word], model)[0]
        slots = [s for _, slot in language.ngram_slots(language.letters_of([word]), 64)
                 for s in slot]
        assert np.allclose(row, alone, atol=1e-4)
        assert np.allclose(alone, sum(model.scores[s] for s in slots), atol=1e-3)
        assert len(slots) == sum(max(len(word) + (0 if k == 1 else 2) - k + 1, 0)
                                 for k in language.ORDERS)


def corpus(seed, n):
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "er", "and", "wh"], "es": ["que", "ción", "os", "la", "ñ"],
             "ru": ["что", "ова", "ние", "ст"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    return [(i, " ".join(word(lang) for _ in range(rng.randint(5, 60))), lang, None)
            for i in range(n) for lang in [rng.choice(list(parts))]]


def test_held_out_accuracy_spans_and_edge_cases(spark):
    rows = corpus(1, 400)
    docs = spark.createDataFrame(rows, DOCS)
    model = fit_languages(docs)
    assert model.languages == ["en", "es", "ru"]
    found = identify(docs, model).toPandas().set_index("doc_id")
    truth = {r[0]: r[2] for r in rows}
    held = found[found.held_out]
    assert len(held) > 40
    assert all(held.lang_pred == held.index.map(truth))
    english, russian = rows[0], next(r for r in rows if r[2] == "ru")
    spanish = next(r for r in rows if r[2] == "es" and len(r[1].split()) > 20)
    mixed = f"{spanish[1]} что. что стст {russian[1]}"
    odd = [(1, None, None, "x"), (2, "", "en", "x"), (3, "12 -- 3.4 ½ ²", "en", "x"),
           (4, english[1] + " " + "the " * 100_000, "en", "x"), (5, mixed, None, "x"),
           (5, mixed, None, "x"), (None, spanish[1], None, None)]
    got = identify(spark.createDataFrame(odd, DOCS), model).toPandas()
    assert got.lang_pred.tolist()[:3] == ["und"] * 3 and got.score.tolist()[:3] == [0.0] * 3
    assert got.lang_pred[3] == "en" and got.lang_pred[6] == "es"
    spans = [(s["lang"], s["words"]) for s in got.spans[4]]
    assert spans == [("es", len(spanish[1].split())), ("ru", 3 + len(russian[1].split()))]
    assert list(got.spans[4]) == list(got.spans[5])
    assert 0 <= got.score.min() and got.score.max() <= 1
    assert identify(docs.limit(0), model).count() == 0


def test_sampled_fit_and_nothing_to_learn(spark):
    docs = spark.createDataFrame(corpus(3, 600), DOCS)
    few = fit_languages(docs, train_rows=100)
    found = identify(docs, few).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() > 590
    nothing = fit_languages(docs.where("lang = 'none'"))
    assert [r.lang_pred for r in identify(docs.limit(2), nothing).collect()] == ["und"] * 2


def test_sample_limit_keeps_rows_at_any_size():
    for total in (10 ** 5, 10 ** 9, 10 ** 10, 10_485_760_001, 5 * 10 ** 10, 10 ** 13, 10 ** 18):
        limit = language.sample_limit(10_000, total)
        assert 0 < limit <= 1 << 62
        assert abs(limit / 2 ** 62 * total - 10_000) < 20 or limit == 1


def test_every_language_has_a_row_in_the_sample(spark):
    rows = [(i, "the plain words of a text " * 3, "en") for i in range(3000)] + [
        (90_001 + i, "какие-то слова здесь", "ru") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(docs, train_rows=5)
    assert list(model.languages) == ["en", "ru"]
