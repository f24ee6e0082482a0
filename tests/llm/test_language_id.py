"""Languages: held-out accuracy, spans of mixed texts, and Viterbi against all ways on small cases."""

import itertools
import zlib

import numpy as np
import pyarrow as pa

from tidemark.llm import language_id, words

DDL = "doc_id bigint, text string, lang string, lang_pred string, spans string"


def test_accuracy_on_the_fold_it_never_saw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identified(docs).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in unseen]) >= 0.98


def test_viterbi_finds_the_best_of_all_ways():
    draw = np.random.default_rng(2)
    first = np.array([0, 4, 4, 9, 10, 16])
    scores = draw.normal(0, 3, (16, 3)).astype(np.float32)
    got = language_id.viterbi(scores, first, 2.0)
    for a, b in itertools.pairwise(first.tolist()):
        if a == b:
            continue

        def worth(way):
            return sum(scores[a + k, x] for k, x in enumerate(way)) - 2.0 * sum(
                x != y for x, y in itertools.pairwise(way))  # noqa: B023

        best = max(itertools.product(range(3), repeat=b - a), key=worth)
        assert abs(worth(tuple(got[a:b])) - worth(best)) < 1e-4


EN, EL, RU = "the cat sat on that mat with this hat ", "η γάτα κάθισε στο χαλί με το καπέλο ", "кошка сидела на этом коврике "


def taught(spark):
    rows = [(k, text * 3, lang, "p", "s") for k, (text, lang) in enumerate([(EN, "en"), (EL, "el"), (RU, "ru")] * 12)]
    return spark.createDataFrame(rows, DDL)


def test_spans_and_scripts(spark):
    model = language_id.learn(taught(spark))
    assert model.langs == ["el", "en", "ru"]
    docs = spark.createDataFrame([(1, (EN + EL + RU).strip(), None, "p", "s"), (2, "ΚΑΛΗΜΕΡΑ 123", None, "p", "s")], DDL)
    got = {r.doc_id: r for r in language_id.languages(docs, model).collect()}
    assert [tuple(x) for x in got[1].spans] == [(0, 8, "en"), (9, 16, "el"), (17, 21, "ru")]
    assert got[2].lang_pred == "el" and got[2].score == 1.0


def test_scripts_of_words():
    found = next(language_id.words.chunks(pa.array(["abc Ωω жук 中 カ 12 é9 😀"])))[2]
    seen = language_id.read(found)
    names = [{language_id.NAMES[k] for k in range(len(language_id.NAMES)) if b >> k & 1} for b in seen.scripts.tolist()]
    assert names == [{"latin"}, {"greek"}, {"cyrillic"}, {"han"}, {"kana"}, set(), {"latin"}, set()]
    assert seen.letters.tolist() == [3, 2, 3, 1, 1, 0, 1, 0]
    assert words.IS_SPACE.sum() == 6


def test_odd_rows(spark):
    docs = spark.createDataFrame([
        (1, None, "en", "p", "s"), (2, "", "en", "p", "s"), (3, " \n", "en", "p", "s"), (4, "12 | 😀!", "en", "p", "s"),
        (None, EN, "en", "p", "s"), (5, EN * 4000, "en", "p", "s"), (5, EN, None, "p", "s"), (6, EN, "en", "p", "s"),
        (7, EL, "el", "p", "s"), (8, EL, "el", "p", "s"), (9, EL, "el", "p", "s"), (10, EL, "el", "p", "s")], DDL)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identified(docs).collect()]
    assert len(got) == 12
    assert {x for x in got if x[1] == "und"} == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0)}
    assert [x[1] for x in got if x[0] == 5] == ["en", "en"]
    assert {x[1] for x in got if x[0] in (7, 8, 9, 10)} == {"el"}
    assert language_id.identified(docs.limit(0)).count() == 0
    none = language_id.identified(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang"))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
