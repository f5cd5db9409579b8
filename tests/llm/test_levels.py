import pytest

from tessera.llm import levels

EASY = "The cat is big. You can see the dog. We put the box in the bag. Look at the red ball now. "
HARD = "Notwithstanding the asymptotic characteristics of heterogeneous configurations, any comprehensive characterisation presupposes methodological reconsideration. The interdependence of representational granularity circumscribes computational tractability. "


def test_isotonic():
    import numpy as np

    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 3, 2, 4, 4])
    ends, values = levels.pool_adjacent(x, y)
    assert values.tolist() == [1.0, 2.5, 4.0] and ends.tolist() == [1.0, 3.0, 5.0]


def test_held_out_accuracy(spark, sf):
    rows = [(r["text"], int(r["reading_level"])) for r in spark.read.parquet(f"{sf}/graded_samples.parquet").orderBy("sample_id").collect()]
    right = 0
    for fold in range(4):
        ranker = levels.Ranker([r for i, r in enumerate(rows) if i // 4 % 4 != fold])
        right += sum(ranker.level(t) == g for i, (t, g) in enumerate(rows) if i // 4 % 4 == fold)
    assert right >= 0.9 * len(rows)


def test_asides_do_not_count():
    noisy = "# Notwithstanding\n\n- asymptotic characterisation\n\n```\nheterogeneous.representational()\n```\n\n" + EASY
    assert levels.sentences(noisy) == levels.sentences(EASY)
    assert levels.sentences("- only\n- a list here") == [["only"], ["a", "list", "here"]]


def test_edges(spark):
    samples = spark.createDataFrame([(EASY + "Go on. ", 1), (EASY, 1), (HARD, 4), (HARD + HARD, 4), (None, 2), ("x", None)] * 2, "text string, reading_level long")
    ranker = levels.train(samples)
    docs = [(1, EASY), (2, HARD), (3, None), (4, "  \n"), (5, "zzz qqq"), (1, EASY), (None, HARD), (6, HARD * 400), (7, HARD + EASY)]
    got = levels.reading_levels(spark.createDataFrame([(k, t, 9) for k, t in docs], "doc_id long, text string, reading_level int"), ranker).distinct().collect()
    by = {r[0]: r[1] for r in got}
    assert by[1] == 1 and by[2] == 4 and by[None] == 4 and by[6] == 4 and by[5] == 1 and not {3, 4} & set(by)
    assert levels.reading_levels(spark.createDataFrame([], "doc_id long, text string"), ranker).count() == 0


def test_without_usable_samples(spark):
    docs = spark.createDataFrame([(1, EASY), (2, HARD)], "doc_id long, text string")
    for rows in ([], [(None, 1), ("x y", None), (" ", 2), ("...", 3)]):
        ranker = levels.train(spark.createDataFrame(rows, "text string, reading_level long"))
        assert levels.reading_levels(docs, ranker).count() == 0
    one = levels.train(spark.createDataFrame([(EASY, 2), (HARD, 2)], "text string, reading_level long"))
    assert {r[1] for r in levels.reading_levels(docs, one).collect()} == {2}
