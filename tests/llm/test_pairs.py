import numpy as np
import pytest

from tessera.llm import pairs


@pytest.mark.parametrize(
    "text, closed",
    [
        ("A sentence.", True), ("Yes", True), ("346", True), ("src/a.py", True), ("It ends with the", False), ("Text.\n\n```python\nx = 1\n```", True), ("Text.\n\n```python\nx = 1", False),
        ("T.\n\n| a | b |\n|---|---|\n| 1 | 2 |", True), ("T.\n\n| a | b |\n|---|---|\n| 1 |", False), ("T.\n\n- `a`\n- `b`", True), ("T.\n\n- `a`\n- `b", False), ("Steps:\n1. `a`\n2.", False),
        ("Text. 👍", True), ("Text. (src/a.py)", True), ("Text.\n\nhttps://wiki.example/x", True), ("完成了。", True), ("除非调用者传入其他值，否则", False), ("First,", False), ("He said \"no.\"", True),
    ],
)
def test_ending(text, closed):
    assert bool(pairs.ending(text)[5]) == closed


def test_languages():
    for code, text in {"en": "Where is it defined and who calls it?", "de": "Wo ist es definiert und wer ruft es auf?", "es": "¿Dónde se define y quién lo llama?", "fr": "Où est-il défini et qui l'appelle ?", "zh": "它在哪里定义，由谁调用？"}.items():
        assert pairs.language(text)[0] == code
    assert pairs.language("`x = 1`")[0] is None


@pytest.fixture(scope="module")
def model(spark, sf):
    logs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/query_logs.parquet").where("generation_mode = 'service'")
    return pairs.train(logs, limit=600)


CASES = [
    ("What is the default limit used by load_x?", "The default limit of 94 applies unless the caller passes another value.", None),
    ("What is the default limit used by load_x?", "94", None),
    ("Is load_x safe to call?", "Yes.", None),
    ("What is the default limit used by load_x?", None, "empty"),
    ("What is the default limit used by load_x?", " ​ ... ", "empty"),
    ("What is the default limit used by load_x?", "<p></p>", "empty"),
    ("What is the default limit used by load_x?", "WHAT IS THE DEFAULT LIMIT USED BY LOAD_X", "copy"),
    ("What is the default limit used by load_x?", "What is the default limit used by load_x?\n\nThe default limit of 94 applies unless the caller passes another value.", None),
    ("What is the default limit used by load_x?", "The default limit of 94 applies unless the cal", "truncated"),
    ("What is the default limit used by load_x?", "I am sorry, but I cannot help with this request.", "refusal"),
    ("Wo ist load_x definiert und wer ruft es auf?", "Leider darf ich darauf nicht antworten.", "refusal"),
    ("What is the default limit used by load_x?", 'The service refuses such a request and returns the message "I cannot help with this request". The default limit of 94 applies.', None),
    ("What is the default limit used by load_x?", "Kurz gesagt hängt es von der Größe ab, und wer das eine ändert, sollte beides prüfen.", "language"),
    ("What is the default limit used by load_x? Explain it in German.", "Kurz gesagt hängt es von der Größe ab, und wer das eine ändert, sollte beides prüfen.", None),
]


def test_cases(model):
    got = model([(q, a) for q, a, _ in CASES])
    assert got == [w for *_, w in CASES]


#: Wordings that neither DECLINE nor the made refusals hold.
UNLISTED = [
    ("What is the default limit used by load_x?", ["I'm afraid that falls beyond my remit.", "My guidelines do not let me speak about that.", "It is against my policy to say anything on this.", "I understand the interest, but I won't be able to provide that.", "I have been told never to touch on such matters.", "My instructions prevent me from giving an opinion."]),
    ("Wo ist load_x definiert und wer ruft es auf?", ["Das ist mir leider untersagt.", "Meine Richtlinien verbieten mir eine Antwort.", "Dazu äußere ich mich nicht.", "Ich bin nicht befugt, das offenzulegen."]),
    ("¿Dónde se define load_x y quién lo llama?", ["Me temo que eso queda fuera de mi alcance.", "Mis normas me impiden contestar.", "Nunca opino sobre esos asuntos, lo siento."]),
    ("Où est défini load_x et qui l'appelle ?", ["Je suis désolé, mais je n'ai pas le droit d'y répondre.", "Mes consignes m'empêchent d'en parler.", "Il ne m'appartient pas de commenter cela."]),
    ("load_x 在哪里定义，由谁调用？", ["抱歉，我没有权限回答。", "这超出了我的职责范围。", "我没办法告诉你这件事。"]),
]
#: Answers that negate or are sorry, but answer.
ANSWERING = ["Yes, as long as each worker opens its own session and does not share the cursor.", "Unfortunately the name is misleading: the default limit of 94 applies unless the caller passes another value.", "Sorry for the detour; it is called by load_x right after the index refresh.", "No, it is not called anywhere.", "No.", "It does not return anything.", "Nobody calls it.", "Oui.", "Sí.", "是的。"]


def test_refusals_of_unlisted_wordings(model):
    rows = [(q, a) for q, answers in UNLISTED for a in answers]
    assert not any(pairs.DECLINE.search(a) for _, a in rows if "won't" not in a)
    got = model(rows)
    assert sum(g == "refusal" for g in got) >= 0.8 * len(rows)
    assert "refusal" not in model([("What is the default limit used by load_x?", a) for a in ANSWERING])


def test_held_out_synthetic_accuracy(spark, sf, model):
    rows = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/query_logs.parquet").where("generation_mode = 'service' and length(answer) > 60").orderBy("id").limit(250).collect()
    bad = pairs.spoiled([(r["question"], r["answer"]) for r in rows if r["question"]], np.random.default_rng(99))
    got = model([(q, a) for q, a, _ in bad])
    assert sum(g == pairs.DEFECTS[d] for g, (_, _, d) in zip(got, bad)) >= 0.96 * len(bad)


def test_table(spark, model):
    rows = [(i, q, a, "x") for i, (q, a, _) in enumerate(CASES)] * 2 + [(99, None, None, None), (100, None, "The limit is", None), (None, "Q?", "", None), (101, "Why?", "Because it is so. " * 20_000, None)]
    df = spark.createDataFrame(rows, "id long, question string, answer string, defect string")
    got = {r[0]: r[1] for r in pairs.broken_pairs(df, model).distinct().collect()}
    assert got[99] == "empty" and got[100] == "truncated" and got[None] == "empty" and 101 not in got
    assert pairs.broken_pairs(df.limit(0), model).count() == 0
    assert pairs.broken_pairs(df, pairs.train(df.limit(0))).count() == 0


def test_inputs_decide(spark, sf):
    """Without n-grams, or without pair features, refusals in other words and the rest get worse."""
    rows = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/query_logs.parquet").where("generation_mode = 'service' and length(answer) > 60").orderBy("id").limit(300).collect()
    rows = [(r["question"], r["answer"]) for r in rows if r["question"]]
    bad = pairs.spoiled(rows[:150], np.random.default_rng(5))
    want = [pairs.DEFECTS[d] for *_, d in bad]

    def right(cut: slice) -> float:
        model = pairs.Classifier(rows[150:])
        model.weights[cut] = 0
        return sum(g == w for g, w in zip(model([b[:2] for b in bad]), want)) / len(bad)

    whole = right(slice(0, 0))
    assert whole > 0.95 and right(slice(0, pairs.NUMBERS)) < whole - 0.1 and right(slice(pairs.NUMBERS, -1)) < whole


def test_few_usable_pairs(spark):
    bad = [(i, q, a) for i, (q, a, d) in enumerate(CASES) if d in ("empty", "copy", "truncated", "refusal")]
    want = {i: d for i, (_, _, d) in enumerate(CASES) if d in ("empty", "copy", "truncated", "refusal")}
    few = spark.createDataFrame(bad + [(50, CASES[0][0], CASES[0][1])], "id long, question string, answer string")
    assert {r[0]: r[1] for r in pairs.broken_pairs(few, pairs.train(few)).collect()} == want
    blank = spark.createDataFrame([(i, f"What does load_{i} do?", [None, "", " "][i % 3]) for i in range(60)], "id long, question string, answer string")
    assert {r[1] for r in pairs.broken_pairs(blank, pairs.train(blank)).collect()} == {"empty"} and pairs.broken_pairs(blank, pairs.train(blank)).count() == 60


def test_built_in_pairs_alone():
    model = pairs.Classifier(pairs.built_in())
    got = model([(q, a) for q, a, _ in CASES])
    assert [d == w for d, (_, _, w) in zip(got, CASES)].count(False) <= 2, list(zip(got, CASES))
