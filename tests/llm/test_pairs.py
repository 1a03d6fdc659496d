import json

import pytest
from docketry.llm.pairs import pair_defects

Q = "What covered the field?"


def obj(answer, quotes=(), **more):
    return json.dumps({"answer": answer, "citations": [{"chunk_id": "c", "quote": q} for q in quotes], "abstained": False, "abstention_reason": None} | more)


CASES = [
    (Q, "Patchy ground fog covered the field at Tolvik.", []), (Q, obj("Patchy ground fog"), []), (Q, obj("The passenger in the right-seat"), []), (Q, "N648QK", []), (Q, "26", []),
    (Q, None, ["empty"]), (Q, " \n", ["empty"]), (Q, "```json\n```", ["empty"]), (Q, "{}", ["empty"]), (Q, obj(None), ["empty"]), (Q, obj(" "), ["empty"]), (Q, obj("​"), ["empty"]),
    (Q, obj(None, abstained=True), []), (Q, "```json\n" + obj(None, abstained=True) + "\n```", []), (Q, obj("Fog")[:-20], ["truncated"]), (Q, '{"answer":"Fo', ["truncated"]),
    (Q, "Patchy ground fog covered the field at Tol", ["truncated"]), (Q, obj("Fuel samp", ["Fuel samples contained water."]), ["truncated"]), (Q, obj("The list because of"), ["truncated"]), (Q, "The fog was (", ["truncated"]), (Q, "The fog was…", ["truncated"]),
    (Q, "I'm sorry, but I can't help with that request.", ["refusal"]), (Q, obj("As an assistant, I am not able to provide details."), ["refusal"]), ("Was bedeckte das Feld?", "Es tut mir leid, dabei kann ich nicht helfen.", ["refusal"]),
    ("¿Qué cubría el campo?", "Lo siento, no puedo ayudar con eso.", ["refusal"]), ("Qu'est-ce qui couvrait le terrain ?", "Désolé, je ne peux pas répondre.", ["refusal"]),
    ("Who spoke?", 'The tower controller stated, "I cannot clear you for runway 25R at this time."', []), ("Who spoke?", "The captain apologized to the dispatcher and was unable to give a position near Tolvik.", []),
    (Q, "What covered the field?", ["copied_question"]), (Q, "You asked: what covered the field?", ["copied_question"]), (Q, '"' + Q + '" ' + Q, ["copied_question"]), (Q, Q + " Freezing drizzle.", []),
    (Q, "Die Behörde empfiehlt, die Unterlagen zu prüfen.", ["other_language"]), ("Was ergab die Untersuchung?", "The tail boom came to rest in the field.", ["other_language"]), (Q, "Туман закрывал всё поле.", ["other_language"]),
]


def test_worked_pairs(spark):
    rows = [(str(i), [("System", "x"), (" USER", q + '\n\n<chunk id="c">\nText.\n</chunk>'), ("Assistant ", a)], "clash") for i, (q, a, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "record_id string, messages array<struct<role:string,content:string>>, answer string")
    got = {int(r["record_id"]): r["defects"] for r in pair_defects(df).collect()}
    wrong = [(CASES[i], d) for i, d in got.items() if d[:1] != CASES[i][2]]
    assert not wrong and len(got) == len(CASES)


@pytest.mark.parametrize("messages, want", [(None, ["empty"]), ([], ["empty"]), ([("user", Q)], ["empty"]), ([None, ("user", Q), (None, "x")], ["empty"]), ([("user", None), ("assistant", "A broken ceiling covered the field.")], []), ([("assistant", "Fog. " * 60_000)], [])])
def test_missing_parts(spark, messages, want):
    df = spark.createDataFrame([("r", messages)], "record_id string, messages array<struct<role:string,content:string>>")
    assert pair_defects(df).first()["defects"] == want
    assert pair_defects(df.limit(0)).count() == 0
