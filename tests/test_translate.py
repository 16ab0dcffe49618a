"""Translation by a supplied function: calls, failures, stored answers."""

import os
import uuid

from kohorta.operators import translate as T

POSTS = [(1, "en", "stay"), (2, "fr", "un"), (3, "fr", "un"), (4, "de", "un"), (5, None, "nul"), (6, "es", None), (7, "fr", "fails"),
         (8, "fr", ""), (9, "fr", "shaky")]


def client_of(log, broken=("fails",)):
    def make():
        seen = {}

        def call(text, lang):
            os.makedirs(log, exist_ok=True)
            open(f"{log}/{lang}_{text}_{uuid.uuid4().hex}", "w").close()
            seen[text] = seen.get(text, 0) + 1
            if text in broken or (text == "shaky" and seen[text] == 1):
                raise ValueError("no answer")
            return f"[{lang}] {text}"

        return call

    return make


def calls(log):
    names = os.listdir(log) if os.path.isdir(log) else []
    return sorted(n.rsplit("_", 1)[0] for n in names)


def texts(frame):
    return {r.id: r.text for r in frame.collect()}


def test_each_text_is_asked_for_once_over_two_runs(spark, tmp_path):
    posts = spark.createDataFrame(POSTS, "id long, lang string, text string").repartition(3)
    path, first, second = f"{tmp_path}/answers", f"{tmp_path}/a", f"{tmp_path}/b"
    want = {1: "stay", 2: "[fr] un", 3: "[fr] un", 4: "[de] un", 5: "[None] nul", 6: None, 7: "fails", 8: "[fr] ", 9: "[fr] shaky"}
    assert texts(T.translate(posts, client_of(first), path)) == want
    assert calls(first) == sorted(["fr_un", "de_un", "None_nul", "fr_", "fr_fails", "fr_fails", "fr_fails", "fr_shaky", "fr_shaky"])
    failed = T.read_answers(spark, path).filter("error IS NOT NULL").collect()
    assert [(r.text, r.error, r.attempts) for r in failed] == [("fails", "ValueError: no answer", 3)]
    assert texts(T.translate(posts, client_of(second, ()), path)) == {**want, 7: "[fr] fails"}
    assert calls(second) == ["fr_fails"]
    assert texts(T.translate(posts, client_of(f"{tmp_path}/c", ()), path))[7] == "[fr] fails"
    assert calls(f"{tmp_path}/c") == []


def test_a_client_that_cannot_be_made_loses_no_post(spark, tmp_path):
    def make():
        raise ConnectionError("down")

    posts = spark.createDataFrame(POSTS, "id long, lang string, text string")
    assert texts(T.translate(posts, make, f"{tmp_path}/answers", attempts=2)) == {i: t for i, _, t in POSTS}
    assert {r.error for r in T.read_answers(spark, f"{tmp_path}/answers").collect()} == {"ConnectionError: down"}


def test_no_posts(spark, tmp_path):
    none = spark.createDataFrame([], "id long, lang string, text string")
    assert T.translate(none, client_of(f"{tmp_path}/a"), f"{tmp_path}/answers").count() == 0
