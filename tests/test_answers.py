"""Kept answers: nothing is asked twice, through failed jobs and tasks; odd rows; model steps whose answers do not parse."""

import json
import os
import uuid

import pandas as pd
import pytest

from faultline.operators import answers


class Counting:
    """A model that writes down what it answered; it fails at prompts with `fails_at`, as long as that file is there."""

    def __init__(self, folder, fails_at=None):
        self.folder, self.fails_at = str(folder), fails_at
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, prompts):
        if self.fails_at and any(self.fails_at in p for p in prompts) and os.path.exists(f"{self.folder}/down"):
            raise RuntimeError("the model is down")
        with open(f"{self.folder}/{uuid.uuid4().hex}.json", "w") as f:
            json.dump(prompts, f)
        return [p.upper() for p in prompts]

    def asked(self):
        return sorted(p for n in os.listdir(self.folder) if n.endswith(".json") for p in json.load(open(f"{self.folder}/{n}")))


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_equal_texts_are_asked_once_and_kept(spark, tmp_path):
    model, kept = Counting(tmp_path / "asked"), str(tmp_path / "kept")
    texts = ["a", "b", "a", None, "", "a"] * 40
    got = answers.answered(rows_of(spark, texts), model, kept, batch=2)
    assert {(r.id, r.answer) for r in got.collect()} == {(i, None if t is None else t.upper()) for i, t in enumerate(texts)}
    assert model.asked() == ["", "a", "b"]
    # A second run with one more text asks for that alone; the rows of both are right.
    more = answers.answered(rows_of(spark, [*texts, "c"]), model, kept)
    assert more.count() == 241 and more.where("text = 'c'").first().answer == "C"
    assert model.asked() == ["", "a", "b", "c"]
    assert answers.answered(rows_of(spark, ["a"]), model, kept, version="2").count() == 1
    assert model.asked() == ["", "a", "a", "b", "c"]
    assert sorted(os.listdir(kept)) == ["answers", "pending"] and os.listdir(f"{kept}/pending") == []


def test_a_failed_job_keeps_what_was_answered(spark, tmp_path):
    model, kept = Counting(tmp_path / "asked", "text 77"), str(tmp_path / "kept")
    (tmp_path / "asked" / "down").touch()
    texts = [f"text {n}" for n in range(200)]
    with pytest.raises(Exception, match="the model is down"):
        answers.answered(rows_of(spark, texts), model, kept, batch=3, tasks=4)
    before = model.asked()
    assert 0 < len(before) < 200
    os.remove(tmp_path / "asked" / "down")
    # Other rows stand beside the old ones, so that batches are made up anew; still none is asked twice.
    texts += [f"new {n}" for n in range(20)]
    got = answers.answered(rows_of(spark, texts), model, kept, batch=5)
    assert {r.text: r.answer for r in got.collect()} == {t: t.upper() for t in texts}
    assert model.asked() == sorted(texts)


def test_a_task_run_again_asks_only_what_is_open(tmp_path):
    model, calls = Counting(tmp_path / "asked"), str(tmp_path / "calls")
    frames = [pd.DataFrame({"key": [f"{n:02}" for n in part], "prompt": [f"p{n}" for n in part]}) for part in (range(0, 7), range(7, 10))]
    first = answers._asking(model, calls, 4)(iter(frames))
    assert next(first)["asked"][0] == 4  # the task is lost here
    assert [f["asked"][0] for f in answers._asking(model, calls, 4)(iter(frames))] == [4, 4, 2]
    assert model.asked() == sorted(f"p{n}" for n in range(10))


def test_a_log_taken_in_twice_adds_nothing(spark, tmp_path):
    kept = str(tmp_path / "kept")
    line = json.dumps({"key": "k", "answer": "ä\n"}) + "\n"
    for _ in range(2):  # as if the run had ended between the two steps of taking it in
        os.makedirs(f"{kept}/calls")
        for name in ("one.json", "two.json"):
            with open(f"{kept}/calls/{name}", "w") as f:
                f.write(line)
        with open(f"{kept}/calls/_draft", "w") as f:
            f.write('{"key": "half')
        answers.take_in(spark, kept)
    assert [tuple(r) for r in answers.kept_answers(spark, kept).collect()] == [("k", "ä\n")]


def test_wrong_number_and_empty_tables(spark, tmp_path):
    with pytest.raises(Exception, match="1 answers to 2 prompts"):
        answers.answered(rows_of(spark, ["a", "b"]), lambda p: p[:1], str(tmp_path / "x"), tasks=1)
    none = answers.answered(rows_of(spark, []), Counting(tmp_path / "asked"), str(tmp_path / "y"))
    assert none.columns == ["id", "text", "answer"] and none.count() == 0
    # A column of the answer's name gives way; a null answer is kept.
    clash = spark.createDataFrame([("a", 1)], "text string, answer int")
    assert [tuple(r) for r in answers.answered(clash, lambda p: [None] * len(p), str(tmp_path / "z")).collect()] == [("a", None)]


def test_cases_whose_answers_do_not_parse(spark, tmp_path):
    sections = spark.createDataFrame([(1, "D2", "It stops. It smells."), (1, "D4", "Dust."), (2, "D2", "Nothing."), (3, "D3", None)], "file long, source_section string, text string")

    def pick(prompts):
        return ["no JSON" if "Nothing" in p else json.dumps({"sentences": [p.split("\n")[1], " "]}) for p in prompts]

    def make(prompts):
        return ['{"failure_mode": "stops", "root_causes": [{"failure_cause": " ", "discipline_type": "?"}, {"failure_cause": "dust"}]} .' if "It stops" in p else "{broken" for p in prompts]

    picked = answers.selected(sections, pick, str(tmp_path / "p"))
    assert {(r.sentence_id, r.sentence) for r in picked.collect()} == {("1_D2_S001", "It stops. It smells."), ("1_D4_S001", "Dust.")}
    got = {r.file: r for r in answers.consolidated(picked, sections, make, str(tmp_path / "c")).collect()}
    assert set(got) == {1, 2, 3} and got[1].failure_mode == "stops"
    assert [(c.cause_ID, c.failure_cause, c.discipline_type) for c in got[1].root_causes] == [("report_1_F1_C1", "Unknown cause (LLM incomplete)", "Other"), ("report_1_F1_C2", "dust", "Other")]
    assert (got[2].failure_mode, got[2].root_causes, got[3].root_causes) == (None, [], [])


def test_sources_do_not_travel_with_picked_sentences(spark, tmp_path, monkeypatch):
    from faultline.operators import texteval

    def pairs_of_whole_sources(*_, **__):
        raise AssertionError("each sentence would carry all sections of its case")

    monkeypatch.setattr(texteval, "faithfulness", pairs_of_whole_sources)
    sections = spark.createDataFrame([(1, "D2", "It stops. It smells."), (1, "D4", "Dust.")], "file long, source_section string, text string")
    picked = spark.createDataFrame([(1, "D2", 1, "It stops", "1_D2_S001"), (1, "D4", 1, "stops it smells", "1_D4_S001")], "file long, source_section string, place int, sentence string, sentence_id string")
    made = answers.consolidated(picked, sections, lambda p: [json.dumps({"failure_mode": " ".join(p[0].split())})] * len(p), str(tmp_path / "c"))
    seen = made.collect()[0].failure_mode
    assert "[id:1_D2_S001] It stops (status=?, faithful_score=100, type=exact)" in seen and "[id:1_D4_S001] stops it smells (status=?, faithful_score=" in seen


def test_tasks_of_an_ended_run_ask_no_more(tmp_path):
    model, pending = Counting(tmp_path / "asked"), tmp_path / "pending"
    pending.mkdir()
    frames = [pd.DataFrame({"key": ["a", "b"], "prompt": ["p", "q"]})]
    run = answers._asking(model, str(tmp_path / "calls"), 1, str(pending))(iter(frames))
    assert next(run)["asked"][0] == 1
    pending.rmdir()
    with pytest.raises(RuntimeError, match="has ended"):
        next(run)
    assert model.asked() == ["p"]


def test_sources_meet_their_sentences_once(spark):
    from faultline.operators import texteval

    sources = spark.createDataFrame([(1, "The  Motor stops. Dust  everywhere"), (2, "ΟΔΟΣ ΑΒ"), (3, None)], "file int, source string")
    said = [(1, "Motor stops"), (1, "dust everywhere"), (1, " "), (1, "stops the motor dust"), (2, "ΟΔΟΣ"), (2, "ΟΔΟΣ Α"), (2, "ΟΔΟ"), (2, None), (3, "a"), (None, "b")]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(said)], "i int, file int, sentence string")
    got = texteval.faithfulness_by(rows, sources, "file")
    # The plan that is returned reads everything, and has one join.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "parquet" not in plan
    want = texteval.faithfulness(rows.join(sources, "file")).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("faithful_type = 'exact'").count() >= 4
