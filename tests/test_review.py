"""Coercion, merging, consolidation, the model protocol and the stub pipeline."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from specweave.functions import scalars as s
from specweave.operators import entities, outcome
from specweave.plans import experiments
from specweave.plans.model import Caller, ModelConfig, StubClient, TemperatureRejected, env_temperature, json_call
from specweave.plans.pipeline import PipelineConfig, prepare, run, runs_of, without

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests

DOC = "1.1 Register\nInput a name\n1.2 Search\nOutput a list\n1.3 Report"


def quiet(seconds):
    """No waiting in tests."""


def test_confidence_table(spark):
    cases = [(".9", 0.9), ('".85"', 0.85), ("90", 0.9), ("100", 1.0), ("1.5", 0.015), ("500", 0.0), ("-3", 0.0), ("null", 0.0), ('"abc"', 0.0), ("true", 0.0), ("[]", 0.0), ('"nan"', 0.0), ('"0.9d"', 0.0), (None, 0.0)]
    cases[0] = ("0.9", 0.9)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", s.coerce_confidence(F.try_parse_json("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == pytest.approx([c for _, c in cases])


def test_text_coercion(spark):
    df = spark.createDataFrame([("null",), ('" a "',), ("[1]",)], "t string")
    assert [r[0] for r in df.select(s.coerce_str(F.try_parse_json("t"))).collect()][:2] == ["", "a"]
    lists = spark.createDataFrame([('["a", null, " b ", ""]',), ('"x"',), ("{}",), ("3",)], "t string")
    assert [r[0] for r in lists.select(s.coerce_str_list(F.try_parse_json("t"))).collect()] == [["a", "b"], ["x"], [], []]


def test_merge_takes_the_first_best(spark):
    rows = [("d", 1, "Login  Form", "DATA", 0.8, ["a", "b"], ["x"], ["l"], "one"), ("d", 2, "login form", "DATA", 0.9, ["b", "c"], ["y"], [" l "], "two"), ("d", 3, "LOGIN FORM", "DATA", 0.9, [], ["x"], [], "three")]
    e = spark.createDataFrame(rows, "doc string, seq int, name string, element_type string, confidence double, source_frs array<string>, supporting_excerpts array<string>, aliases array<string>, description string")
    (m,) = entities.merge_elements(e, ["doc"]).collect()
    assert (m["name"], m["confidence"], m["source_frs"], m["supporting_excerpts"], m["aliases"], m["description"]) == ("login form", 0.9, ["a", "b", "c"], ["x", "y"], ["l"], "two")


def candidates(spark, n):
    rows = [("d", i, f"c{i}", f"need {i}", "dependency" if i % 2 else "isolation", f"G{i % 2}", [f"F{i}"], ["e"], None, ["A", f"B{i}"], "E" if i else None, i / 10 if i else None) for i in range(n)]
    return spark.createDataFrame(rows, "doc string, seq int, candidate_id string, requirement string, diagnostic_view string, gap_type string, source_frs array<string>, supporting_excerpts array<string>, relation_type string, dependency_path array<string>, affected_element string, dps double")


def test_consolidation_loses_nothing(spark):
    groups = spark.createDataFrame([("d", 0, "keep", ["c0", "c1", "ghost"], "both", ""), ("d", 1, "DEMOTE", ["c2"], "", "impl"), ("d", 2, "KEEP", ["c3"], " ", ""), ("d", 3, "KEEP", ["nobody"], "x", "")], "doc string, pos int, decision string, source_candidate_ids array<string>, requirement string, reason string")
    got = outcome.consolidate(candidates(spark, 6), groups, ["doc"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["outcome"], []).append(r)
    assert sorted(i for r in got for i in r["source_candidate_ids"]) == [f"c{i}" for i in range(6)]
    first = min(by["KEEP"], key=lambda r: r["seq"])
    assert (first["requirement"], first["diagnostic_view"], first["gap_type"], first["source_frs"], first["dps"]) == ("both", "dependency|isolation", "G0|G1", ["F0", "F1"], 0.1)
    assert [r["reason"] for r in by["REMOVE"]] == ["rejected by consolidation"]
    assert [r["requirement"] for r in by["REMOVE"]] == ["need 3"]


def test_an_id_in_two_groups(spark):
    groups = spark.createDataFrame([("d", 0, "KEEP", ["c0"], "a", ""), ("d", 1, "REMOVE", ["c0"], "", "")], "doc string, pos int, decision string, source_candidate_ids array<string>, requirement string, reason string")
    assert outcome.consolidate(candidates(spark, 1), groups, ["doc"]).count() == 2
    assert outcome.consolidate(candidates(spark, 1), groups, ["doc"], strict_partition=True).count() == 1


def test_retries_and_temperature():
    class Flaky:
        def __init__(self, answers):
            self.answers, self.seen = list(answers), []

        def complete(self, model, system, user, temperature):
            self.seen.append(temperature)
            a = self.answers.pop(0)
            if isinstance(a, Exception):
                raise a
            return a, 1, 1

    waits = []
    ok = json_call(Flaky(["[1]", ConnectionError("x"), '{"a": 1}']), "m", "s", "u", 0.1, waits.append)
    assert (ok["body"], ok["api_calls"], waits) == ('{"a": 1}', 2, [1, 2])
    c = Flaky([TemperatureRejected(), "{}"])
    assert json_call(c, "m", "s json", "u", 0.1, waits.append)["error"] is None and c.seen == [0.1, None]
    assert json_call(Flaky(["no"] * 3), "m", "s", "u", None, waits.append)["body"] is None


def test_environment(monkeypatch):
    for raw, want in (("none", None), ("off", None), ("junk", 0.3), ("", 0.3), (" 0.7 ", 0.7)):
        monkeypatch.setenv("SPECWEAVE_X", raw)
        assert env_temperature("SPECWEAVE_X", 0.3) == want
    monkeypatch.setenv("SPECWEAVE_VALIDATION_TEMPERATURE", "none")
    assert ModelConfig.from_environment().validation_temperature is None


class Failing(StubClient):
    """Fails until the marker file is there."""

    def __init__(self, marker):
        self.marker = marker

    def complete(self, model, system, user, temperature):
        if not os.path.exists(self.marker):
            raise ConnectionError("down")
        return "{}", 2, 1


def test_failed_requests_are_sent_again(spark, tmp_path):
    caller = Caller(spark, Failing(str(tmp_path / "up")), sleep=quiet)
    ask = spark.createDataFrame([("m", 0.1, "s", "u", "1")], "model string, temperature double, system string, user string, repetition string")
    assert caller.call(ask).first()["error"] == "ConnectionError: down"
    (tmp_path / "up").touch()
    assert (r := caller.call(ask).first())["error"] is None and r["prompt_tokens"] == 2
    assert Caller(spark, StubClient()).cache != Caller(spark, StubClient()).cache


class Malformed(StubClient):
    """Answers of the wrong shape, one for each kind of request."""

    def __init__(self, answer):
        self.answer = answer

    def complete(self, model, system, user, temperature):
        return json.dumps(self.answer), 1, 1


def test_stub_pipeline_and_malformed_answers(spark):
    docs = spark.createDataFrame([("S", "a", DOC), ("S", "b", "plain text")], "system_id string, document_id string, text string")
    caller = Caller(spark, StubClient(), sleep=quiet)
    ready = prepare(runs_of(docs, 1), caller)
    done = run(ready, caller)
    ids = {r["candidate_id"] for r in done["candidates"].where("document_id = 'a'").collect()}
    placed = [i for r in done["outcomes"].where("document_id = 'a'").collect() for i in r["source_candidate_ids"]]
    assert ids and set(placed) == ids
    numbers = [r["fr_number"] for r in done["kept"].where("document_id = 'a'").orderBy("seq").collect()]
    assert numbers[0] == "1.4"
    text = done["refined"].where("document_id = 'a'").first()["body"]
    assert text.startswith(DOC) and "\n1.4 " in text and text.endswith("\n")
    before = caller.responses().count()
    run(ready, caller)
    assert caller.responses().count() == before
    found = {r["view"]: r["count"] for r in done["findings"].where("document_id = 'a'").groupBy("view").count().collect()}
    assert found.get("dependency") and found.get("operation") == 1
    spent = {r["document_id"]: r["api_calls"] for r in done["usage"].collect()}
    assert sum(spent.values()) >= before and spent["a"] > ready.calls.where("document_id = 'a'").count()
    bad = Caller(spark, Malformed({"elements": "x", "relations": None, "findings": [1, None]}), sleep=quiet)
    assert prepare(runs_of(docs, 1), bad).elements.count() == 0


def test_ablation_configs_share_preparations():
    few, all_ = experiments.ablation_configs(), experiments.ablation_configs(5, True)
    assert len(few) == 8 and len(all_) == 14
    assert len({c.preparation_key for c in few.values()}) == 2
    assert without(PipelineConfig(), "refinement").refinement is False
    assert all(c.dependency_budget == 5 for c in all_.values())


def test_ranking_arguments(spark):
    docs = spark.createDataFrame([], "system_id string, document_id string, text string")
    for bad in ({"budgets": ()}, {"budgets": (0,)}, {"random_repetitions": 0}, {"signals": ("best",)}):
        with pytest.raises(ValueError):
            experiments.run_rankings(docs, Caller(spark, StubClient(), sleep=quiet), **bad)
