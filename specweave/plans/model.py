"""External model calls behind one replayable interface.

Requests are rows (model, temperature, system, user, repetition). Each distinct request is sent once; responses
live in a Parquet table keyed by the request's hash, so a restart calls only what is missing and a
non-deterministic answer is never recomputed by lineage. A client is any picklable object with
``complete(model, system, user, temperature) -> (text, prompt_tokens, completion_tokens)``.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.storage import shared_dir, stage

ATTEMPTS, BACK_OFF = 3, (1, 2, 4)
JSON_HINT = "Answer with one JSON object."
REQUEST = ["model", "temperature", "system", "user", "repetition"]
RESPONSES = "request_hash string, body string, error string, prompt_tokens long, completion_tokens long, api_calls long"


def env_temperature(name: str, default: float | None) -> float | None:
    """A temperature from the environment: none, default or off give null, junk the default."""
    raw = (os.environ.get(name) or "").strip().lower()
    if not raw:
        return default
    if raw in ("none", "default", "off"):
        return None
    try:
        return float(raw)
    except ValueError:
        return default


@dataclass(frozen=True)
class ModelConfig:
    extraction_model: str = "default"
    validation_model: str = "default"
    generation_model: str = "default"
    extraction_temperature: float | None = 0.0
    validation_temperature: float | None = 0.1
    generation_temperature: float | None = 0.2

    @staticmethod
    def from_environment(prefix: str = "SPECWEAVE") -> ModelConfig:
        """Models and temperatures from PREFIX_STEP_MODEL and PREFIX_STEP_TEMPERATURE, read when called."""
        base = ModelConfig()
        for step in ("extraction", "validation", "generation"):
            name = f"{prefix}_{step.upper()}"
            base = replace(base, **{f"{step}_model": os.environ.get(f"{name}_MODEL") or getattr(base, f"{step}_model"), f"{step}_temperature": env_temperature(f"{name}_TEMPERATURE", getattr(base, f"{step}_temperature"))})
        return base


class TemperatureRejected(Exception):
    """Raised by a client whose model takes no temperature; the call is repeated without one."""


def json_call(client, model: str, system: str, user: str, temperature: float | None, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One request with retries: a row of the response table without its hash."""
    if "json" not in (system + user).lower():
        system = f"{system} {JSON_HINT}"
    calls = prompt = completion = 0
    error = "no attempt"
    for attempt in range(ATTEMPTS):
        try:
            try:
                text, p, c = client.complete(model, system, user, temperature)
            except TemperatureRejected:
                temperature = None
                text, p, c = client.complete(model, system, user, None)
            calls, prompt, completion = calls + 1, prompt + p, completion + c
            if isinstance(json.loads(text), dict):
                return {"body": text, "error": None, "prompt_tokens": prompt, "completion_tokens": completion, "api_calls": calls}
            error = "the answer is not an object"
        except Exception as e:  # any failure of an outside service becomes an error row
            error = f"{type(e).__name__}: {e}"
        sleep(BACK_OFF[attempt])
    return {"body": None, "error": error, "prompt_tokens": prompt, "completion_tokens": completion, "api_calls": calls}


def request_hash() -> F.Column:
    return F.sha2(F.to_json(F.struct(*REQUEST), {"ignoreNullFields": "false"}), 256)


@dataclass
class Caller:
    """Sends request rows through a client and remembers the answers under ``cache``."""

    spark: SparkSession
    client: object
    cache: str | None = None
    parallel: int = 8
    sleep: Callable[[float], None] = field(default=time.sleep)

    def __post_init__(self):
        self.cache = self.cache or f"{shared_dir(self.spark)}/responses-{uuid.uuid4().hex}"

    def responses(self) -> DataFrame:
        self.spark.createDataFrame([], RESPONSES).write.mode("append").parquet(self.cache)
        return self.spark.read.schema(RESPONSES).parquet(self.cache)

    def call(self, requests: DataFrame) -> DataFrame:
        """requests with request_hash, response (VARIANT, null if the call failed), error and usage columns."""
        keyed = stage(requests.withColumn("request_hash", request_hash()), "requests")
        client, sleep = self.client, self.sleep

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [json_call(client, r.model, r.system, r.user, None if pd.isna(r.temperature) else float(r.temperature), sleep) | {"request_hash": r.request_hash} for r in pdf.itertuples()]
                yield pd.DataFrame(rows, columns=["request_hash", "body", "error", "prompt_tokens", "completion_tokens", "api_calls"])

        # A failed request is not known, so a later call sends it again.
        known = self.responses().where("error IS NULL")
        new = keyed.dropDuplicates(["request_hash"]).join(known, "request_hash", "left_anti").select("request_hash", *REQUEST).repartition(self.parallel, "request_hash")
        stage(new.mapInPandas(run, RESPONSES), "answers").write.mode("append").parquet(self.cache)
        best = F.min_by(F.struct("body", "error", "prompt_tokens", "completion_tokens", "api_calls"), F.struct(F.col("error").isNotNull().alias("failed"), "error"))
        answers = self.responses().groupBy("request_hash").agg(best.alias("a")).select("request_hash", "a.*")
        # Written, as a later wave's reading of the growing folder counts as the same scan to the planner.
        return stage(keyed.join(answers, "request_hash", "left"), "answered").withColumn("response", F.try_parse_json("body")).drop("body")


def usage(called: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens and calls per run; a request shared by runs counts for each."""
    return called.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "api_calls")))


class StubClient:
    """A deterministic offline client: answers follow from the request's JSON payload alone."""

    def complete(self, model: str, system: str, user: str, temperature: float | None) -> tuple[str, int, int]:
        ask = json.loads(user)
        answer = getattr(self, f"_{ask['task']}")(ask)
        return json.dumps(answer, ensure_ascii=False), len(user) // 4, 16

    def _elements(self, ask):
        n, text = ask["requirement_id"], ask["text"][:40]
        return {"elements": [{"name": f"{kind.title()} {n}", "type": kind, "confidence": c, "supporting_excerpt": text, "aliases": [f"{kind.lower()}-{n}"], "description": ""} for kind, c in (("FUNCTION", 0.95), ("DATA", "0.9"), ("ACTOR", 85))]}

    def _relations(self, ask):
        names = ask["elements"]
        return {"relations": [{"source": a, "target": b, "relation_type": t, "confidence": 0.9, "supporting_excerpts": ["stub"], "source_frs": ask.get("ids", []), "justification": "stub"} for a, b, t in zip(names, names[1:], ["ENABLES", "PRODUCES"] * len(names), strict=False)]}

    def _dependency(self, ask):
        return {"findings": [{"gap_type": ask["patterns"][0], "affected_element": ask["target"], "reason": "stub"}]}

    def _isolation(self, ask):
        return {"label": "GENUINE_GAP", "gap_type": "", "reason": "stub"}

    def _operation(self, ask):
        return {"findings": [{"affected_element": x, "gap_type": "MISSING_AUDIT", "reason": "stub"} for x in ask["elements"][:1]]}

    def _validate(self, ask):
        return {"evidence": {"decision": "YES"}, "coverage": {"decision": "NO"}, "boundary": {"decision": "YES"}}

    def _generate(self, ask):
        return {"requirement": f"The system shall handle {ask['gap_type']} for {ask['affected_element']}."}

    def _consolidate(self, ask):
        ids = ask["ids"]
        if len(ids) < 4:
            return {"candidates": [{"decision": "KEEP", "source_candidate_ids": [i], "requirement": f"Refined {i}", "reason": ""} for i in ids]}
        return {"candidates": [
            {"decision": "KEEP", "source_candidate_ids": ids[:2], "requirement": "Merged requirement", "reason": "merge"},
            {"decision": "DEMOTE", "source_candidate_ids": ids[2:3], "requirement": "Design note", "reason": "implementation"},
            {"decision": "REMOVE", "source_candidate_ids": ids[3:], "requirement": "", "reason": "duplicate"},
        ]}
