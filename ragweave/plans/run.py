"""Phases with gates: each runs once, its result is kept, and the first gate that does not pass ends the run."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.operators.evaluate import final_verdict
from ragweave.operators.ledger import matches
from ragweave.sources.store import exists, put_json, read_json

PASSED, FAILED = "PASS", "FAIL"


class State:
    """A run's phases as one document that is replaced whole; one writer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> dict:
        return read_json(self.spark, self.path) if exists(self.spark, self.path) else {"phases": {}}

    def mutate(self, change: Callable[[dict], None]) -> dict:
        document = self.load()
        change(document)
        document["saved_at"] = datetime.now(UTC).isoformat()
        put_json(self.spark, self.path, document)
        return document

    def require(self, phase: str) -> None:
        """An error unless the phase has passed."""
        status = self.load()["phases"].get(phase, {}).get("status")
        if status != PASSED:
            raise RuntimeError(f"phase {phase} has not passed: {status}")


def run(state: State, phases: list[tuple[str, Callable[[], dict]]], fields: dict[str, object]) -> dict:
    """The state after all phases, or after the first that fails.

    A phase gives {"passed": bool, ...}; an error fails it. A phase that passed with the same provenance fields is not
    run again; a change of fields runs it anew.
    """
    for name, phase in phases:
        before = state.load()["phases"].get(name, {})
        if before.get("status") == PASSED and before.get("provenance") == fields:
            continue
        try:
            result = phase()
        except Exception as e:
            result = {"passed": False, "error": f"{type(e).__name__}: {str(e)[:500]}"}
        status = PASSED if result.get("passed") else FAILED
        document = state.mutate(lambda d: d["phases"].__setitem__(name, {"status": status, "provenance": fields, "result": result}))  # noqa: B023
        if status == FAILED:
            return document
    return state.load()


def gates(spark: SparkSession, document: dict, judged: dict[str, bool] | None = None) -> DataFrame:
    """(gate, passed) of the phases that ran, the judgments of the last one, and `run` if all that was planned passed."""
    rows = [(k, v["status"] == PASSED) for k, v in document["phases"].items()] + list((judged or {}).items())
    if document.get("status") == PASSED:
        rows.append(("run", True))
    return spark.createDataFrame(rows, "gate string, passed boolean")


def report(spark: SparkSession, document: dict, fields: dict[str, object], judged: dict[str, bool] | None = None) -> str:
    """The run as Markdown. Phases of another provenance count as not run, and a phase that did not pass says so."""
    current = {"phases": {k: v for k, v in document["phases"].items() if v.get("provenance") == fields}}
    verdict = final_verdict(gates(spark, current, judged)).first()
    lines = ["# Run", "", f"Verdict: {verdict['verdict']}" + (f" ({verdict['reason']})" if verdict["reason"] else ""), ""]
    for name, phase in current["phases"].items():
        lines += [f"## {name}", "", f"Status: {phase['status']}", ""]
        if phase["status"] == PASSED:
            lines += [f"- {k}: {v}" for k, v in sorted(phase["result"].items()) if k != "passed"]
        else:
            lines += [f"Not complete: {phase['result'].get('error', 'its gate did not pass')}"]
        lines += [""]
    return "\n".join(lines)


def preflight(spark: SparkSession, tables: dict[str, list[str]], path: str, probes: dict[str, Callable[[], DataFrame]] | None = None) -> dict:
    """{"passed", "problems"}: every table is there with its columns, and every probe's numbers are finite."""
    problems = []
    for name, columns in tables.items():
        try:
            have = set(spark.read.parquet(f"{path}/{name}.parquet").columns)
        except Exception as e:
            problems.append(f"{name}: {type(e).__name__}")
            continue
        problems += [f"{name}: no column {c}" for c in columns if c not in have]
    for name, probe in (probes or {}).items():
        df = probe()
        numbers = [c for c, kind in df.dtypes if kind in ("double", "float")]
        bad = F.lit(False)
        for c in numbers:
            bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        if df.isEmpty() or not df.where(bad).isEmpty():
            problems.append(f"{name}: no rows, or scores that are not finite")
    return {"passed": not problems, "problems": problems}


def current(rows: DataFrame, fields: dict[str, object]) -> DataFrame:
    """Rows of the current provenance."""
    return rows.where(matches(fields))
