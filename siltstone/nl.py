"""Questions in plain language to plans, and results to plain language, through any text-completing provider."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

from siltstone.errors import EngineError, InvalidPlan
from siltstone.plans import ir
from siltstone.telemetry import METRICS

QUESTIONS = 5


class Provider(Protocol):
    def complete(self, prompt: str) -> str: ...


class ChatService:
    """A provider over HTTP: any service with the widespread chat-completions interface. The key comes from the environment variable `key_from`."""

    def __init__(self, url: str, model: str, key_from: str = "SILTSTONE_MODEL_KEY", timeout: float = 60.0, attempts: int = 3):
        self.url, self.model, self.key_from, self.timeout, self.attempts = url, model, key_from, timeout, attempts

    @classmethod
    def from_environment(cls) -> ChatService:
        """SILTSTONE_MODEL_URL and SILTSTONE_MODEL say which."""
        try:
            return cls(os.environ["SILTSTONE_MODEL_URL"], os.environ["SILTSTONE_MODEL"])
        except KeyError as e:
            raise EngineError(f"the environment variable {e.args[0]} isn't set") from None

    def complete(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if (key := os.environ.get(self.key_from)) else {})
        with METRICS.timed("siltstone_model_call", model=self.model):
            for k in range(self.attempts):
                try:
                    with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as r:
                        found = json.load(r)
                    break
                except urllib.error.HTTPError as e:
                    if k + 1 == self.attempts or e.code < 500 and e.code != 429:
                        raise EngineError(f"the model's service answered {e.code}") from None
                except OSError as e:
                    if k + 1 == self.attempts:
                        raise EngineError(f"the model's service can't be reached: {e}") from None
                time.sleep(2**k / 4)
            for kind in ("prompt", "completion"):
                METRICS.count("siltstone_model_tokens_total", (found.get("usage") or {}).get(f"{kind}_tokens") or 0, model=self.model, kind=kind)
            try:
                return found["choices"][0]["message"]["content"]
            except (KeyError, IndexError, TypeError):
                raise EngineError("the model's service gave no answer") from None


class Canned:
    """A provider for use without a model: answers by the first entry whose key is in the prompt's last line, else by a function."""

    def __init__(self, answers: dict[str, str | list[str]] | None = None, otherwise: Callable[[str], str] | None = None):
        self.answers, self.otherwise, self.prompts = {k: list(v) if isinstance(v, list) else [v] for k, v in (answers or {}).items()}, otherwise, []

    def complete(self, prompt: str) -> str:
        self.prompts.append(prompt)
        for k, v in self.answers.items():
            if k in prompt:
                return v.pop(0) if len(v) > 1 else v[0]
        if self.otherwise is None:
            raise EngineError("the canned provider has no answer to this")
        return self.otherwise(prompt)


_GRAMMAR = """Answer with one JSON object and nothing else: a query plan.
Plan: {"Scan": {"dataset": D, "columns": [], "snapshot_id": ""}} | {"Filter": {"input": Plan, "predicate": Expr}}
 | {"Project": {"input": Plan, "exprs": [Expr], "aliases": [text]}}
 | {"Aggregate": {"input": Plan, "group_by": [Expr], "aggregates": [{"func": "Count|Sum|Avg|Min|Max", "arg": Expr or null, "alias": text}]}}
 | {"Sort": {"input": Plan, "keys": [{"expr": Expr, "descending": true|false}]}} | {"Limit": {"input": Plan, "n": number}}
Expr: {"Column": name} | {"Literal": {"Int|Float|Str|Bool": value}} | {"Binary": {"left": Expr, "op": op, "right": Expr}}
op: Eq NotEq Lt LtEq Gt GtEq And Or Add Sub Mul Div. Only Count may have a null argument. Above an Aggregate, only its keys and aliases exist."""

_EXAMPLES = [
    ("how many rows have qty over 3", '{"Aggregate":{"input":{"Filter":{"input":{"Scan":{"dataset":"d","columns":[],"snapshot_id":""}},"predicate":{"Binary":{"left":{"Column":"qty"},"op":"Gt","right":{"Literal":{"Int":3}}}}}},"group_by":[],"aggregates":[{"func":"Count","arg":null,"alias":"n"}]}}'),
    ("the two cities with the highest mean price", '{"Limit":{"input":{"Sort":{"input":{"Aggregate":{"input":{"Scan":{"dataset":"d","columns":[],"snapshot_id":""}},"group_by":[{"Column":"city"}],"aggregates":[{"func":"Avg","arg":{"Column":"price"},"alias":"mean_price"}]}},"keys":[{"expr":{"Column":"mean_price"},"descending":true}]}},"n":2}}'),
]


def plan_prompt(question: str, dataset: str, columns: dict[str, str], failed: tuple[str, str] | None = None) -> str:
    lines = [_GRAMMAR, *(f"Question: {q}\nPlan: {p}" for q, p in _EXAMPLES), f"Dataset: {dataset}", "Columns: " + ", ".join(f"{n} ({t})" for n, t in columns.items())]
    if failed:
        lines.append(f"Your last answer was\n{failed[0]}\nand was refused: {failed[1]}\nAnswer again, without that mistake.")
    return "\n\n".join([*lines, f"Question: {question}\nPlan:"])


def without_fence(text: str) -> str:
    m = re.fullmatch(r"\s*```[a-zA-Z]*\s*\n(.*?)\n?\s*```\s*", text, re.S)
    return (m[1] if m else text).strip()


def to_plan(question: str, dataset: str, columns: dict[str, str], provider: Provider, retries: int = 1) -> tuple[ir.Plan, str]:
    """The plan and the raw answer. An answer that is no valid plan is sent back once with the reason."""
    failed = None
    for _ in range(retries + 1):
        raw = provider.complete(plan_prompt(question, dataset, columns, failed))
        try:
            plan = ir.from_json(without_fence(raw))
            ir.validate(plan, {dataset: list(columns)})
            return plan, raw
        except InvalidPlan as e:
            failed = (raw, str(e))
    raise InvalidPlan(f"no valid plan for this question: {failed[1]}")


def narrate_rows(question: str, rows: list[dict], provider: Provider) -> str:
    table = json.dumps(rows, default=str, ensure_ascii=False) if rows else "no rows"
    return provider.complete(f"Say in one or two sentences what this result answers. Use only numbers that it has.\nQuestion: {question}\nResult: {table}").strip()


def narrate_findings(findings_json: str, provider: Provider) -> str:
    try:
        findings = json.loads(findings_json)
    except ValueError as e:
        raise EngineError(f"findings aren't JSON: {e}") from e
    return provider.complete("Describe these findings about a dataset to someone who knows the subject. Use only numbers in them.\nFindings: " + json.dumps(findings, ensure_ascii=False)).strip()


def suggest(dataset: str, columns: dict[str, str], summary_json: str, provider: Provider, count: int = QUESTIONS) -> list[str]:
    """Questions for which the provider also finds a valid plan, up to `count`."""
    prompt = f"Propose {count} questions that this dataset can answer, as a JSON list of texts.\nColumns: {json.dumps(columns)}\nSummary: {summary_json}"
    try:
        found = json.loads(without_fence(provider.complete(prompt)))
    except ValueError:
        return []
    out: list[str] = []
    for q in found if isinstance(found, list) else []:
        if len(out) == count:
            break
        if isinstance(q, str) and q.strip():
            try:
                to_plan(q, dataset, columns, provider)
                out.append(q)
            except EngineError:
                continue
    return out
