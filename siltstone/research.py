"""Questions of several parts: a plan of sub-questions, their results, charts, sentences and a report in which each statement
names its source. Everything here runs on the driver but the queries and the search it calls."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from siltstone.errors import EngineError
from siltstone.nl import Provider, narrate_rows, without_fence

log = logging.getLogger(__name__)
_DATE_NAME = re.compile(r"(^|_)(date|day|week|month|quarter|year|time|ts)($|_)", re.I)


@dataclass(frozen=True)
class SubQuestion:
    kind: str  # structured or literature
    text: str


@dataclass(frozen=True)
class Found:
    doc_id: str
    text: str
    score: float


@dataclass
class State:
    question: str
    dataset: str
    corpus: str = ""
    sub_questions: list[SubQuestion] = field(default_factory=list)
    results: list[tuple[SubQuestion, list[dict]]] = field(default_factory=list)
    documents: list[Found] = field(default_factory=list)
    charts: list[dict] = field(default_factory=list)
    sentences: list[str] = field(default_factory=list)
    report: str = ""


def plan_questions(question: str, provider: Provider) -> list[SubQuestion]:
    """What the provider splits the question into; the question itself where that gives nothing usable."""
    prompt = f'Split this question into parts, as a JSON list of {{"kind": "structured" (data can answer it) or "literature" (texts can), "text": ...}}.\nQuestion: {question}'
    try:
        items = json.loads(without_fence(provider.complete(prompt)))
    except ValueError:
        items = []
    good = [SubQuestion(x["kind"], x["text"].strip()) for x in items if isinstance(x, dict) and x.get("kind") in ("structured", "literature") and isinstance(x.get("text"), str) and x["text"].strip()] if isinstance(items, list) else []
    return good or [SubQuestion("structured", question)]


def run_questions(questions: list[SubQuestion], run: Callable[[str], list[dict]]) -> list[tuple[SubQuestion, list[dict]]]:
    """Rows for each structured part; parts that fail are left out."""
    out = []
    for q in questions:
        if q.kind == "structured":
            try:
                out.append((q, run(q.text)))
            except EngineError as e:
                log.warning("%r failed: %s", q.text, e)
    return out


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def choose_chart(rows: list[dict]) -> dict:
    """stat for one small row; line for numbers over time; bar for numbers by category; table for anything else."""
    if not rows:
        return {"kind": "table"}
    names = list(rows[0])
    if len(rows) == 1 and len(names) <= 2:
        return {"kind": "stat", "columns": names}
    numbers = [n for n in names if all(_number(r.get(n)) or r.get(n) is None for r in rows) and any(_number(r.get(n)) for r in rows)]
    labels = [n for n in names if n not in numbers]
    dates = [n for n in labels if _DATE_NAME.search(n) or all(hasattr(r.get(n), "isoformat") for r in rows)]
    if dates and numbers:
        return {"kind": "line", "x": dates[0], "y": numbers[0]}
    if labels and numbers:
        return {"kind": "bar", "x": labels[0], "y": numbers[0]}
    return {"kind": "table"}


def explain(results: list[tuple[SubQuestion, list[dict]]], provider: Provider) -> list[str]:
    """A sentence a result; the tag is put on here, so that it can't be forgotten or made up."""
    return [f"{narrate_rows(q.text, rows, provider)} [data]" for q, rows in results]


def write_report(state: State, retrieve: Callable[[str, str], list[Found]]) -> str:
    for q in state.sub_questions:
        if q.kind == "literature" and state.corpus:
            state.documents += retrieve(q.text, state.corpus)
    lines = [f"# {state.question}", "", *(f"{s}\n" for s in state.sentences)]
    if state.documents:
        lines += ["## Related literature", "", *(f"- {' '.join(d.text.split())} [literature:{d.doc_id}]" for d in state.documents)]
    return "\n".join(lines).strip() + "\n"


def investigate(question: str, dataset: str, run: Callable[[str], list[dict]], retrieve: Callable[[str, str], list[Found]], provider: Provider, corpus: str = "") -> State:
    """All steps in turn, each with its in- and output logged."""
    s = State(question, dataset, corpus)
    for name, step in (
        ("sub_questions", lambda: plan_questions(question, provider)),
        ("results", lambda: run_questions(s.sub_questions, run)),
        ("charts", lambda: [choose_chart(rows) for _, rows in s.results]),
        ("sentences", lambda: explain(s.results, provider)),
        ("report", lambda: write_report(s, retrieve)),
    ):
        setattr(s, name, step())
        log.info("%s: %r", name, getattr(s, name))
    return s


_TAG = re.compile(r"\[(data|literature:([^\]]+))\]")


def citations(text: str) -> list[dict]:
    """The text in pieces, each with the source whose tag follows it: kind data, literature (with id) or none."""
    out, at = [], 0
    for m in _TAG.finditer(text):
        piece = text[at : m.start()].strip()
        source = {"kind": "data"} if m[1] == "data" else {"kind": "literature", "id": m[2]}
        out.append({"text": piece, "source": source})
        at = m.end()
    if text[at:].strip():
        out.append({"text": text[at:].strip(), "source": None})
    return out
