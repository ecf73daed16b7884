"""Investigating one alert: four tools over the tables, and a bounded exchange with a language model that calls them.

An investigation is a value, Inquiry, and each kind of reply a move that makes the next one; MOVES has the move of each kind. The
model is any function of (instructions, turns) that returns text; scripted() makes one of fixed replies. No client for a remote
model is included.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from streamloom.operators.fold import baseline_asof
from streamloom.plans import engine

Model = Callable[[str, list[dict]], str]

# The words of a memo that readers rely on.
UNKNOWN, NO_CONCLUSION = "unknown", "no_conclusion"
OUT_OF_TURNS, MALFORMED, ORIGINAL = "max_turns_exceeded", "malformed_llm_response", "original_hypothesis:"


class DomainCardNotFoundError(Exception):
    def __init__(self, domain: str, path: str):
        super().__init__(f"domain {domain!r} has no card at {path}")
        self.domain, self.path = domain, path


@dataclass
class Evidence:
    """What was known when the alert fired. Results are collected, as they are for the model to read, over closed intervals; a range
    of more than most_rows rows is an error, which the model is told."""

    messages: DataFrame
    alerts: DataFrame
    cards: str
    domain: str
    at_ns: int
    alpha: float = 0.3
    most_rows: int = 100_000

    def _rows(self, found: DataFrame) -> list[dict]:
        rows = found.limit(self.most_rows + 1).collect()
        if len(rows) > self.most_rows:
            raise ValueError(f"more than {self.most_rows} rows: ask for a smaller range")
        return [r.asDict() for r in rows]

    def get_window(self, stream_id: int, t0_ns: int, t1_ns: int) -> list[dict]:
        return self._rows(engine.window_slice(self.messages, stream_id, t0_ns, t1_ns))

    def get_baseline(self, stream_id: int) -> dict:
        """Of messages up to the alert's time alone; zeros for a stream without any."""
        r = baseline_asof(self.messages, stream_id, self.at_ns, self.alpha).first()
        return {"mean": r.mean, "variance": r.variance} if r else {"mean": 0.0, "variance": 0.0}

    def get_concurrent_alerts(self, ts_ns: int, window_ns: int) -> list[dict]:
        return self._rows(engine.concurrent(self.alerts, ts_ns, window_ns))

    def get_domain_card(self, domain: str | None = None) -> str:
        name = self.domain if domain is None else domain
        path = os.path.join(self.cards, f"{name}.md")
        try:
            with open(path, encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError as e:
            raise DomainCardNotFoundError(name, path) from e

    def tools(self) -> dict[str, Callable]:
        return {f.__name__: f for f in (self.get_window, self.get_baseline, self.get_concurrent_alerts, self.get_domain_card)}


def scripted(replies: Iterable[str]) -> Model:
    """A model that gives these replies in turn."""
    left = iter(replies)
    return lambda instructions, turns: next(left)


def unfenced(text: str) -> str:
    """Without the code fence around it, if there is one."""
    head, newline, rest = text.strip().partition("\n")
    if not head.startswith("```"):
        return text.strip()
    body, _, last = rest.rpartition("\n")
    return (body if last.strip() == "```" else rest).strip()


@dataclass(frozen=True)
class Lookup:
    """A reply that calls a tool."""

    tool: str
    args: dict


@dataclass(frozen=True)
class Conclusion:
    """A reply that ends the investigation."""

    said: dict


@dataclass(frozen=True)
class Garbled:
    """Any other reply."""


Reply = Lookup | Conclusion | Garbled


def typed(text: str, tools: Iterable[str]) -> Reply:
    try:
        said = json.loads(text)
    except (ValueError, TypeError):
        return Garbled()
    match said:
        case {"memo": dict() as memo}:
            return Conclusion(memo)
        case {"tool": str() as name, "args": dict() as args} if name in tools:
            return Lookup(name, args)
        case {"tool": str() as name} if name in tools and "args" not in said:
            return Lookup(name, {})
    return Garbled()


@dataclass(frozen=True)
class Memo:
    stream_id: int
    hypothesis: str = NO_CONCLUSION
    confidence: float = 0.0
    evidence: tuple = ()

    def filed(self, hypotheses: set[str]) -> Memo:
        """Under one of the hypotheses: any other is filed as unknown and kept as evidence."""
        if self.hypothesis in hypotheses | {UNKNOWN}:
            return self
        return replace(self, hypothesis=UNKNOWN, evidence=(*self.evidence, ORIGINAL + str(self.hypothesis)))

    def as_dict(self) -> dict:
        return {"stream_id": self.stream_id, "hypothesis": self.hypothesis, "confidence": self.confidence, "evidence": list(self.evidence)}


@dataclass(frozen=True)
class Inquiry:
    """Where an investigation stands: what was said, the turns left, whether this turn's reply may still be mended, and the memo."""

    stream_id: int
    tools: dict[str, Callable]
    hypotheses: set[str]
    turns: int
    mendable: bool = True
    talk: tuple[dict, ...] = ({"role": "user", "content": "Begin."},)
    memo: Memo | None = field(default=None)

    def __post_init__(self):
        if self.turns <= 0 and self.memo is None:
            object.__setattr__(self, "memo", Memo(self.stream_id, evidence=(OUT_OF_TURNS,)))

    def answered(self, raw: str, answer: str, **changes) -> Inquiry:
        """Goes on after the reply `raw` and our answer to it."""
        return replace(self, talk=(*self.talk, {"role": "assistant", "content": raw}, {"role": "user", "content": answer}), **changes)


def look_up(at: Inquiry, raw: str, call: Lookup) -> Inquiry:
    """Run the tool and end the turn; its error goes back to the model like a result."""
    try:
        answer = json.dumps({"tool": call.tool, "result": at.tools[call.tool](**call.args)})
    except Exception as e:  # noqa: BLE001 - the model is told
        answer = json.dumps({"tool": call.tool, "error": f"{type(e).__name__}: {e}"})
    return at.answered(raw, answer, turns=at.turns - 1, mendable=True)


def conclude(at: Inquiry, raw: str, end: Conclusion) -> Inquiry:
    given = {"hypothesis": UNKNOWN, "confidence": 0.0, "evidence": ()} | {k: v for k, v in end.said.items() if k in ("hypothesis", "confidence", "evidence")}
    return replace(at, memo=Memo(at.stream_id, given["hypothesis"], given["confidence"], tuple(given["evidence"])).filed(at.hypotheses))


def mend(at: Inquiry, raw: str, reply: Garbled) -> Inquiry:
    """Ask for the same reply once more, but only once a turn."""
    if at.mendable:
        return at.answered(raw, "That was malformed: send one JSON object with either tool or memo.", mendable=False)
    return replace(at, memo=Memo(at.stream_id, evidence=(MALFORMED,)))


MOVES: dict[type, Callable[[Inquiry, str, Reply], Inquiry]] = {Lookup: look_up, Conclusion: conclude, Garbled: mend}


def instructions(alert: dict, card: str, tools: Iterable[str], hypotheses: set[str]) -> str:
    return "\n\n".join([
        "Find out why this telemetry alert fired: " + json.dumps(alert),
        "What is known about its domain:\n" + card,
        "Answer with a single JSON object. To look something up: {\"tool\": name, \"args\": {...}}, name being one of " + ", ".join(tools) + ".",
        "To finish: {\"memo\": {\"hypothesis\": h, \"confidence\": from 0 to 1, \"evidence\": [texts]}}, h being one of " + ", ".join(sorted(hypotheses | {UNKNOWN})) + ".",
    ])


def investigate(model: Model, tools: dict[str, Callable], alert: dict, domain: str, hypotheses: set[str], turns: int) -> dict:
    """The memo on an alert, after so many turns at most."""
    brief = instructions(alert, tools["get_domain_card"](domain=domain), tools, hypotheses)
    at = Inquiry(alert["stream_id"], tools, set(hypotheses), turns)
    while at.memo is None:
        raw = model(brief, list(at.talk))
        reply = typed(raw, tools)
        at = MOVES[type(reply)](at, raw, reply)
    return at.memo.as_dict()
