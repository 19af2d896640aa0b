"""A single event without a job: made, read, checked and written by the rules that the columns have.

Payloads are judged by the functions that the Arrow step uses, so one has the same
problems, in the same order, here and in a DataFrame.
"""

from __future__ import annotations

import json
import secrets
import time as clock
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime

from streamledger.errors import FieldProblem, InvalidEnvelope
from streamledger.functions import rules
from streamledger.functions.ids import DIGITS, ENTROPY_DIGITS, TIME_DIGITS
from streamledger.schema import FIELDS

COLUMN_OF = {w: n for n, w, _ in FIELDS}


def new_id(prefix: str = "evt") -> str:
    """A fresh ULID behind a prefix: its time, then random digits."""
    number = clock.time_ns() // 1_000_000 << 5 * ENTROPY_DIGITS | secrets.randbits(5 * ENTROPY_DIGITS)
    return f"{prefix}_" + "".join(DIGITS[number >> 5 * k & 31] for k in reversed(range(TIME_DIGITS + ENTROPY_DIGITS)))


def now_text() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")


@dataclass(frozen=True)
class Envelope:
    """An event. Equal if all fields are; its hash leaves out data, which may hold lists."""

    id: str
    type: str
    source: str
    time: str
    schema_version: str = "1"
    correlation_id: str | None = None
    causation_id: str | None = None
    run_id: str | None = None
    traceparent: str | None = None
    producer: str | None = None
    delivery_attempt: int | None = None
    data: Mapping = field(default_factory=dict, hash=False)

    @classmethod
    def new(cls, type: str, source: str, data: Mapping | None = None, **optional) -> Envelope:
        """A valid event with an id and time of its own, unless they are given."""
        made = cls(**({"id": new_id(), "time": now_text()} | optional), type=type, source=source, data={} if data is None else data)
        made.validate()
        return made

    @classmethod
    def from_dict(cls, payload: object) -> Envelope:
        found = rules.problems_of(rules.fields_apart(payload))
        if found:
            raise InvalidEnvelope(found)
        return cls(**{COLUMN_OF[k]: v for k, v in payload.items() if v is not None})

    @classmethod
    def from_json(cls, text: str) -> Envelope:
        apart = rules.take_apart(text)
        if apart["problem"]:
            raise InvalidEnvelope(rules.problems_of(apart))
        return cls.from_dict(json.loads(text))

    def problems(self) -> list[FieldProblem]:
        """Everything wrong with this event, in one pass."""
        return rules.problems_of(rules.fields_apart({w: getattr(self, n) for n, w, required in FIELDS if required or getattr(self, n) is not None}))

    def validate(self) -> None:
        found = self.problems()
        if found:
            raise InvalidEnvelope(found)

    def to_dict(self) -> dict:
        """The wire form: absent fields are left out, data is always there."""
        return {w: getattr(self, n) for n, w, _ in FIELDS if n == "data" or getattr(self, n) is not None}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, separators=(",", ":"))

    def row(self) -> tuple:
        """The envelope's columns."""
        return tuple(json.dumps(self.data, ensure_ascii=False, separators=(",", ":")) if n == "data" else getattr(self, n) for n, _, _ in FIELDS)
