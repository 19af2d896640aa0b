"""Errors of the ledger: each names what is wrong, what to do, and whether the caller or the environment is at fault."""

from __future__ import annotations

from dataclasses import dataclass

#: Codes that a rejected field can carry.
ERROR_CODES = ("missing", "unknown_field", "not_an_object", "not_json", "not_a_string", "not_an_integer", "empty", "too_long", "too_deep", "malformed", "not_utc", "out_of_range", "unsupported_type", "reserved_mqtt_char")


@dataclass(frozen=True)
class FieldProblem:
    field: str
    code: str
    message: str


class LedgerError(Exception):
    """Base of all errors here. exit_code: 1 where the caller can mend it, 2 where the environment must."""

    exit_code = 1
    remedy = ""

    def __init__(self, message: str, remedy: str = ""):
        super().__init__(message)
        self.remedy = remedy or type(self).remedy


class InvalidEnvelope(LedgerError):
    remedy = "mend the fields named in errors and send the event again"

    def __init__(self, errors: list[FieldProblem]):
        self.errors = errors
        super().__init__("invalid event envelope: " + "; ".join(f"{e.field}: {e.message}" for e in errors))


class InvalidTopic(LedgerError):
    remedy = "use lower-case dotted segments; in patterns * stands for one segment"

    def __init__(self, errors: list[FieldProblem]):
        self.errors = errors
        super().__init__("invalid topic: " + "; ".join(f"{e.field}: {e.code}" for e in errors))


class InvalidBound(LedgerError):
    remedy = "limits are whole numbers of 1 or more, cursors of 0 or more"


class UnreadableInput(LedgerError):
    remedy = "give a file with a JSON document in UTF-8, or - for stdin"


class InvalidName(LedgerError):
    remedy = "names have 1 to 64 lower-case letters, digits, dots, dashes and underscores, and begin with a letter or digit"


class UnknownSubscription(LedgerError):
    remedy = "add the subscription first"


class SubscriptionExists(LedgerError):
    remedy = "remove it first, or choose another name"


class UnknownEvent(LedgerError):
    remedy = "check the id"


class CorruptLedger(LedgerError):
    exit_code = 2
    remedy = "restore the named file; records are never skipped"


class CorruptRegistry(LedgerError):
    exit_code = 2
    remedy = "restore or remove the named file"


class BrokerUnavailable(LedgerError):
    exit_code = 2
    remedy = "check the backlog's location and that it can be read"


class InvalidAddress(LedgerError):
    exit_code = 2
    remedy = "give host and port; a malformed port is never replaced by the default"


class SubscriptionBusy(LedgerError):
    exit_code = 2
    remedy = "wait for the drain that holds this subscription to end"
