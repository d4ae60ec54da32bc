"""Conflicts of fields as keyed state: what is stored of a field is read and written only when the field has an event."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.facts import CLOSED, SCANNED

_BLANKS = " \t\n\x0b\x0c\r"
_NUMERIC = ("integer", "number", "boolean")

FOUND = "workspace_id int, company_id string, field_key string, context_key string, n_facts bigint, n_differing bigint, status string, n_attached bigint, first_new bigint, n_new bigint"


def _value(raw: str) -> Any:
    try:
        return json.loads(raw)
    except ValueError:
        return None


def _number(kind: str, raw: str) -> float | None:
    if kind == "boolean":
        return float(raw == "true")
    try:
        return float(raw)
    except ValueError:
        return None


def differ(field: str, kind: str, a: str | None, other_kind: str, b: str | None) -> bool:
    """What facts.materially_different says of a pair of values; what that leaves open (null) is no difference."""
    if a is None or b is None:
        return False
    if kind == other_kind == "string":
        s, t = _value(a), _value(b)
        if not isinstance(s, str) or not isinstance(t, str):
            return False
        s, t = (x.strip(_BLANKS).lower() for x in (s, t))
        words = [set(x.split()) for x in (s, t)]
        inside = field == "identity.legal_name" and all(words) and (words[0] <= words[1] or words[1] <= words[0])
        return s != t and not inside
    if kind in _NUMERIC and other_kind in _NUMERIC:
        x, y = _number(kind, a), _number(other_kind, b)
        return x is not None and y is not None and abs(x - y) * 20 > max(abs(x), abs(y))

    def whole(k: str, raw: str) -> str | None:
        v = _value(raw)
        return (v if isinstance(v, str) else None) if k == "string" else json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    s, t = whole(kind, a), whole(other_kind, b)
    return s is not None and t is not None and s != t


#: Fields are dealt to so many groups, so that one call reads and answers for many of them. A checkpoint holds to its number.
GROUPS = 8192
#: Characters of a page of a field's text: JSON of its head, its facts and the ids attached.
PAGE = 1 << 20
_KINDS = [c.split() for c in FOUND.split(", ")]


class _Field:
    """A field's facts, which of them is the first, and its conflict with the facts attached to it.

    Facts that come together are judged together; a decision in between is applied at its place. A fact earlier than the
    first becomes the first, and all others are compared with it; so are they if the first is rejected.
    """

    def __init__(self, field: str, stored: list | None):
        self.field = field
        self.facts: dict[int, list] = {}  # by id: type, value, whether it differs from the first
        self.first, self.n_differing, self.status, self.first_new, self.n_new = None, 0, None, None, 0
        self.attached: set[int] = set()
        if stored is not None:
            self.first, self.n_differing, self.status, self.first_new, self.n_new, facts, attached = stored
            self.facts, self.attached = {f[0]: f[1:] for f in facts}, set(attached)

    def stored(self) -> list:
        return [self.first, self.n_differing, self.status, self.first_new, self.n_new, [[own, *f] for own, f in self.facts.items()], sorted(self.attached)]

    def found(self) -> tuple:
        return len(self.facts), self.n_differing, self.status, len(self.attached), self.first_new, self.n_new

    def apply(self, events: list[tuple]) -> None:
        judged = True
        for _, own, kind, value, status, action in events:
            if action is None:
                self._fact(own, kind, value, status)
                judged = False
            else:
                judged = judged or self._judge()
                if self.status is not None and action in CLOSED:
                    self.status = action
        judged or self._judge()

    def _fact(self, own: int, kind: str, value: str | None, status: str) -> None:
        known = self.facts.pop(own, None)
        if known is not None:
            self.n_differing -= known[2]
        if status not in SCANNED:
            if known is not None and own == self.first:
                self._lead(min(self.facts, default=None))
            return
        leads = self.first is None or own <= self.first
        differs = not leads and differ(self.field, *self.facts[self.first][:2], kind, value)
        self.facts[own] = [kind, value, differs]
        self.n_differing += differs
        if leads:
            self._lead(own)

    def _lead(self, first: int | None) -> None:
        """Another fact, or another value of it, is the first: all are compared anew."""
        self.first, self.n_differing = first, 0
        for own, f in self.facts.items():
            f[2] = own != first and differ(self.field, *self.facts[first][:2], f[0], f[1])
            self.n_differing += f[2]

    def _judge(self) -> bool:
        """Opens a conflict, or a closed one again if a fact not yet attached disagrees; open ones aren't extended."""
        if self.n_differing and (self.status is None or self.status in CLOSED):
            new = [own for own, f in self.facts.items() if (f[2] or own == self.first) and (self.status is None or own not in self.attached)]
            if new:
                self.attached.update(new)
                self.status, self.first_new, self.n_new = ("open", None, 0) if self.status is None else ("reopened", min(new), len(new))
        return True


class Conflicts(StatefulProcessor):
    """The fields of a group, each stored under its own key: of a group's fields those with an event are read and written.

    A group is called once a batch, as a call for each field costs more than the field. The text of a field is cut into
    pages, of which most fields need one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "workspace_id int, company_id string, field_key string, context_key string, page int", "pages int, text string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events: dict[tuple, list[tuple]] = {}
        for part in rows:
            columns = [part[c].tolist() for c in ("workspace_id", "company_id", "field_key", "context_key", "seq", "fact_id", "value_type", "value_json", "fact_status", "action")]
            for w, c, f, x, seq, own, *rest in zip(*columns, strict=True):
                events.setdefault((None if w is None or w != w else int(w), c, f, x), []).append((int(seq), None if own is None else int(own), *rest))
        out = []
        for own, mine in events.items():
            mine.sort(key=lambda e: (e[0], e[1] is None, e[1] or 0))
            text, pages = self._read(own)
            field = _Field(own[2], None if text is None else json.loads(text))
            field.apply(mine)
            self._write(own, json.dumps(field.stored(), ensure_ascii=False, separators=(",", ":")), pages)
            out.append((*own, *field.found()))
        columns = zip(*out, strict=True)
        yield pd.DataFrame({name: pd.Series(list(v), dtype="Int64" if kind == "bigint" else object) for (name, kind), v in zip(_KINDS, columns, strict=True)})

    def _read(self, own: tuple) -> tuple[str | None, int]:
        first = self.pages.getValue((*own, 0))
        if first is None:
            return None, 0
        return "".join([first[1], *(self.pages.getValue((*own, p))[1] for p in range(1, first[0]))]), first[0]

    def _write(self, own: tuple, text: str, before: int) -> None:
        parts = [text[i : i + PAGE] for i in range(0, len(text), PAGE)]
        for p, part in enumerate(parts):
            self.pages.updateValue((*own, p), (len(parts), part))
        for p in range(len(parts), before):
            self.pages.removeKey((*own, p))

    def close(self) -> None:
        pass
