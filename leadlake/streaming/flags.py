"""Contact flags kept in the state of a stream.

The state of a company is the last change of each of its contacts, and the counts per
type. Every call of the state store is a round trip, so the entries of a small company lie
in one value with its counts; those of a larger one lie in chunks by a hash of the contact,
four times as many whenever they are full. A micro-batch reads its own rows and the chunks
that they change, never all that came before, and gives the flags of companies whose flags
changed.

This module stands alone, so that executors need nothing of the package to run it.
"""

from __future__ import annotations

import json
import sys
import zlib

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CODE = "credit_code"
TYPES = ("mobile", "landline", "email")
FLAGS = (
    f"{CODE} string, has_mobile tinyint, has_landline tinyint, has_email tinyint, has_contact tinyint, mobile_count int, email_count int"
)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Entries of a chunk on the average at most, and entries of a company that are held at once.
CHUNK, HELD = 64, 20_000


class ContactFlags(StatefulProcessor):
    """Changes (contact_type, contact_value, op, at) of a company to its flags, if they changed.

    Of the changes of a contact the one with the greatest ``at`` counts, and of equal ones a
    deletion, in whatever batch they come. Deletions are remembered for
    ``forget_ms`` after they were seen (None: for ever), so that older additions which
    arrive late change nothing.
    """

    def __init__(self, forget_ms: int | None = None):
        self._forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # The number of chunks is two to the power of ``level``; the only chunk of level 0 is ``held``.
        self._company = handle.getValueState("company", "mobile int, landline int, email int, level int, entries int, held string")
        self._chunks = handle.getMapState("chunks", "chunk int", "held string")

    def _begin(self, now: int) -> tuple | None:
        """Take up the company of the current key."""
        before = self._company.get()
        self._now, self._counts = now, list(before[:3]) if before else [0, 0, 0]
        self._level, self._entries = before[3:5] if before else (0, 0)
        #: Chunks that were read, contact to (at, when its deletion was seen, or None); and which of them changed.
        self._read: dict[int, dict] = {}
        self._changed: set[int] = set()
        if not self._level:
            self._take(0, before[5] if before else None)
        return before

    def _take(self, chunk: int, text: str | None) -> dict:
        held = {(kind, value): (at, seen) for kind, value, at, seen in json.loads(text)} if text else {}
        if self._forget_ms is not None:
            gone = [c for c, (_, seen) in held.items() if seen is not None and seen + self._forget_ms <= self._now]
            for contact in gone:
                del held[contact]
            if gone:
                self._entries -= len(gone)
                self._changed.add(chunk)
        self._read[chunk] = held
        return held

    def _chunk(self, chunk: int) -> dict:
        held = self._read.get(chunk)
        if held is None:
            found = self._chunks.getValue((chunk,))
            held = self._take(chunk, found[0] if found else None)
        return held

    @staticmethod
    def _text(held: dict) -> str:
        return json.dumps([[*contact, *entry] for contact, entry in held.items()], ensure_ascii=False, separators=(",", ":"))

    def _put(self) -> None:
        """Write changed chunks and give up all."""
        for chunk in self._changed:
            if self._read[chunk]:
                self._chunks.updateValue((chunk,), (self._text(self._read[chunk]),))
            elif self._chunks.containsKey((chunk,)):
                self._chunks.removeKey((chunk,))
        self._read, self._changed = {}, set()

    def _place(self, contact: tuple) -> int:
        return zlib.crc32(repr(contact).encode()) & ((1 << self._level) - 1) if self._level else 0

    def _grow(self) -> None:
        """Four chunks of each; their entries are told apart by the next two bits."""
        was = 1 << self._level
        if self._level:
            self._put()
        for chunk in range(was):
            held = self._chunk(chunk)
            del self._read[chunk]
            self._level += 2
            for contact, entry in held.items():
                self._read.setdefault(self._place(contact), {})[contact] = entry
            self._level -= 2
            self._changed = {chunk, *self._read} if was > 1 else set(self._read)
            self._read.setdefault(chunk, {})
            self._put()
        self._level += 2

    def _end(self, before: tuple | None, touched: bool) -> None:
        held = None
        if self._level:
            self._put()
        elif self._read[0]:
            held = self._text(self._read[0])
        after = (*self._counts, self._level, self._entries, held)
        if touched or before is None or after[:5] != tuple(before[:5]):
            self._company.update(after)

    def handleInputRows(self, key, rows, timerValues):
        before = self._begin(0 if self._forget_ms is None else timerValues.getCurrentProcessingTimeInMs())
        counts, at_of, touched, deleted = self._counts, None, bool(self._changed), False
        for row in rows:
            if at_of is None:
                at_of = [row.__fields__.index(c) for c in ("contact_type", "contact_value", "op", "at")]
            kind, value, op, at = (row[i] for i in at_of)
            if kind not in TYPES:
                continue
            contact = (TYPES.index(kind), value)
            chunk = self._place(contact)
            held = self._chunk(chunk)
            last = held.get(contact)
            if last is not None and last[0] >= at + (op == "delete" and last[1] is None):
                continue
            added = op == "add"
            counts[contact[0]] += added - (last is not None and last[1] is None)
            held[contact] = (at, None if added else self._now)
            self._entries += last is None
            self._changed.add(chunk)
            touched, deleted = True, deleted or not added
            if self._entries > CHUNK << self._level:
                self._grow()
            elif self._level and len(self._read) * CHUNK > HELD:
                self._put()
        self._end(before, touched)
        if deleted and self._forget_ms is not None:
            self._handle.registerTimer(self._now + self._forget_ms)
        if before is None or tuple(counts) != tuple(before[:3]):
            mobile, landline, email = counts
            yield Row(
                credit_code=key[0], has_mobile=int(mobile > 0), has_landline=int(landline > 0), has_email=int(email > 0),
                has_contact=int(sum(counts) > 0), mobile_count=mobile, email_count=email,
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Give up deletions that are to be forgotten, also of companies that no batch names any more."""
        before = self._begin(timerValues.getCurrentProcessingTimeInMs())
        touched = bool(self._changed)
        for chunk in range(1 << self._level if self._level else 0):
            self._chunk(chunk)
            if len(self._read) * CHUNK > HELD:
                self._put()
        self._end(before, touched)
        return iter(())

    def close(self) -> None:
        pass


def changed_flags(changes: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Flags of the companies that a stream of contact changes (with ``at``, a long) changes."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    mode = "None" if forget_ms is None else "ProcessingTime"
    return changes.groupBy(CODE).transformWithState(ContactFlags(forget_ms), FLAGS, "Update", mode)
