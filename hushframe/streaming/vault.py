"""The vault as keyed streaming state: one state for each scope, which holds the scope's row, its lock and its mappings.

Everything that a request asks of a scope is committed with the micro-batch or not at all: the mappings it puts, the counter, the
one-way lock. Values enter sealed and leave sealed (functions/keyed.py), so neither state nor checkpoint shows them. Time is event
time: deadlines and mappings' lives end by timers when the watermark passes them, and are looked at again wherever state is read, so
that an answer never depends on when a timer fires. A replay from the checkpoint gives the same state.

Events: tenant_id, scope_id, at timestamp, seq long (order within an instant), kind, request_id, entity_type, digest, token,
sealed binary, policy_version; kind is one of
  open     makes the scope, once: active, clean, both deadlines set
  touch    moves the idle deadline, never past the absolute one
  put      a mapping; those of one request at one instant are taken together or refused together
  resolve  the sealed value of a token, if mapping and scope are live
  close    closes the scope, whatever it was; its mappings go at once
Null kinds and others give `unknown_event`; events without a time are left out. A mapping past its life may be put again. Events of a scope in one micro-batch are held together; bound them by the source's limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.vocabulary import LIMITS

SCOPE = "status string, privacy_mode string, mapping_count long, last_active long, idle long, absolute long"
MAPPING = "token string, request_id string, sealed binary, policy_version string, expires long"
OUTPUT = "tenant_id string, scope_id string, at timestamp, seq long, kind string, request_id string, entity_type string, digest string, token string, sealed binary, policy_version string, status string, privacy_mode string, mapping_count long, error_code string"
_EVENT = ("at", "seq", "kind", "request_id", "entity_type", "digest", "token", "sealed", "policy_version")
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _text(value) -> str | None:
    return None if value is None or value != value else value


class VaultState(StatefulProcessor):
    def __init__(self, idle_ms: int, absolute_ms: int, ttl_ms: int, most: int):
        self.idle_ms, self.absolute_ms, self.ttl_ms, self.most = idle_ms, absolute_ms, ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scope = handle.getValueState("scope", SCOPE)
        self.mappings = handle.getMapState("mappings", "entity_type string, digest string", MAPPING)
        self.tokens = handle.getMapState("tokens", "token string", "entity_type string, digest string")

    # ---- state ----
    def _read(self) -> dict | None:
        names = [x.split()[0] for x in SCOPE.split(", ")]
        return dict(zip(names, self.scope.get(), strict=True)) if self.scope.exists() else None

    def _write(self, s: dict) -> None:
        self.scope.update(tuple(s.values()))

    def _forget(self) -> None:
        self.mappings.clear()
        self.tokens.clear()

    @staticmethod
    def _usable(s: dict | None, at: int) -> bool:
        return s is not None and s["status"] == "ACTIVE" and at < min(s["idle"], s["absolute"])

    def _lapse(self, s: dict | None, at: int) -> None:
        """A scope met at or past a deadline is expired, and its mappings go."""
        if s is not None and s["status"] == "ACTIVE" and not self._usable(s, at):
            s["status"] = "EXPIRED"
            self._forget()
            self._write(s)

    # ---- events ----
    def _put(self, s: dict | None, events: list[dict], at: int) -> str | None:
        """All mappings of a request or none. What is held already, and is alive, isn't put again."""
        if s is None:
            return "scope_not_found"
        new = {}
        for e in events:
            key = (e["entity_type"], e["digest"])
            held = self.mappings.getValue(key) if self.mappings.containsKey(key) else None
            if (held is None or held[-1] <= at) and key not in new:
                new[key] = e
        if s["mapping_count"] + len(new) > self.most:
            return "scope_mapping_limit"
        for key, e in new.items():
            self.mappings.updateValue(key, (e["token"], e["request_id"], e["sealed"], e["policy_version"], at + self.ttl_ms))
            self.tokens.updateValue((e["token"],), key)
        s |= {"mapping_count": s["mapping_count"] + len(new), "privacy_mode": "SANITIZED_LOCKED", "last_active": at}
        self._write(s)
        if new:
            self.handle.registerTimer(at + self.ttl_ms)
        return None

    def _resolved(self, s: dict | None, token: str, at: int) -> dict:
        if not self._usable(s, at) or not self.tokens.containsKey((token,)):
            return {}
        key = self.tokens.getValue((token,))
        held = self.mappings.getValue(key) if self.mappings.containsKey(key) else None
        if held is None or held[-1] <= at:
            return {}
        return {"entity_type": key[0], "digest": key[1], "sealed": held[2], "policy_version": held[3]}

    def _one(self, kind: str, events: list[dict], at: int) -> tuple[list[dict], dict | None]:
        """What is said about each event, and the scope after them."""
        s = self._read()
        self._lapse(s, at)
        said: list[dict] = [{} for _ in events]
        if kind == "open" and s is None:
            s = {"status": "ACTIVE", "privacy_mode": "CLEAN", "mapping_count": 0, "last_active": at, "idle": min(at + self.idle_ms, at + self.absolute_ms), "absolute": at + self.absolute_ms}
            self._write(s)
            self.handle.registerTimer(s["idle"])
        elif kind == "touch":
            if s is None or not self._usable(s, at):
                code = "scope_not_found" if s is None else "scope_expired" if s["status"] == "EXPIRED" else "scope_closed"
                said = [{"error_code": code} for _ in events]
            else:
                s |= {"last_active": at, "idle": min(at + self.idle_ms, s["absolute"])}
                self._write(s)
                self.handle.registerTimer(s["idle"])
        elif kind == "put":
            code = self._put(s, events, at)
            said = [{"error_code": code} if code else {} for _ in events]
        elif kind == "resolve":
            said = [self._resolved(s, e["token"], at) for e in events]
        elif kind == "close" and s is not None:
            s["status"] = "CLOSED"
            self._forget()
            self._write(s)
        elif kind not in ("open", "close"):
            said = [{"error_code": "unknown_event"} for _ in events]
        return said, s

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = [dict(zip(_EVENT, row, strict=True)) for batch in rows for row in batch[list(_EVENT)].itertuples(index=False)]
        for e in events:
            e |= {c: _text(e[c]) for c in _EVENT[2:]}
        events.sort(key=lambda e: (e["at"], e["seq"]))
        out = []
        # neighbours of one kind, request and instant are one transaction
        for (at, kind, _), same in groupby(events, lambda e: (e["at"], e["kind"], e["request_id"])):
            same = list(same)
            said, s = self._one(kind, same, at.value // 1_000_000)
            state = {c: s[c] if s else None for c in ("status", "privacy_mode", "mapping_count")}
            for e, more in zip(same, said, strict=True):
                shown = {c: e[c] for c in _EVENT if c != "sealed"}
                out.append({"tenant_id": key[0], "scope_id": key[1], **shown, "sealed": None, "error_code": None, **state, **more})
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Mappings past their life go; a scope at its deadline expires and says so."""
        at, s, out = expiredTimerInfo.getExpiryTimeInMs(), self._read(), []
        for k, held in list(self.mappings.iterator()):
            if held[-1] <= at:
                self.mappings.removeKey(k)
                self.tokens.removeKey((held[0],))
        if s is not None and s["status"] == "ACTIVE" and not self._usable(s, at):
            self._lapse(s, at)
            none = dict.fromkeys((*_EVENT[3:], "error_code"))
            out = [{"tenant_id": key[0], "scope_id": key[1], **none, "at": pd.Timestamp(at, unit="ms"), "seq": -1, "kind": "expired", **{c: s[c] for c in ("status", "privacy_mode", "mapping_count")}}]
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    out["mapping_count"] = out["mapping_count"].astype("Int64")
    return out


def vault_stream(events: DataFrame, idle_seconds: int, absolute_seconds: int, ttl_seconds: int, limits: dict[str, int] = LIMITS, delay: str = "0 seconds") -> DataFrame:
    """A row for each event: the scope after it, error_code, and for resolve the sealed value (null where mapping or scope isn't
    live); and one of kind `expired` where a timer ends a scope. `delay` is how late an event may come."""
    events.sparkSession.conf.set(_STORE, _ROCKS)  # the only store that holds such states
    state = VaultState(idle_seconds * 1000, absolute_seconds * 1000, ttl_seconds * 1000, limits["mappings"])
    rows = events.filter("at is not null").select("tenant_id", "scope_id", *_EVENT).withWatermark("at", delay)
    return rows.groupBy("tenant_id", "scope_id").transformWithStateInPandas(statefulProcessor=state, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
