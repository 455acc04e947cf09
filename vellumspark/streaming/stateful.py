"""Sessions as streams: seats given in order of arrival, and events of a reading as its answers come.

Both keep a state for each session, so they go on where they were after a restart from the checkpoint, and give the same
rows however the input is cut into micro-batches. Sessions that are not heard of for a time to live are forgotten.

A micro-batch's rows of one session are put in order in its task: bound micro-batches at the source (files or offsets per
trigger). State holds a session's seats (their number is the limit) and, for a reading, what each of its documents has
told; it is one JSON text.

Defined results: rows without a session are a session of their own. An upload without a hash is refused; a hash is a
content whatever its name. Of a session's rows in a micro-batch the order is that of their arrival; between micro-batches
it is that of these. Answers that repeat tell nothing new; answers after a document's end are not told.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import deep
from ..operators.batch import DUPLICATE, FULL, LIMIT

#: How long a session is kept that is not heard of, in milliseconds.
TIME_TO_LIVE = 24 * 3600 * 1000
NO_HASH = "a file without content"
SEATED = "session_id string, arrival long, content_sha256 string, status string, reason string"
EVENTS = "session_id string, number long, kind string, doc_id string, name string, position int, stage string, share double, message string"


def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _kept(state: GroupState, empty: dict) -> dict:
    return json.loads(state.get[0]) if state.exists else empty


def _seats(limit: int, time_to_live: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, rows = _kept(state, {}), []
        part = pd.concat(list(parts)).sort_values(["arrival", "content_sha256"], kind="stable", na_position="last")
        for arrival, content in zip(part["arrival"], part["content_sha256"], strict=True):
            known = None if pd.isna(content) else content
            reason = NO_HASH if known is None else DUPLICATE if known in held else FULL.format(limit) if len(held) >= limit else None
            if reason is None:
                held[known] = int(arrival)
            rows.append((key[0], arrival, known, "refused" if reason else "accepted", reason))
        state.update((json.dumps(held),))
        state.setTimeoutDuration(time_to_live)
        yield pd.DataFrame(rows, columns=_columns(SEATED))

    return run


def triage(uploads: DataFrame, limit: int = LIMIT, time_to_live: int = TIME_TO_LIVE) -> DataFrame:
    """(session_id, arrival, content_sha256, status, reason) for a stream of uploads, as ``batch.triage`` gives them."""
    rows = uploads.select(uploads["session_id"].cast("string").alias("session_id"), uploads["arrival"].cast("long").alias("arrival"), "content_sha256")
    return rows.groupBy("session_id").applyInPandasWithState(_seats(limit, time_to_live), SEATED, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


class _Reading:
    """What a session's documents have told: of each its name, its position and the number of stages, or -1 at its end."""

    def __init__(self, session: str | None, kept: dict, shares: list[tuple[str, float]]) -> None:
        self.session, self.kept, self.shares, self.out = session, kept, shares, []

    def event(self, kind: str, doc: tuple = (None, None, None), stage: str | None = None, share: float | None = None, message: str | None = None) -> None:
        self.out.append((self.session, self.kept["number"], kind, *doc, stage, share, message))
        self.kept["number"] += 1

    def take(self, doc: tuple, stages: set[str], error: str | None) -> None:
        doc_id, docs = doc[0], self.kept["docs"]
        if doc_id not in docs:
            self.event("artigo_inicio", doc)
            docs[doc_id] = [doc[1], doc[2], 0]
        done = docs[doc_id][2]
        if done < 0:
            return
        order = [s for s, _ in self.shares]
        # Stages are told in their order, also if their answers come in another.
        for s in range(done, max((order.index(s) + 1 for s in stages if s in order), default=0)):
            self.event("progresso", doc, *self.shares[s])
            docs[doc_id][2] = s + 1
        if error is not None or docs[doc_id][2] == len(order):
            self.end(doc, error)

    def end(self, doc: tuple, error: str | None) -> None:
        self.event("artigo_fim" if error is None else "artigo_erro", doc, message=error)
        self.kept["docs"][doc[0]][2] = -1
        if error is None:
            self.kept["read"] += 1
        else:
            self.kept["failed"].append(doc[1])

    def close(self) -> None:
        if not self.kept["over"] and sum(d[2] < 0 for d in self.kept["docs"].values()) >= self.kept["total"]:
            self.event("fim", message="; ".join(filter(None, (str(self.kept["read"]), ", ".join(self.kept["failed"])))))
            self.kept["over"] = True


def _reading(stages: tuple[str, ...], silence: int | None, time_to_live: int):
    shares = deep.shares(stages)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reading = _Reading(key[0], _kept(state, {"number": 0, "total": 0, "read": 0, "failed": [], "over": False, "docs": {}}), shares)
        if state.hasTimedOut:
            if silence is None or reading.kept["over"]:
                state.remove()
                return
            for doc_id, (name, position, done) in sorted(reading.kept["docs"].items(), key=lambda x: x[1][1]):
                if done >= 0:
                    reading.end((doc_id, name, position), "no answer")
            # Those that never began are not waited for.
            reading.kept["total"] = len(reading.kept["docs"])
        else:
            part = pd.concat(list(parts)).sort_values(["position", "doc_id"], kind="stable")
            if not reading.kept["number"]:
                reading.kept["total"] = int(part["total"].max())
                reading.event("inicio")
            for (doc_id, name, position), own in part.groupby(["doc_id", "name", "position"], sort=False):
                errors = sorted(e for e in own["error"] if isinstance(e, str))
                reading.take((doc_id, name, int(position)), {s for s in own["stage"] if isinstance(s, str)}, errors[0] if errors else None)
        reading.close()
        state.update((json.dumps(reading.kept),))
        state.setTimeoutDuration(time_to_live if silence is None or reading.kept["over"] else silence)
        yield pd.DataFrame(reading.out, columns=_columns(EVENTS))

    return run


def reading_events(answers: DataFrame, stages: tuple[str, ...] = deep.STAGES, silence: int | None = None, time_to_live: int = TIME_TO_LIVE) -> DataFrame:
    """Events of readings, numbered within their session, for a stream of answers.

    ``answers`` has (session_id, total, doc_id, name, position, stage, error): a row as a document begins (no stage), as it
    has passed a stage, or fails; ``total`` is the number of the session's documents. A session begins with its first row and
    ends as all its documents have. After ``silence`` milliseconds without an answer, those at work end with an error.
    """
    kinds = {"session_id": "string", "total": "int", "doc_id": "string", "name": "string", "position": "int", "stage": "string", "error": "string"}
    rows = answers.select(*(answers[c].cast(k).alias(c) for c, k in kinds.items()))
    return rows.groupBy("session_id").applyInPandasWithState(_reading(stages, silence, time_to_live), EVENTS, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)
