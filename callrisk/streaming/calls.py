"""The live call state machine on ``transformWithState``: value and map state, event-time timers.

Every event waits in the map state under its millisecond and is taken by the timer of that millisecond, so
events are taken in event-time order behind the watermark whatever the order and the batches they came in.  A
batch adds its own events and nothing else is rewritten: its cost does not depend on how many events wait.

Between events a call has instants of its own: the end of a 10-second window with scores, a refresh of the
attributes, the expiry of the cached score, the time-out of an abandoned session and the time to forget the
call.  They come in time order too, each before the first event after it; one timer waits for the next.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Rows of the machine.  ``outcome``: OPENED, SCORED, CLOSED or REJECTED for each event; ENDED, REPLACED or
#: TIMED_OUT (a session is over, with its summary), RESCORED (last score of a period), EXPIRED (a cached score
#: is past its time to live) and REFRESHED (an instant of an open session).
OUTPUT = ("call_id long, session_no long, event_id long, ts timestamp, outcome string, agent_id string, started_us long, "
          "customer_sentiment double, risk_score double, n_scores long, final_score double, mean_score double")
FIELDS = [c.split()[0] for c in OUTPUT.split(", ")]
CALL = ("open boolean, session_no long, started_us long, agent_id string, n_scores long, score_sum double, "
        "final_score double, last_us long, cached_us long, cached_score double, tick_us long, window_us long, "
        "w_session array<long>, w_event array<long>, w_score array<double>, w_started array<long>, timer_ms long")
CALL_FIELDS = [c.split()[0] for c in CALL.split(", ")]
WAITING = "us array<long>, event_id array<long>, kind array<string>, agent_id array<string>, sentiment array<double>, score array<double>"
NEW_CALL = dict.fromkeys(CALL_FIELDS) | dict(open=False, session_no=0, started_us=0, n_scores=0, score_sum=0.0, last_us=0)


def at_ms(us: int) -> int:
    """First millisecond that is not before ``us``."""
    return -(-us // 1000)


def timestamp(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


class LiveCalls(StatefulProcessor):
    """Processor of one call's events (columns event_id, us, kind, agent_id, customer_sentiment, risk_score)."""

    def __init__(self, timeout_ms: int, keep_ms: int, period_s: int, min_age_s: int, ttl_s: int | None,
                 refresh_s: int | None):
        self.timeout_us, self.keep_us = timeout_ms * 1000, keep_ms * 1000
        self.period_us, self.min_age_us = period_s * 1_000_000, min_age_s * 1_000_000
        self.ttl_us, self.refresh_us = ttl_s and ttl_s * 1_000_000, refresh_s and refresh_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", CALL)
        self.latest = handle.getValueState("latest", "at long")     # last millisecond with a waiting event
        self.waiting = handle.getMapState("waiting", "at long", WAITING)

    def handleInputRows(self, key, rows, timerValues):
        arrived: dict[int, list] = {}
        for r in rows:
            arrived.setdefault(at_ms(r.us), []).append(
                (r.us, r.event_id, r.kind, r.agent_id, r.customer_sentiment, r.risk_score))
        for at, events in arrived.items():
            before = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else None
            every = [*(zip(*before) if before else ()), *events]
            self.waiting.updateValue((at,), tuple(list(c) for c in zip(*every)))
            self.handle.registerTimer(at)
        known = self.latest.get()[0] if self.latest.exists() else 0
        if max(arrived, default=0) > known:
            self.latest.update((max(arrived),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        st = dict(zip(CALL_FIELDS, self.call.get())) if self.call.exists() else dict(NEW_CALL)
        latest = self.latest.get()[0] if self.latest.exists() else 0
        out, before = [], dict(st)
        if self.waiting.containsKey((now,)):
            events = sorted(zip(*self.waiting.getValue((now,))), key=lambda e: e[:2])
            self.waiting.removeKey((now,))
            for event in events:
                self._instants(st, event[0], out)
                self._take(st, event, out)
        # without a later event the instants up to the watermark are due now, else those up to this one
        last = latest <= now
        until = max(now, timerValues.getCurrentWatermarkInMs()) if last else now
        self._instants(st, until * 1000 + 1, out)
        due = [t for t, _ in self._due(st)]
        idle = last and not st["open"] and st["cached_us"] is None and st["window_us"] is None
        if idle and st["last_us"] + self.keep_us <= until * 1000:
            self.call.clear()
            self.latest.clear()
        else:
            due += [st["last_us"] + self.keep_us] if idle else []
            timer = max(at_ms(min(due)), until + 1) if due else None
            if timer != st["timer_ms"]:
                if st["timer_ms"] is not None and st["timer_ms"] > now and not self.waiting.containsKey((st["timer_ms"],)):
                    self.handle.deleteTimer(st["timer_ms"])
                if timer is not None:
                    self.handle.registerTimer(timer)
                st["timer_ms"] = timer
            if st != before:
                self.call.update(tuple(st[f] for f in CALL_FIELDS))
        for row in out:
            us, number = row.pop("us"), row.get("session_no")
            row.update(call_id=key[0], ts=timestamp(us), started_us=row.get("started_us") if number else None)
            yield Row(*FIELDS)(*[row.get(f) for f in FIELDS])

    def _due(self, st: dict) -> list[tuple[int, str]]:
        """The call's own instants to come; at equal times in this order."""
        out = []
        if st["window_us"] is not None:
            out.append((st["window_us"], "window"))
        if st["open"] and self.refresh_us:
            out.append((st["tick_us"], "refresh"))
        if st["cached_us"] is not None:
            out.append((st["cached_us"] + self.ttl_us, "expiry"))
        if st["open"]:
            out.append((st["last_us"] + self.timeout_us, "timeout"))
        return out

    def _instants(self, st: dict, before_us: int, out: list) -> None:
        """Everything that is due before ``before_us``, in time order."""
        while True:
            due = min(((t, k, what) for k, (t, what) in enumerate(self._due(st))), default=None)
            if due is None or due[0] >= before_us:
                return
            us, _, what = due
            if what == "window":
                for number, event_id, score, started in zip(st["w_session"], st["w_event"], st["w_score"], st["w_started"]):
                    if us - started > self.min_age_us:
                        out.append(dict(session_no=number, event_id=event_id, us=us, outcome="RESCORED", started_us=started,
                                        risk_score=score))
                st.update(window_us=None, w_session=None, w_event=None, w_score=None, w_started=None)
            elif what == "refresh":
                out.append(dict(session_no=st["session_no"], us=us, outcome="REFRESHED", agent_id=st["agent_id"],
                                started_us=st["started_us"]))
                st["tick_us"] += self.refresh_us
            elif what == "expiry":
                out.append(dict(session_no=st["session_no"], us=st["cached_us"], outcome="EXPIRED",
                                risk_score=st["cached_score"], started_us=st["started_us"]))
                st.update(cached_us=None, cached_score=None)
            else:
                out.append(self._summary(st, "TIMED_OUT", None, us))
                st.update(open=False)

    def _take(self, st: dict, event: tuple, out: list) -> None:
        """One event in (time, id) order: new state and rows."""
        us, event_id, kind, agent, sentiment, score = event
        outcome = "REJECTED"
        if kind == "START":
            if st["open"]:
                out.append(self._summary(st, "REPLACED", None, us))
            st.update(open=True, session_no=st["session_no"] + 1, started_us=us, agent_id=agent, n_scores=0, score_sum=0.0,
                      final_score=None, tick_us=us if self.refresh_us else None)
            outcome = "OPENED"
        elif st["open"] and kind == "SEGMENT":
            st.update(n_scores=st["n_scores"] + 1, score_sum=st["score_sum"] + (score or 0.0), final_score=score)
            outcome = "SCORED"
            if self.ttl_us:
                st.update(cached_us=us, cached_score=score)
            self._remember(st, us, event_id, score)
        elif st["open"] and kind == "END":
            outcome = "CLOSED"
        out.append(dict(session_no=st["session_no"], event_id=event_id, us=us, outcome=outcome, agent_id=st["agent_id"],
                        started_us=st["started_us"], customer_sentiment=sentiment,
                        risk_score=score if outcome == "SCORED" else None))
        if outcome == "CLOSED":
            out.append(self._summary(st, "ENDED", event_id, us))
            st.update(open=False)
        st["last_us"] = us

    def _remember(self, st: dict, us: int, event_id: int, score) -> None:
        """The score as the last one of its session in the window; older windows are over by now."""
        end = (us // self.period_us + 1) * self.period_us
        known = zip(st["w_session"], st["w_event"], st["w_score"], st["w_started"]) if st["window_us"] == end else ()
        rows = [r for r in known if r[0] != st["session_no"]] + [(st["session_no"], event_id, score, st["started_us"])]
        columns = [list(c) for c in zip(*rows)]
        st.update(window_us=end, w_session=columns[0], w_event=columns[1], w_score=columns[2], w_started=columns[3])

    @staticmethod
    def _summary(st: dict, outcome: str, event_id, us: int) -> dict:
        return dict(session_no=st["session_no"], event_id=event_id, us=us, outcome=outcome, agent_id=st["agent_id"],
                    started_us=st["started_us"], n_scores=st["n_scores"], final_score=st["final_score"],
                    mean_score=st["score_sum"] / st["n_scores"] if st["n_scores"] else None)

    def close(self) -> None:
        pass


GAUGES = "shard int, ts timestamp, active_calls long, active_agents long"


class LiveGauges(StatefulProcessor):
    """AGG-10 of one shard of agents: open calls and agents with an open call, from the machine's own rows
    that open (+1) and close (-1) sessions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getValueState("calls", "calls long, agents long")
        self.per_agent = handle.getMapState("per_agent", "agent_id string", "calls long")

    def handleInputRows(self, key, rows, timerValues):
        calls, agents = self.calls.get() if self.calls.exists() else (0, 0)
        change: dict = {}
        for r in rows:
            step = 1 if r.outcome == "OPENED" else -1
            calls += step
            if r.agent_id is not None:
                change[r.agent_id] = change.get(r.agent_id, 0) + step
        for agent, step in change.items():
            before = self.per_agent.getValue((agent,))[0] if self.per_agent.containsKey((agent,)) else 0
            agents += (before + step > 0) - (before > 0)
            if before + step:
                self.per_agent.updateValue((agent,), (before + step,))
            elif before:
                self.per_agent.removeKey((agent,))
        self.calls.update((calls, agents))
        yield Row("shard", "ts", "active_calls", "active_agents")(
            key[0], timestamp(timerValues.getCurrentWatermarkInMs() * 1000), calls, agents)

    def close(self) -> None:
        pass
