"""Keyed difficulty state against the sequential fold: late answers, rewritten ones, sessions over many blocks."""

import random

import pandas as pd
import pytest

from quarry.streaming import difficulty as d


class Held:
    def __init__(self):
        self.m, self.v = {}, None

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValueState(self, *_):  # noqa: N802
        return Session(self)

    def containsKey(self, k):  # noqa: N802
        return k in self.m

    def getValue(self, k):  # noqa: N802
        return self.m[k]

    def updateValue(self, k, v):  # noqa: N802
        self.m[k] = v


class Session:
    def __init__(self, held):
        self.held = held

    def exists(self):
        return self.held.v is not None

    def get(self):
        return self.held.v

    def update(self, v):
        self.held.v = v


def fold(answers):
    """{question: (order, correct)} -> {question: (correct, before, after)}"""
    state, out = 3, {}
    for q in sorted(answers):
        then = min(5, max(1, state + (1 if answers[q][1] else -1)))
        out[q] = (answers[q][1], state, then)
        state = then
    return out


@pytest.mark.parametrize("block, fan", [(4, 3), (64, 64)])
def test_path_equals_fold_after_every_batch(monkeypatch, block, fan):
    monkeypatch.setattr(d, "BLOCK", block)
    monkeypatch.setattr(d, "FAN", fan)
    for seed in range(30):
        r = random.Random(seed)
        p, sink, known, changed = d.SessionAnswers(("at", "tie"), "path"), {}, {}, []
        p.init(Held())
        for _ in range(r.randint(1, 9)):
            rows = [(r.randint(1, 150), r.random() < 0.5, r.choice([None, r.randint(0, 9)]), r.randint(0, 10 ** 6)) for _ in range(r.randint(1, 25))]
            for q, ok, at, tie in rows:
                order = ((at is not None, at or 0), tie)
                if q not in known or order < known[q][0]:
                    known[q] = (order, ok)
            frame = pd.DataFrame(rows, columns=["question_number", "is_correct", "at", "tie"])
            frame["at"] = frame["at"].astype("Int64").astype(object).where(frame["at"].notna(), None)
            before = dict(sink)
            for out in p.handleInputRows((1,), iter([frame.iloc[:10], frame.iloc[10:]]), None):
                for _, q, ok, a, b in out.itertuples(index=False):
                    sink[q] = (ok, a, b)
                    changed.append(before.get(q) != (ok, a, b))
            assert sink == fold(known)
        assert all(changed)  # only what changed is emitted


def test_counters():
    p, known = d.SessionAnswers(("at",), "counters"), {}
    p.init(Held())
    r = random.Random(2)
    for _ in range(20):
        rows = [(r.randint(1, 300), r.random() < 0.5, r.randint(0, 10 ** 6)) for _ in range(15)]
        for q, ok, at in rows:
            if q not in known or at < known[q][0]:
                known[q] = (at, ok)
        out = pd.concat(p.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["question_number", "is_correct", "at"])]), None))
        assert tuple(out.iloc[-1]) == (1, len(known), sum(ok for _, ok in known.values()))


def test_replay_of_seen_answers_emits_nothing():
    p = d.SessionAnswers(("at",), "path")
    p.init(Held())
    frame = pd.DataFrame([(1, True, 5), (2, False, 6)], columns=["question_number", "is_correct", "at"])
    assert len(list(p.handleInputRows((1,), iter([frame]), None))) == 1
    assert list(p.handleInputRows((1,), iter([frame]), None)) == []


class Counted(Held):
    calls = 0

    def __getattribute__(self, name):
        if name in ("containsKey", "getValue", "updateValue"):
            Counted.calls += 1
        return super().__getattribute__(name)


@pytest.mark.parametrize("emit", ["path", "counters"])
def test_a_short_session_is_one_value(emit):
    held = Counted()
    p = d.SessionRows(("at",), emit)
    p.init(held)
    rows = [d.Row(session_id=s, question_number=q, is_correct=q % 2 == 0, at=q) for q in (1, 2, 5) for s in (1, 2)]
    assert len(list(p.handleInputRows((0,), iter(rows), None))) == (6 if emit == "path" else 2)
    assert list(p.handleInputRows((0,), iter(rows), None)) == []
    assert Counted.calls == 0 and held.m == {}
    new = d.Row(session_id=2, question_number=d.BLOCK * 3, is_correct=True, at=9)  # outgrows its value
    late = list(p.handleInputRows((0,), iter([new]), None))
    assert late[-1].session_id == 2 and (late[-1].answered_questions == 4 if emit == "counters" else late[-1].question_number == d.BLOCK * 3)
    assert ("2", 0, 0) in held.m and not any(k[0] == "1" for k in held.m)
    assert list(p.handleInputRows((0,), iter(rows), None)) == []
    Counted.calls = 0
