"""Adaptive difficulty and session counters as keyed state (OP-D5, OP-X4, OP-X5).

State of a session, kept on disk by the state store:

* blocks of BLOCK questions: for each question the order of its winning write and whether it is correct;
* a tree over the blocks: node (level, index) holds the difficulty tables of its FAN children.  A table
  is the difficulty after the child for each difficulty before it, so composing tables
  along a path of the tree gives the difficulty at any question.

A session whose answers all lie in the first block is one value, read once and written once; its block moves
to the tree when an answer of another block comes.

An answer reads and writes its own block and one node a level.  What is emitted are the answers whose
difficulty changed: an answer at the end changes itself; a late one changes what follows it,
up to the point where old and new difficulty meet again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.sessions import MAX_DIFFICULTY, MIN_DIFFICULTY, START_DIFFICULTY

BLOCK, FAN = 64, 64
#: Sessions of neighbouring ids that are one key of the state.
GROUP = 16
STATES = range(MIN_DIFFICULTY, MAX_DIFFICULTY + 1)
SAME = list(STATES)

KEY = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("node", T.LongType())])
NODE = T.StructType([T.StructField("session", T.StringType()), *KEY.fields])
TEXT = T.StructType([T.StructField("v", T.StringType())])
COLUMNS = {"path": ["question_number", "is_correct", "assigned_difficulty", "next_difficulty"], "counters": ["answered_questions", "correct_answers"]}


def step(state: int, correct: bool) -> int:
    return min(MAX_DIFFICULTY, max(MIN_DIFFICULTY, state + (1 if correct else -1)))


def after(table: list[int], then: list[int]) -> list[int]:
    """First ``table``, then ``then``."""
    return [then[s - MIN_DIFFICULTY] for s in table]


def block_table(answers: dict[str, list]) -> list[int]:
    out = SAME
    for q in sorted(answers, key=int):
        out = [step(s, answers[q][1]) for s in out]
    return out


class SessionAnswers(StatefulProcessor):
    """First write wins by (session, question): ``order_cols`` make the order total.  ``emit``: "path" or "counters"."""

    def __init__(self, order_cols: tuple[str, ...], emit: str, key_col: str = "session_id"):
        self.order_cols, self.emit, self.key_col = order_cols, emit, key_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tree = handle.getMapState("tree", KEY, TEXT)
        self.session = handle.getValueState("session", TEXT)

    def close(self) -> None:
        pass

    # -- nodes of the tree; those of one call are read once and written once

    def _get(self, level: int, node: int) -> dict:
        if (level, node) not in self.held:
            found = self.tree.getValue((level, node)) if self.tree.containsKey((level, node)) else None
            self.held[level, node] = json.loads(found[0]) if found else {}
        return self.held[level, node]

    def _put(self, level: int, node: int, value: dict) -> None:
        self.held[level, node] = value
        self.changed.add((level, node))

    def _compose(self, children: dict, upto: int | None = None) -> list[int]:
        out = SAME
        for c in sorted(map(int, children)):
            if upto is not None and c >= upto:
                break
            out = after(out, children[str(c)])
        return out

    def _entry(self, block: int, levels: int) -> int:
        """Difficulty before the first question of a block."""
        state = START_DIFFICULTY
        for level in range(levels, 0, -1):
            above = block // FAN ** (level - 1)
            state = self._compose(self._get(level, above // FAN), above % FAN)[state - MIN_DIFFICULTY]
        return state

    def _store(self, block: int, answers: dict, levels: int) -> None:
        self._put(0, block, answers)
        table, child = block_table(answers), block
        for level in range(1, levels + 1):
            node = self._get(level, child // FAN)
            self._put(level, child // FAN, {**node, str(child % FAN): table})
            table, child = self._compose(self.held[level, child // FAN]), child // FAN

    def _grow(self, summary: dict, block: int) -> None:
        """Levels enough for ``block``; the tree so far becomes the first child of a new root."""
        summary["last"] = max(summary["last"], block)
        while FAN ** summary["levels"] <= block:
            level = summary["levels"] + 1
            below = self._get(level - 1, 0)
            if below:
                self._put(level, 0, {"0": block_table(below) if level == 1 else self._compose(below)})
            summary["levels"] = level

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's name)
        def answers():
            for part in rows:
                orders = zip(*([_plain(v) for v in part[c]] for c in self.order_cols), strict=True)
                yield from zip(part["question_number"], part["is_correct"], orders, strict=True)
        best: dict[int, list] = {}
        for row in answers():
            _keep_first(best, *row)
        out = self.take(key[0], best)
        if out:
            yield pd.DataFrame(out, columns=[self.key_col, *COLUMNS[self.emit]])

    def take(self, session, best: dict[int, list]) -> list[tuple]:
        """What the first writes of some questions of a session change, as rows of the output."""
        self.held, self.changed = {}, set()
        value = self.session.get()
        known = json.loads(value[0]) if value else {"levels": 0, "last": -1, "answered": 0, "correct": 0, "first": {}}
        inline = known.pop("first", None)
        if inline is not None:  # nothing is in the tree yet
            self.held[0, 0] = inline
        summary, moved = dict(known), {}
        for q, one in sorted(best.items()):
            answers = self._get(0, q // BLOCK)
            old = answers.get(str(q))
            if old is not None and _rank(old[0]) <= _rank(one[0]):
                continue
            summary["answered"] += old is None
            summary["correct"] += bool(one[1]) - bool(old[1] if old else False)
            moved.setdefault(q // BLOCK, {})[str(q)] = one
        if not moved:
            return []
        if self.emit == "counters":
            for block, new in moved.items():
                self._put(0, block, {**self._get(0, block), **new})
            out = [(session, summary["answered"], summary["correct"])]
        else:
            out = self._path(session, summary, moved)
        if inline is not None and set(moved) == {0}:
            summary["first"] = self.held[0, 0]
        else:
            if inline:
                self.changed.add((0, 0))
            for level, node in sorted(self.changed):
                self.tree.updateValue((level, node), (json.dumps(self.held[level, node]),))
        self.session.update((json.dumps(summary),))
        return out

    def _path(self, session, summary: dict, moved: dict[int, dict]) -> list[tuple]:
        before = {b: dict(self._get(0, b)) for b in moved}
        for b in moved:
            self._grow(summary, b)
        levels, out = summary["levels"], []
        # Difficulties before each moved block as they were: later blocks only change through earlier ones.
        for b in sorted(moved):
            self._store(b, {**before[b], **moved[b]}, levels)
        todo = sorted(moved)
        while todo:
            block = todo.pop(0)
            new = old = self._entry(block, levels)  # all before it is unchanged, or old and new met again
            while True:
                answers, was = self._get(0, block), before.get(block, self._get(0, block))
                for q in sorted(answers, key=int):
                    correct, known = answers[q][1], was.get(q)
                    if known is None or known[1] != correct or old != new:
                        out.append((session, int(q), correct, new, step(new, correct)))
                    new, old = step(new, correct), step(old, known[1]) if known else old
                if todo and todo[0] == block:
                    todo.pop(0)
                if old == new:
                    break
                block = self._next(block, summary["last"])
                if block is None:
                    break
                if todo and todo[0] == block:
                    todo.pop(0)
        return out

    def _next(self, block: int, last: int) -> int | None:
        for b in range(block + 1, last + 1):
            if self._get(0, b):
                return b
        return None


class SessionRows(SessionAnswers):
    """The same over plain rows, and GROUP sessions of neighbouring ids as one key: their short sessions are one value,
    so a call to the state store serves all of them.  Nodes of the trees are kept by session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("tree", NODE, TEXT)
        self.group = handle.getValueState("sessions", TEXT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802 (Spark's name)
        best: dict = {}
        for r in rows:
            _keep_first(best.setdefault(r[self.key_col], {}), r["question_number"], r["is_correct"], [_plain(r[c]) for c in self.order_cols])
        value = self.group.get()
        sessions = json.loads(value[0]) if value else {}
        names, changed = [self.key_col, *COLUMNS[self.emit]], False
        for session, answers in best.items():
            self.tree, self.session = _Nodes(self.nodes, str(session)), _Held(sessions, str(session))
            out = self.take(session, answers)
            changed |= bool(out) or self.session.changed
            for x in out:
                yield Row(**dict(zip(names, x, strict=True)))
        if changed:
            self.group.update((json.dumps(sessions),))


class _Nodes:
    """The nodes of one session in a map of many sessions."""

    def __init__(self, nodes, session: str):
        self.nodes, self.session = nodes, session

    def containsKey(self, node: tuple) -> bool:  # noqa: N802 (Spark's name)
        return self.nodes.containsKey((self.session, *node))

    def getValue(self, node: tuple) -> tuple:  # noqa: N802 (Spark's name)
        return self.nodes.getValue((self.session, *node))

    def updateValue(self, node: tuple, value: tuple) -> None:  # noqa: N802 (Spark's name)
        self.nodes.updateValue((self.session, *node), value)


class _Held:
    """The value of one session in the value of its group."""

    def __init__(self, sessions: dict, session: str):
        self.sessions, self.session, self.changed = sessions, session, False

    def get(self) -> tuple | None:
        return (self.sessions[self.session],) if self.session in self.sessions else None

    def update(self, value: tuple) -> None:
        self.sessions[self.session], self.changed = value[0], True


def _keep_first(best: dict[int, list], q, correct, order) -> None:
    one = [list(order), bool(correct) if correct is not None and not pd.isna(correct) else None]
    if int(q) not in best or _rank(one[0]) < _rank(best[int(q)][0]):
        best[int(q)] = one


def _plain(v):
    """A JSON value that orders as the column does."""
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
        return None
    if isinstance(v, pd.Timestamp):
        return v.value
    if isinstance(v, date):
        return v.isoformat()
    return v.item() if hasattr(v, "item") else v if isinstance(v, (int, float, str, bool)) else str(v)


def _rank(order: list) -> list:
    """Nulls first."""
    return [(x is not None, x if x is not None else 0) for x in order]
