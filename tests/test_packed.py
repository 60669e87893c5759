"""Packed state of keyed streams: many keys to a group, netted again and again, in small turns."""

import random
from collections import Counter

import pandas as pd

from tidejoin.streaming.keyed import meeting_rows
from tidejoin.streaming.packed import packed_rows


class Held:
    """A list or value state."""

    def __init__(self):
        self.kept = []

    def exists(self):
        return bool(self.kept)

    def get(self):
        return iter(self.kept) if not self.kept or isinstance(self.kept[0][0], bytes) else self.kept[0]

    def appendList(self, rows):  # noqa: N802
        self.kept = self.kept + rows

    def put(self, rows):
        self.kept = list(rows)

    def update(self, row):
        self.kept = [row]

    def clear(self):
        self.kept = []


class Handle:
    def __init__(self):
        self.states = {}

    def getListState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, Held())

    getValueState = getListState  # noqa: N815


def test_rows_stay_netted_and_few_values_are_kept():
    rng, want, handle = random.Random(3), Counter(), Handle()
    for held in (7, 1000):
        rows = packed_rows(sent=5, held=held, values=4)(handle, "x", ["key", "row"])
        for _ in range(300):
            change = Counter()
            for _ in range(rng.randint(1, 6)):
                k = rng.randrange(20)
                change[str(k), f"r{k}"] += rng.choice((-1, 1))
            for k, w in change.items():
                want[k] += w
            rows.append(rows.net([pd.DataFrame([(*k, w) for k, w in change.items()], columns=["key", "row", "w"])]))
            got = Counter()
            for part in rows.read():
                for r in part.itertuples():
                    got[r.key, r.row] += r.w
            assert {k: w for k, w in got.items() if w} == {k: w for k, w in want.items() if w}
            assert len(handle.states["x"].kept) <= 20  # 900 changes came


def test_both_sides_meet_in_turns_as_at_once():
    rng = random.Random(5)
    rows = [(rng.random() < 0.5, str(k := rng.choice((0, 0, rng.randrange(9)))), f"{k}-{rng.randrange(4)}", rng.choice((-1, 1, 2))) for _ in range(400)]
    want = Counter()
    for side, k, a, w in rows:
        for other, k2, b, w2 in rows:
            if side and not other and k == k2:
                want[a, b] += w * w2
    for sent, held, step in ((3, 20, 30), (10_000, 200_000, 400)):
        join, got = meeting_rows(sent, held), Counter()
        join.init(Handle())
        for at in range(0, len(rows), step):
            part = pd.DataFrame(rows[at : at + step], columns=["referring", "key", "row", "w"])
            for out in join.handleInputRows((0, 0), iter([part.iloc[:10], part.iloc[10:]]), None):
                assert len(out) <= sent
                for r in out.itertuples():
                    got[r.referring, r.referred] += r.w
        assert {k: w for k, w in got.items() if w} == {k: w for k, w in want.items() if w}
