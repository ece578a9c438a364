"""Clips of many keys in one state: one timer, whatever the number of clips."""

import pandas as pd

from loomcut.streaming.clips import _Clips


class Handle:
    def __init__(self):
        self.timers, self.registered, self.rows = set(), 0, []

    def getListState(self, name, schema):
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def registerTimer(self, t):
        self.timers.add(t)
        self.registered += 1

    def deleteTimer(self, t):
        self.timers.remove(t)

    def listTimers(self):
        return iter(self.timers)


class Times:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_one_timer_for_the_clips_of_all_keys():
    clips, handle = _Clips(10, 2), Handle()
    clips.init(handle)
    rows = [(k, t, float(t)) for k in "ab" for t in (0, 10, 50, 100)] + [("b", 21, 21.0)]
    list(clips.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["key", "ms", "v"])]), Times(None)))
    assert handle.timers == {20} and handle.registered == 1 and len(handle.rows) == 7
    list(clips.handleInputRows((0,), iter([pd.DataFrame([("a", 5, 5.0), ("b", 15, 15.0), ("a", 18, 18.0)], columns=["key", "ms", "v"])]), Times(None)))
    assert handle.timers == {28} and len(handle.rows) == 6
    handle.timers.clear()  # a timer that has gone off is no more
    out = pd.concat(clips.handleExpiredTimer((0,), Times(60), None))
    assert out.drop(columns=["total", "tail"]).values.tolist() == [["a", 0, 18, 4, 0.0], ["a", 50, 50, 1, 50.0], ["b", 0, 21, 4, 0.0], ["b", 50, 50, 1, 50.0]]
    assert handle.timers == {110} and [r[:3] for r in handle.rows] == [("a", 100, 100), ("b", 100, 100)]
    assert len(pd.concat(clips.handleExpiredTimer((0,), Times(110), None))) == 2 and not handle.rows
