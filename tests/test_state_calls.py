"""a key's state costs few calls, and its timer follows from it."""

import pandas as pd

from pagewright.streaming import states


class Handle:
    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, *_):
        return self

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def listTimers(self):
        self.calls.append("list")
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_timers_are_not_asked_for():
    handle, runs = Handle(), states._Runs(1_000_000)
    runs.init(handle)
    for second in (1, 2):
        rows = pd.DataFrame({"at": pd.to_datetime([second], unit="s"), "number": [second], "found": [1], "finished": [0]})
        assert list(runs.handleInputRows((7,), iter([rows]), None)) == []
    assert handle.timers == {3_001} and handle.calls == []
