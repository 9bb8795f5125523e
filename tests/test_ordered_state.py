"""What an ordered stream asks of its state store goes by chunks, not by rows or objects."""

from collections import Counter

import pandas as pd

from palimpsest.streaming.ordered import _Ordered


class Handle:
    """A state store in memory that counts."""

    def __init__(self):
        self.calls, self.values, self.timers = Counter(), {}, []

    def _state(self, name, schema):
        return State(self, name)

    getListState = getValueState = _state

    def listTimers(self):
        self.calls["timers"] += 1
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def exists(self):
        return bool(self.handle.values.get(self.name))

    def get(self):
        return iter(list(self.handle.values.get(self.name, [])))

    def put(self, rows):
        self.handle.calls["written"] += len(rows)
        self.handle.values[self.name] = list(rows)

    def appendList(self, rows):
        self.put([*self.get(), *rows])

    def clear(self):
        self.handle.values.pop(self.name, None)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_is_kept_in_chunks():
    handle, processor = Handle(), _Ordered()
    processor.init(handle)
    n = 3000
    rows = pd.DataFrame({"object_id": [str(k % 100) for k in range(n)], "at": [(n - k) * 1000 for k in range(n)], "tie": range(n), "deleted": [k < 100 and k % 2 == 0 for k in range(n)], "image": [f'{{"v":{k // 100}}}' for k in range(n)]})
    list(processor.handleInputRows((0,), iter([rows[:1000], rows[1000:]]), Watermark(0)))
    assert handle.calls["written"] <= 4 and handle.timers == [2]
    first = pd.concat(processor.handleExpiredTimer((0,), Watermark(n // 2 + 1), None))
    assert len(first) == n // 2 and sorted(handle.timers) == [2, n // 2 + 2]
    handle.timers.remove(2)
    second = pd.concat(processor.handleExpiredTimer((0,), Watermark(n + 1), None))
    changes = pd.concat([first, second])
    assert changes["operation"].value_counts().to_dict() == {"UPDATE": 28 * 100 + 50, "INSERT": 100, "DELETE": 50}
    assert not handle.values.get("waiting") and handle.calls["written"] <= 12
    # Objects that are gone keep nothing.
    late = rows[:100].assign(at=n * 2000, deleted=True)
    list(processor.handleInputRows((0,), iter([late]), Watermark(0)))
    assert len(pd.concat(processor.handleExpiredTimer((0,), Watermark(n * 2 + 1), None))) == 50 and not any(handle.values.values())
