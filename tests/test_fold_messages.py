"""The fold passes plain rows and asks a state nothing that its content already tells."""

from pyspark.sql import Row

from seqtide.streaming.fold import QuitRisk

IN = Row("entity", "event_id", "ts", "win", "metric")


class Cell:
    """A state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "appendList":
                self.rows += args[0]
            elif name == "put":
                self.rows = list(args[0])
            elif name == "update":
                self.rows = [args[0]]
            elif name == "clear":
                self.rows = []
            elif name == "get":
                return iter(self.rows)
            elif name == "exists":
                return bool(self.rows)

        return call


class Value(Cell):
    def get(self):
        self.calls.append("get")
        return self.rows[0] if self.rows else None


class Handle:
    def __init__(self):
        self.pending, self.state, self.timers = Cell(), Value(), []

    def getListState(self, *_):  # noqa: N802
        return self.pending

    def getValueState(self, *_):  # noqa: N802
        return self.state

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Clock:
    def __init__(self, s):
        self.s = s

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.s * 1000


def test_fold_takes_rows_and_few_messages():
    handle = Handle()
    job = QuitRisk(1000, 5000, 3.0)
    job.init(handle)
    given = [IN(7, 3, 30, 0, 30.0), IN(7, 1, 10, 1, float("nan")), IN(7, 2, 20, 0, None), IN(7, None, 500, 0, 50.0)]
    assert list(job.handleInputRows((7,), iter(given), Clock(0))) == []
    assert handle.pending.calls == ["appendList"] and handle.timers == [10_000]
    out = list(job.handleExpiredTimer((7,), Clock(100), None))
    assert [tuple(r) for r in out] == [(7, 1, 10, 1, 0.0, None, ""), (7, 2, 20, -1, 1.0, None, ""), (7, 3, 30, -2, 3.0, 30.0, "quit risk")]
    assert handle.pending.calls == ["appendList", "get", "put"] and handle.state.calls == ["get", "update"]
    assert [r[1] for r in handle.pending.rows] == [500] and handle.timers == [10_000, 500_000, 1_030_000]
    out = list(job.handleExpiredTimer((7,), Clock(2000), None))
    assert [tuple(r) for r in out] == [(7, None, 500, -3, 4.0, 50.0, "quit risk"), (7, None, 1500, -3, 4.0, 50.0, "quit")]
    assert handle.pending.rows == [] and handle.pending.calls[-2:] == ["get", "clear"]
    assert list(job.handleExpiredTimer((7,), Clock(9000), None)) == [] and handle.state.rows == []
