"""Loops that run until all is found."""

from quirelight.operators import relational as op


def test_inherited_over_deep_chains_and_cycles(spark):
    rows = [(0, None, "top")] + [(i, i - 1, "mid" if i == 60 else None) for i in range(1, 230)] + [(500, 501, None), (501, 500, None), (502, 999, None)]
    got = {r["id"]: r["inherited"] for r in op.inherited(spark.createDataFrame(rows, "id long, up long, v string"), "id", "up", "v").collect()}
    assert got == {i: None if i >= 500 else "top" if i < 60 else "mid" for i, _, _ in rows}


def test_closure_ends_when_the_frontier_is_empty(monkeypatch):
    class Table:
        rounds = 0

        def isEmpty(self):
            self.rounds += 1
            return self.rounds > 10_050

        def __getattr__(self, name):
            return lambda *_, **__: self

    table = Table()
    monkeypatch.setattr(op, "stage", lambda df, name: df)
    monkeypatch.setattr(op, "F", table)
    op.closure(table, table)
    assert table.rounds == 10_051
