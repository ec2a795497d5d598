"""The clock fold against one step after another, for any order and partitioning of the rows."""

import random

from tidewell.operators import exchange


def stepped(rows):
    state = None
    for _, wall, counter, now in sorted(rows):
        top = max(wall, now, state[0] if state else wall)
        if state and top == state[0]:
            state = (top, (max(state[1], counter) if wall == top else state[1]) + 1)
        else:
            state = (top, counter + 1 if wall == top else 0)
    return state


def test_clock_fold_matches_single_steps(spark, monkeypatch):
    monkeypatch.setattr(exchange, "ORDS", 8)
    rng = random.Random(6)
    rows = [(node, k, rng.randint(0, 5), rng.randint(0, 9), rng.randint(0, 6)) for node in range(60) for k in rng.sample(range(100), rng.choice([1, 2, 7, 60]))]
    rng.shuffle(rows)
    stamps = spark.createDataFrame(rows, "node_id long, ord long, wall long, counter int, now long").repartition(5)
    got = {r.node_id: (r.wall, r.counter) for r in exchange.merged_clocks(stamps).collect()}
    assert got == {n: stepped([r[1:] for r in rows if r[0] == n]) for n in range(60)}
    assert exchange.merged_clocks(stamps.limit(0)).count() == 0
