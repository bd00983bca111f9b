import random

import pyarrow as pa

from duelframe.operators import graphs
from duelframe.operators.graphs import connected


def test_a_task_hands_on_a_row_a_node(monkeypatch):
    """However many edges it reads, and gathered in pieces."""
    monkeypatch.setattr(graphs, "GATHERED", 50)
    draw = random.Random(5)
    edges = [(f"{g}-{draw.randrange(20)}", f"{g}-{draw.randrange(20)}") for _ in range(2000) for g in "ab"]
    batches = [pa.RecordBatch.from_pydict({"u": [a for a, _ in edges[k:k + 90]], "v": [b for _, b in edges[k:k + 90]]}) for k in range(0, len(edges), 90)]
    rows = pa.Table.from_batches(list(graphs._stars(batches))).to_pylist()
    assert len(rows) == 40 and {r["u"] for r in rows} == {x for e in edges for x in e}
    assert len({r["v"] for r in rows}) == 2 and all(r["u"][0] == r["v"][0] for r in rows)


def test_chains_hubs_and_pairs(spark):
    edges = [(f"c{k:03}", f"c{k + 1:03}") for k in range(60)] + [("hub", f"leaf{k}") for k in range(50)] + [("z", "y"), ("y", "z"), ("s", "s"), (None, "q"), ("q", None)]
    random.Random(1).shuffle(edges)
    found = dict(map(tuple, connected(spark.createDataFrame(edges, "a string, b string")).collect()))
    assert {found[f"c{k:03}"] for k in range(61)} == {"c000"} and found["hub"] == found["leaf7"] == "hub"
    assert found["z"] == found["y"] == "y" and found["s"] == "s" and "q" not in found and len(found) == 61 + 51 + 3
    assert connected(spark.createDataFrame([], "a string, b string")).count() == 0
