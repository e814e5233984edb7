"""Tasks work on views of few rows, whatever the size of the batches they get."""

import pyarrow as pa

from inkgrid.llm import jaccard
from inkgrid.llm.common import sliced


def test_views_hold_all_rows_once_and_in_order():
    schema = pa.schema([("a", pa.int64()), ("b", pa.string())])
    batches = [pa.RecordBatch.from_pydict({"a": list(range(n)), "b": [str(k) for k in range(n)]}, schema=schema) for n in (0, 1, 256, 257, 1000)]
    views = list(sliced(iter(batches)))
    assert max(v.num_rows for v in views) == 256 and min(v.num_rows for v in views) > 0
    assert pa.Table.from_batches(views, schema).equals(pa.Table.from_batches(batches))


def test_group_search_does_not_need_whole_batches(monkeypatch):
    sets = [bytes(8 * k % 251 for k in range(800)) for _ in range(600)]
    columns = {"family": [str(k // 2).encode() for k in range(600)], "c1": [-1] * 600, "b1": [0] * 600, "c2": [-1] * 600, "b2": [0] * 600, "side": [2] * 600, "sig": [str(k).encode() for k in range(600)], "grams": sets}
    batch, most = pa.RecordBatch.from_pydict(columns), []
    monkeypatch.setattr(jaccard, "sliced", lambda batches: (most.append(v.num_rows) or v for v in sliced(batches)))
    found = [r for out in jaccard._search_groups(iter([batch]), 90) for r in out.to_pylist()]
    assert found == [{"a": str(k).encode(), "b": str(k + 1).encode()} for k in range(0, 600, 2)]
    assert max(most) <= 256
