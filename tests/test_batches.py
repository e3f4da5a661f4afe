"""Pieces of Arrow batches: bounded by bytes and rows, with nothing lost."""

import pyarrow as pa

from weftlake.functions.batches import BYTES, ROWS, pieces


def test_pieces():
    def batch(texts):
        return pa.RecordBatch.from_pydict({"x": pa.array(texts, pa.string())})

    texts = [["a" * 20_000] * 1000, ["b"] * 1000, [], ["c" * 3_000_000, None, "d" * 3_000_000]]
    got = list(pieces(map(batch, texts)))
    assert [v for b in got for v in b.column("x").to_pylist()] == sum(texts, [])
    assert max(b.num_rows for b in got) == ROWS and max(b.nbytes for b in got if b.num_rows > 1) <= BYTES * 1.1
    assert len(got) == 11 + 4 + 3
