import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.llm import bitslices


def brute(ids, rows, query, own, k):
    scores = [(-int(np.dot(r, query)), int(i)) for i, r in zip(ids, rows, strict=True) if i != own]
    return [(i, -s) for s, i in sorted(scores)[:k]]


@pytest.mark.parametrize("skip", [0, 2, 5])
@pytest.mark.parametrize(("n", "scale"), [(1, 50), (64, 1), (300, 130), (700, 3000)])
def test_block_is_exact(skip, n, scale):
    rng = np.random.default_rng(n)
    rows = rng.normal(0, scale, (n, 9)).astype(np.int64)
    rows[n // 2 :: 3] = rows[0]
    ids = rng.permutation(n * 3)[:n]
    block = bitslices.SliceBlock(ids, rows, skip)
    for j in range(0, n, max(1, n // 20)):
        got = block.top(rows[j], 5, int(ids[j]))
        assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == brute(ids, rows, rows[j], ids[j], 5)
    assert list(zip(*[x.tolist() for x in block.top(np.zeros(9, np.int64), 5, -1)], strict=True)) == brute(ids, rows, np.zeros(9, np.int64), -1, 5)


def test_blocks_are_stored_and_read():
    rng = np.random.default_rng(7)
    for n, scale in ((1, 5), (130, 400), (70, 10**6)):
        rows, ids = rng.normal(0, scale, (n, 5)).astype(np.int64), rng.permutation(n)
        block = bitslices.SliceBlock(ids, rows)
        back = bitslices.SliceBlock.from_bytes(block.to_bytes())
        assert (back.stack == block.stack).all() and (back.rows == block.rows).all()
        assert [x.tolist() for x in back.top(rows[0], 3, 0)] == [x.tolist() for x in block.top(rows[0], 3, 0)]


def test_table_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(bitslices, "BLOCK_ROWS", 40)
    monkeypatch.setattr(bitslices, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(bitslices, "PACK", 2)
    monkeypatch.setattr(bitslices, "MERGED", 2)
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(0, 0.1, 6)], "x") for i in range(150)]
    data += [(150 + i, [0.1] * 6, "same") for i in range(60)]
    odd = [(300, None, ""), (302, [float("nan")] * 6, ""), (303, [0.1, None], ""), (304, [float("inf")] * 6, ""), (None, [0.1] * 6, "")]
    short = [(305, [0.5, -0.25], ""), (301, [], "")]
    df = spark.createDataFrame([*data, *odd, *short], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in bitslices.top_k(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    use = [(i, v + [0.0] * (6 - len(v))) for i, v, _ in [*data, *short]]
    ids = [i for i, _ in use]
    rows = bitslices.quantise(np.array([v for _, v in use], np.float32))
    assert set(got) == {0, 50, 100, 150, 200}
    for q, found in got.items():
        want = brute(ids, rows, rows[ids.index(q)], q, 5)
        assert [(i, s) for _, i, s in sorted(found)] == want and [r for r, *_ in sorted(found)] == [1, 2, 3, 4, 5]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in bitslices.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert bitslices.top_k(df, F.lit(False)).count() == 0 and bitslices.top_k(df.limit(0), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]
