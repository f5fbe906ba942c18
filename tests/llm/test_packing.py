"""Packing: every id in one piece, sequences full, costs alike; against the library and a plain version of the rule."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import packing, queries

DATA = "/root/testdata/sf0.001"


def plain(lengths, sequence):
    """The rule, piece by piece: descending, to the cheapest sequence with room for all of it, else with any."""
    room = packing.capacities(sum(lengths), sequence).tolist()
    costs, out = [0.0] * len(room), []
    queue = [(m, d, k * sequence) for d, n in enumerate(lengths) for k in range(-(-n // sequence)) if (m := min(sequence, n - k * sequence))]
    while queue:
        m, d, start = max(queue, key=lambda x: (x[0], -x[1], -x[2]))
        queue.remove((m, d, start))
        fits = [s for s, r in enumerate(room) if r >= m] or [s for s, r in enumerate(room) if r]
        s = min(fits, key=lambda s: (costs[s], s))
        take = min(m, room[s])
        out.append((d, start, take, s))
        room[s] -= take
        costs[s] += packing.cost(take)
        if take < m:
            queue.append((m - take, d, start + take))
    return out


@pytest.mark.parametrize("sequence", [1, 4, 16, 1024])
def test_pieces_by_brute_force(sequence):
    r = random.Random(sequence)
    for _ in range(40):
        lengths = [r.randint(1, r.choice([3, 20, 3 * sequence])) for _ in range(r.randint(1, 40))]
        got = packing.placed(np.array(lengths), sequence)
        assert [x[:4] for x in got] == plain(lengths, sequence)
        offsets = {}
        for _, _, m, s, offset in got:
            assert offset == offsets.get(s, 0)
            offsets[s] = offset + m
        assert [offsets[s] for s in sorted(offsets)] == packing.capacities(sum(lengths), sequence).tolist()


def held(df, pieces, width=1024):
    """Checks the contract of op12 for these documents; returns the pieces."""
    tokenizer = queries.tokenizer()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    got = pieces.toPandas()
    want = sorted((r.doc_id is None, r.doc_id or 0, [*t.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in df.select("doc_id", "text").collect())
    assert got.length.sum() == sum(len(x[2]) for x in want) and (got.length > 0).all()
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        n = own.length.sum()
        assert n == width or n < width and n & (n - 1) == 0
    ids = {(none, d): x for none, d, x in want}
    seen = {}
    for r in got.itertuples():
        key = (r.doc_id != r.doc_id, 0 if r.doc_id != r.doc_id else int(r.doc_id))
        own = ids[key]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        seen.setdefault(key, []).append((r.start, r.start + r.length))
    for key, spans in seen.items():
        many = sum(k[:2] == key for k in want)
        starts = sorted(spans)[::many] if many > 1 else sorted(spans)
        assert starts[0][0] == 0 and starts[-1][1] == len(ids[key]) and all(a[1] == b[0] for a, b in zip(starts, starts[1:]))
    assert set(seen) == set(ids)
    return got


def test_packing_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held(docs, queries.op12_packing(spark, DATA))


def test_packing_odd(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "one two three"), (4, "one two three"), (None, "no id"), (5, "x " * 20_000), (6, "z" * 50_000), (7, "é中\U0001f600\x00")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("start", "length", "ids", "offset", "sequence_id")})
    held(df, packing.packed(df, queries.tokenizer(), block_tokens=3_000))
    assert packing.packed(df.limit(0), queries.tokenizer()).count() == 0
    with pytest.raises(ValueError):
        packing.packed(df, queries.tokenizer(), sequence=1000)


def test_sequences_and_balance(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pieces = packing.packed(docs, queries.tokenizer(), keep_ids=True)
    rows = packing.sequences(pieces).collect()
    assert all(len(r.ids) == 4 * r.length == 4 * sum(r.lengths) for r in rows)
    told = packing.balance(pieces).first()
    assert told.padding == 0 and told.n_sequences == len(rows) and told.n_ids == sum(r.length for r in rows)
    # sequences of rests only, not of one long piece, cost much the same
    costs = [r.cost for r in rows if r.length == 1024 and len(r.lengths) > 1]
    assert np.std(costs) < 0.25 * np.mean(costs)
