import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import packing
from inkwell.llm.tokens import load_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def fits(lengths, where, offset, fill, capacity):
    bins = defaultdict(list)
    for size, k, at in zip(lengths, where, offset, strict=True):
        bins[k].append((at, size))
    for k, held in bins.items():
        at = 0
        for begin, size in sorted(held):
            assert begin == at
            at += size
        assert at == fill[k] <= capacity
    assert len(bins) == len(fill)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(30, 40))
def test_bins_are_gapless_and_within_capacity(lengths, capacity):
    a = np.array(lengths, np.int64)
    fits(lengths, *packing.best_two_fit(a, capacity), capacity)


def test_two_small_ones_replace_the_smallest():
    # greedy takes 6+3 (gap 1); 2+2 fill the expanded gap of 4
    where, _, fill = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert fill.tolist() == [10, 3] and where[0] == where[2] == where[3] == 0


def test_close_to_the_bound():
    rng = np.random.default_rng(1)
    a = np.minimum(4095, rng.lognormal(6, 1.2, 8000).astype(np.int64) + 1)
    _, _, fill = packing.best_two_fit(a, 4096)
    assert len(fill) <= np.ceil(a.sum() / 4096) * 1.01


def test_pack_documents(spark):
    texts = [None, "", "word " * 300, "a b", "x, y! " * 40, "word " * 300, "z " * 64, "q " * 63]
    df = spark.createDataFrame([(i % 7, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    rows = packing.pack_documents(df, PATH, 64, keep_ids=True).collect()
    ids = [load_tokenizer(PATH).encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    want = sorted((i % 7, k // 64, k, np.array(x[k : k + 64], "<u4").tobytes()) for i, x in enumerate(ids) for k in range(0, len(x), 64))
    assert sorted((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == want
    assert all(r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for begin, size in sorted(held):
            assert begin == at
            at += size
        assert at <= 64
    assert len(bins) <= -(-sum(map(len, ids)) // 64) + 1


def test_many_shards(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "id * 37 % 63 + 1 as length", "id as ids_crc32", "id as nr")
    rows = packing.pack(df, 64, shard_pieces=200).collect()
    assert len(rows) == 3000
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 64 and len(used) <= sum(used.values()) / 64 * 1.02 + 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df, PATH).count() == 0


def test_pieces_that_never_fill_a_bin_end(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "0 as piece", "0L as start", "3000L as length", "id as ids_crc32", "id as nr")
    rows = packing.pack(df, 4096, shard_pieces=2000)
    assert rows.count() == 20_000 == rows.select("sequence_id").distinct().count()
    mixed = spark.range(6000).selectExpr("id as doc_id", "0 as piece", "0L as start", "id * 37 % 50 + 14 as length", "id as ids_crc32", "id as nr")
    rows = packing.pack(mixed, 64, shard_pieces=100).collect()
    assert sorted(r.nr for r in rows) == list(range(6000))
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for begin, size in sorted(held):
            assert begin == at
            at += size
        assert at <= 64
