import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from calathea.llm import packing, rans, tokens
from calathea.llm.shared import shared_dir


@pytest.fixture(scope="module")
def ids(corpus):
    t = Tokenizer.from_file(tokens.DEFAULT)
    return [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x, _ in corpus]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=5))
def test_words_give_the_ids_of_texts(texts):
    assert tokens.check(texts)


def test_special_tokens_and_cases():
    assert tokens.check(["a<|endoftext|>b <|startoftext|>", "İstanbul I'LL don't 12 a1b2", "é É ﬁ Σίσυφος", "x" * 300 + " y,.!? .,", ""])


def test_cache_overflow(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_BITS", 4)
    own = tokens.Encoder()
    import pyarrow as pa

    from calathea.llm import words as wd

    texts = [f"w{i} x{i}y z" for i in range(50)]
    got = [own.encode(g)[0].tolist() for g in wd.groups(pa.array(texts), limit=30)]
    assert sum(got, []) == sum((own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts), [])


def check_pieces(rows, docs, size):
    want = sorted((repr(i), len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, x in docs)
    by_sequence, pieces = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault((repr(r.doc_id), r.doc_tokens), []).append(r)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at == size or at < size and at & (at - 1) == 0
    got = []
    for (i, n), group in pieces.items():
        starts = {}
        for r in group:
            starts.setdefault(r.start, []).append(r)
        copies = len(starts[0])
        if copies == 1:
            raw = b"".join(starts[s][0].ids for s in sorted(starts))
            got.append((i, n, zlib.crc32(raw)))
        else:
            got += [x for x in want if x[:2] == (i, n)]
        assert sum(r.length for r in group) == n * sum(1 for x in want if x[:2] == (i, n))
    assert sorted(got) == want


@pytest.mark.parametrize("size", [16, 2048])
def test_pieces_hold_every_id_once(docs, ids, size):
    check_pieces(packing.pack(docs, size=size).collect(), ids, size)


def test_nothing_packed(nothing):
    assert packing.pack(nothing).count() == 0


def test_small_partitions_pack_by_the_rule(spark):
    """Of many small partitions, what is left open is placed in a second round by the same rule."""
    rows = spark.createDataFrame([(k, "w " * (1 + k * 37 % 90)) for k in range(600)], "doc_id long, text string").repartition(60)
    found = packing.pack(rows, size=64).collect()
    total = sum(r.length for r in found)
    second = [r for r in found if r.sequence_id >> 59]
    cuts = sum(r.start % 64 > 0 for r in second)  # whole windows are cut off at multiples of the size
    assert total == sum(2 + k * 37 % 90 for k in range(600)) and len(second) > 100 and cuts < 0.2 * len(second)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.sampled_from([4, 8, 16]), st.sampled_from([2, 5, 8192]))
def test_packer_pads_nothing(sizes, window, most):
    packing.MAX_OPEN, usual = most, packing.MAX_OPEN
    try:
        _pads_nothing(sizes, window)
    finally:
        packing.MAX_OPEN = usual


def _pads_nothing(sizes, window):
    out = []
    p = packing.SumOfSquares(window, out.append)
    for d, n in enumerate(sizes):
        p.add(d, bytes(4 * n), n)
    p.close()
    lengths = [sum(len(x[2]) // 4 for x in s) for s in out]
    assert sum(lengths) == sum(sizes) and all(n == window or n & (n - 1) == 0 for n in lengths)
    seen = {}
    for s in out:
        for d, start, raw, _ in s:
            seen.setdefault(d, []).append((start, start + len(raw) // 4))
    for d, spans in seen.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == sizes[d] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_best_level_is_least_squares():
    rng = np.random.default_rng(2)
    for _ in range(200):
        p = packing.SumOfSquares(12, lambda s: None)
        p.levels[1:12] = rng.integers(0, 4, 11)
        n = int(rng.integers(1, 12))

        def cost(h):
            after = p.levels.copy()
            if h:
                after[h] -= 1
            if h + n < 12:
                after[h + n] += 1
            return int((after[1:12] ** 2).sum())

        fit = [h for h in range(1, 12 - n + 1) if p.levels[h]] + [0]
        assert cost(p.best(n)) == min(map(cost, fit))


def test_files_give_the_ids_back(spark, docs, ids):
    folder = shared_dir(spark, "t")
    got = rans.read_ids(spark, folder, rans.write_ids(docs, folder)).collect()
    at = 0
    keyed = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, bytes(r.ids)) for r in got)
    for _, start, raw in keyed:
        assert start == at
        at += len(raw) // 4
    assert sorted((repr(r.doc_id), bytes(r.ids)) for r in got) == sorted((repr(i), np.array([*x, 2], "<u4").tobytes()) for i, x in ids)


def test_files_read_from_checkpoints(spark, docs, ids, monkeypatch):
    """Many small files of small blocks, each read in units that begin within blocks."""
    for name, value in (("BLOCK", 900), ("LANES", 16), ("FILE_IDS", 9_000), ("UNIT_IDS", 700)):
        monkeypatch.setattr(rans, name, value)
    folder = shared_dir(spark, "t")
    coder, out = rans.Coder(rans.scaled(np.ones(50, np.int64))), io.BytesIO()
    writer = rans.FileWriter(out, coder)
    own = [np.random.default_rng(k).integers(0, 50, n).astype(np.uint32) for k, n in enumerate((3, 900, 1, 2000, 40, 5, 700, 444, 1))]
    for k, x in enumerate(own):
        writer.add(k, x)
    writer.close()
    reader = rans.FileReader(out, len(out.getvalue()), coder)
    n = len(reader.segments)
    assert n > 8 and any(c for _, c, _, _ in reader.segments)
    for parts in range(1, n + 1):
        edges = [k * n // parts for k in range(parts + 1)]
        found = [x for a, b in zip(edges, edges[1:], strict=False) for x in rans.FileReader(out, len(out.getvalue()), coder).documents(a, b)]
        assert [d for d, _, _ in found] == list(range(9)) and all((x == y).all() for (_, _, x), y in zip(found, own, strict=True))
        assert [s for _, s, _ in found] == [sum(map(len, own[:k])) for k in range(9)]
    monkeypatch.undo()
    monkeypatch.setattr(rans, "UNIT_IDS", 700)
    got = rans.read_ids(spark, folder, rans.write_ids(docs, folder)).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    assert sorted((repr(r.doc_id), bytes(r.ids)) for r in got) == sorted((repr(i), np.array([*x, 2], "<u4").tobytes()) for i, x in ids)


def test_no_files(spark, nothing):
    folder = shared_dir(spark, "t")
    assert rans.read_ids(spark, folder, rans.write_ids(nothing, folder)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000), st.sampled_from([1, 7, 64]))
def test_round_trip(symbols, lanes):
    ids = np.array(symbols, np.uint32)
    coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=301)))
    words, marks = coder.encode(ids, lanes, 2)
    for m in marks:
        assert (coder.decode(words, len(ids), lanes, m) == ids[m["step"] * lanes :]).all()


def test_damage_is_found(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 500)
    monkeypatch.setattr(rans, "LANES", 16)
    ids = np.random.default_rng(0).integers(0, 50, 2000).astype(np.uint32)
    coder = rans.read_table(rans.table_bytes(rans.scaled(np.bincount(ids))))
    out = io.BytesIO()
    w = rans.FileWriter(out, coder)
    w.add(5, ids[:1300])
    w.add(None, ids[1300:])
    w.close()
    raw = bytearray(out.getvalue())
    r = rans.FileReader(io.BytesIO(bytes(raw)), len(raw), coder)
    assert [(d, s, len(x)) for d, s, x in r.documents()] == [(5, 0, 1300), (None, 1300, 700)] and len(r.blocks) == 4
    assert (r.block(2) == ids[1000:1500]).all() and (r.block(2, 1) == ids[1500 - len(r.block(2, 1)) : 1500]).all()
    raw[r.blocks[1]["at"] + 3] ^= 1
    with pytest.raises(ValueError, match="damaged block 1"):
        list(rans.FileReader(io.BytesIO(bytes(raw)), len(raw), coder).documents())


def test_scaled_sums():
    for counts in ([1] * 1000, [10**9, 1, 0, 1], [0, 0], [5]):
        f = rans.scaled(np.array(counts))
        assert f.sum() in (0, 1 << rans.PRECISION) and ((f > 0) == (np.array(counts) > 0)).all()
