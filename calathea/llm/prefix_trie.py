"""A trie of conversations that share first turns, with what each node's subtree saves.

Every conversation c is rebuilt: the first h turns of conversation c - c % 100, then its own turns after its first h,
h = crc32(decimal c) % 6. A turn becomes a 128-bit digest of role and text, a conversation the sequence of these.
Conversations with equal sequences are one path with a weight. Paths are dealt to buckets by their first turn's digest;
a first turn whose paths have more than TURNS turns is dealt anew by more turns (1, 2, 4, ...), until none is. Each
bucket builds a trie of pointer dictionaries in one task and sums its subtrees in postorder, children before parents,
without recursion. The nodes above the dealt subtries (the root, and those of crowded first turns) are aggregates, and
take the totals of the subtries below them. Ids of conversations that end at a node are sorted in ranges, joined to
pieces there, and the pieces of one node stream through one hash, so that no list of ids is ever held.

Defined results: rows without a conv_id take no part; turns go by number, null first, and equal numbers by the digest;
repeated rows are turns of their own; null roles and texts are empty; a conversation that is left without turns counts
at the root alone; an empty table has no nodes. What is held whole is one conversation's sequence, some 60 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, cut

TURNS, BUCKET, WIDTH = 200_000, 20_000, 32
_NODES = "conv_id long, depth long, parent_conv_id long, above string, n_convs long, n_children long, n_leaves long, saved_tokens long, end_of long"


def _first(path: str | Column, turns: Column) -> Column:
    """The path of the first turns."""
    return F.left(path, turns.cast("int") * WIDTH)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, lens): each conversation with its turns' digests in one string and the code points of their texts."""
    role, text = (F.coalesce(column(conversations, c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = column(conversations, "turn")
    rows = conversations.select(column(conversations, "conv_id").cast("long").alias("conv_id"), F.struct(F.isnotnull(turn), turn.alias("turn"), F.left(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(WIDTH)).alias("digest"), F.char_length(text).cast("long").alias("len")).alias("t"))
    own = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    own = cut(own.select("conv_id", F.array_join("t.digest", "").alias("path"), F.col("t.len").alias("lens")), "turns")
    donors = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("donor"), _first("path", F.lit(5)).alias("donor_path"), F.slice("lens", 1, 5).alias("donor_lens"))
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % 6).cast("int")
    both = own.withColumn("donor", c - c % 100).join(donors, "donor", "left")
    path = F.concat(F.coalesce(_first("donor_path", h), F.lit("")), F.substring("path", h * WIDTH + 1, F.length("path")))
    lens = F.concat(F.coalesce(F.slice("donor_lens", F.lit(1), h), F.array().cast("array<long>")), F.slice("lens", h + 1, F.size("lens")))
    return both.select("conv_id", path.alias("path"), lens.alias("lens"))


def _trie(rows: pd.DataFrame) -> pd.DataFrame:
    """The subtries of a bucket: each path enters at the node of its first k turns."""
    child: dict[tuple[int, str], int] = {}
    depth, parent, above, least, count, length, end = ([] for _ in range(7))
    for rep, n, k, path, lens in zip(rows.rep.tolist(), rows.n.tolist(), rows.k.tolist(), rows.path, rows.lens, strict=True):
        at, start = -1, 0
        for d in range(k, len(lens) + 1):
            key = (at, path[start : d * WIDTH])
            node = child.get(key)
            if node is None:
                node = child[key] = len(depth)
                depth.append(d)
                parent.append(at)
                above.append(path[: (d - 1) * WIDTH] if at < 0 else None)
                least.append(rep)
                count.append(n)
                length.append(int(lens[d - 1]))
                end.append(None)
            else:
                least[node] = min(least[node], rep)
                count[node] += n
            at, start = node, d * WIDTH
        end[at] = rep
    kids, leaves, saved = [0] * len(depth), [0] * len(depth), [(n - 1) * x for n, x in zip(count, length, strict=True)]
    for node in range(len(depth) - 1, -1, -1):  # nodes follow their parents: backwards is a postorder
        leaves[node] = leaves[node] or 1
        if (up := parent[node]) >= 0:
            kids[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    up = pd.array([None if p < 0 else least[p] for p in parent], dtype="Int64")
    return pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": up, "above": pd.Series(above, dtype=object), "n_convs": count, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "end_of": pd.array(end, dtype="Int64")})


def _dealt(paths: DataFrame) -> DataFrame:
    """Paths with k: the number of first turns by which they are dealt, so that few have over TURNS turns in common."""
    settled, todo, k = [], paths, 1
    while True:
        keyed = todo.withColumn("key", _first("path", F.lit(k)))
        crowded = keyed.where(F.size("lens") >= k).groupBy("key").agg(F.sum(F.size("lens")).alias("turns"), F.count("*").alias("m"))
        crowded = cut(crowded.where((F.col("turns") > TURNS) & (F.col("m") > 1)).select("key", F.lit(True).alias("crowded")), "crowded")
        if crowded.isEmpty():
            return _union([*settled, todo.withColumn("k", F.lit(k))])
        marked = cut(keyed.join(crowded, "key", "left"), "dealt")
        settled.append(marked.where("crowded is null").select(*paths.columns, F.lit(k).alias("k")))
        todo, k = marked.where("crowded").select(paths.columns), 2 * k


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _upper(paths: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes above the dealt subtries, whose tops have (above, n_leaves, saved_tokens), and (prefix, up): their conv_ids."""
    size = F.size("lens")
    steps = paths.select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("k") - 1, size))).alias("d"))
    n = F.coalesce(F.get("lens", F.col("d") - 1), F.lit(0))
    upper = steps.select(_first("path", F.col("d")).alias("prefix"), "d", "n", "rep", n.alias("len"), F.when(size == F.col("d"), F.col("rep")).alias("end_of"))
    upper = cut(upper.groupBy("prefix", "d").agg(F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id"), F.max("len").alias("len"), F.min("end_of").alias("end_of")), "upper")
    names = upper.select("prefix", F.col("conv_id").alias("up"))
    below = tops.groupBy(F.col("above").alias("prefix")).agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    parent = F.when(F.col("d") > 0, _first("prefix", F.col("d") - 1))
    kids = upper.where("d > 0").groupBy(parent.alias("prefix")).agg(F.count("*").alias("kids"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = upper.join(below, "prefix", "left").join(kids, "prefix", "left").withColumn("n_children", zero("tops") + zero("kids"))
    own = cut(own.withColumn("leaves", zero("leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", zero("saved") + (F.col("n_convs") - 1) * F.col("len")), "upper-own")
    shares = own.select(F.explode(F.sequence(F.lit(0), "d")).alias("j"), "prefix", "leaves", "saved").select(_first("prefix", F.col("j")).alias("prefix"), "leaves", "saved")
    totals = shares.groupBy("prefix").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    nodes = own.join(totals, "prefix").withColumn("above", parent)
    nodes = nodes.join(names.withColumnRenamed("prefix", "above"), "above", "left")
    return nodes.select("conv_id", F.col("d").cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "end_of"), names


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a batch in pieces: one for each run of a signature."""
    for batch in batches:
        if batch.num_rows:
            sig, ids = batch.column(0), batch.column(1).to_pylist()
            code = sig.dictionary_encode().indices.to_numpy()
            at = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(ids)]
            spans = list(zip(at[:-1], at[1:], strict=True))
            yield pa.record_batch([sig.take(pa.array(at[:-1])), pa.array([ids[a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in spans])], names=["sig", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a signature in order, one after the other through a hash."""
    now, least, state = None, 0, None
    for batch in batches:
        rows = []
        for sig, first, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sig == now:
                state.update(b"," + ids.encode())
                continue
            if now is not None:
                rows.append((least, state.hexdigest()))
            now, least, state = sig, first, hashlib.sha256(ids.encode())
        yield _ended(rows)
    if now is not None:
        yield _ended([(least, state.hexdigest())])


def _ended(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["end_of", "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """(end_of, ends_sha256) of the conversations of each sequence, end_of the smallest."""
    ordered = rows.select("sig", "conv_id").repartitionByRange("sig", "conv_id").sortWithinPartitions("sig", "conv_id")
    pieces = ordered.mapInArrow(_pieces, "sig binary, first long, ids string")
    return pieces.repartition("sig").sortWithinPartitions("sig", "first").mapInArrow(_digests, "end_of long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node."""
    convs = cut(rebuilt(conversations).withColumn("sig", F.unhex(F.sha2("path", 256))), "rebuilt")
    alike = convs.groupBy("sig").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).select("conv_id", "n")
    paths = cut(convs.join(alike, "conv_id").select(F.col("conv_id").alias("rep"), "n", "path", "lens"), "paths")
    paths = _dealt(paths)
    turns = paths.agg(F.sum(F.size("lens"))).first()[0] or 0
    buckets = max(paths.sparkSession.sparkContext.defaultParallelism, -(-turns // BUCKET))
    low = paths.where(F.size("lens") >= F.col("k"))
    # rows come with their bucket in front
    low = low.groupBy(F.pmod(F.xxhash64(_first("path", F.col("k"))), F.lit(buckets)).alias("bucket"))
    tries = cut(low.applyInPandas(_trie, _NODES), "tries")
    tops = tries.where("above is not null")
    upper, names = _upper(paths, tops)
    root = names.where("prefix = ''").first()
    # most tops hang on the root, whose id is one number; the others look theirs up
    known = tops.where("above = ''").withColumn("parent_conv_id", F.lit(root.up if root else None).cast("long"))
    asked = tops.where("above <> ''").drop("parent_conv_id").join(names, F.col("above") == F.col("prefix")).withColumnRenamed("up", "parent_conv_id")
    nodes = [tries.where("above is null"), known, asked, upper]
    nodes = cut(_union([x.select(upper.columns) for x in nodes]), "nodes")
    ended = nodes.where("end_of is not null").join(_ends(convs), "end_of")
    rest = nodes.where("end_of is null").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return ended.unionByName(rest).drop("end_of")
