"""Near-duplicate groups: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

1. A set's sketch is one permutation split into bins; an empty bin borrows from the first filled bin of its own fixed random
   order (optimal densification). Bands of bins are bucket keys. Equal sets are collapsed first, so a group of copies is one
   node.
2. Every bucket has a centre, the node that meets most others, and its nodes are candidates of that centre: one edge a node and
   bucket, and few nodes have more than two or three distinct centres. Those edges carry the sets, once each, to stars: all
   buckets with one centre. A star above `block` is dealt into blocks that each hold its centre.
3. In a block each node is confirmed against the centre on the full sets. Only the nodes that are not similar to it, the
   outliers, are compared with the others of their block, as one product of sparse rows. What leaves a block is a forest: fewer
   edges than nodes.
4. Outliers of a star of several blocks that are still outside its centre's component meet the blocks they have not seen, as a
   query set against all rows in blocks. Any two nodes that share a bucket are in one star, so no link that a bucket holds is
   lost, and nothing is capped; what grows with the square of anything is the work on one star's outliers alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import LOWER, U64, components, flat, mix, picked, slices, stored, texts_of, word_hashes

BANDS, ROWS = 48, 6
_K1, _K2 = U64(0x9FB21C651E98DF25), U64(0xD1B54A32D192ED03)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's shingles of `words` words; fewer words make one shingle, none make none."""
    hashes, first = word_hashes(LOWER[data], at)
    with np.errstate(over="ignore"):
        joined = hashes.copy()
        for k in range(1, words):
            joined[: len(hashes) - k] = mix(joined[: len(hashes) - k] * _K1 + hashes[k:] * _K2)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                one = U64(b - a)
                for h in hashes[a:b]:
                    one = mix(np.asarray([one * _K2 + h * _K1]))[0]
            out.append(np.asarray([one]))
        else:
            out.append(np.zeros(0, U64))
    return out


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation sketches, a row for each set; rows of empty sets are zero."""
    out, filled = np.zeros((len(sets), bins), np.uint32), np.zeros((len(sets), bins), bool)
    size = np.asarray([len(s) for s in sets])
    if not size.sum():
        return out
    h = mix(np.concatenate(sets) ^ _K2)
    key = (np.repeat(np.arange(len(sets), dtype=np.uint64), size) * U64(bins) + (h >> U64(32)) % U64(bins)) << U64(32) | (h & U64(0xFFFFFFFF))
    key.sort()
    cell = (key >> U64(32)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    out.reshape(-1)[cell[lead]] = key[lead].astype(np.uint32)
    filled.reshape(-1)[cell[lead]] = True
    order = np.argsort(np.random.default_rng(11).random((bins, bins)), axis=1)  # where an empty bin looks
    row, col = np.nonzero(~filled & (size > 0)[:, None])
    values = out.copy()
    for step in range(bins):
        if not len(row):
            break
        source = order[col, step]
        found = filled[row, source]
        values[row[found], col[found]] = out[row[found], source[found]]
        row, col = row[~found], col[~found]
    return values


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _K1, parts.shape[:2]).copy()
        for k in range(rows):
            key = mix(key * _K2 + parts[:, :, k])
    return key.astype(np.int64)


def sketched(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (digests of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(1))
            for lo, hi in slices(at, 1 << 20):
                sets = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], words)
                keys = band_keys(sketches(sets, bands * rows), bands, rows)
                with np.errstate(over="ignore"):
                    a = np.asarray([mix(s ^ _K1).sum(dtype=U64) for s in sets], U64)
                    b = np.asarray([mix(s ^ _K2).sum(dtype=U64) for s in sets], U64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)),
                    pa.ListArray.from_arrays(np.arange(0, bands * (hi - lo) + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1))),
                ], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, digest and shingles (sorted 64-bit hashes, little-endian) from node and the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(1))
            for lo, hi in slices(at, 1 << 20):
                sets = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], words)
                with np.errstate(over="ignore"):
                    digest = np.asarray([mix(s ^ _K1).sum(dtype=U64) for s in sets], U64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(digest.astype(np.int64)), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "digest", "shingles"])

    return texts_of(docs).mapInArrow(run, "node long, digest long, shingles binary")


def _shared(sets: list[np.ndarray], rows: np.ndarray, columns: int = 1024) -> np.ndarray:
    """Sizes of the intersections of the sets `rows` with all sets, by products of their rows over the shingles that two have."""
    every = np.concatenate(sets)
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, which = every[order], which[order]
    lead = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    held = np.diff(np.append(lead, len(every)))
    place = np.repeat(np.cumsum(held > 1) - 1, held)
    often = np.repeat(held > 1, held)
    which, place = which[often], place[often]
    out = np.zeros((len(rows), len(sets)), np.float32)
    for c in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        lo, hi = np.searchsorted(place, (c, c + columns))
        part = np.zeros((len(sets), columns), np.float32)
        part[which[lo:hi], place[lo:hi] - c] = 1
        out += part[rows] @ part.T
    return out.astype(np.int64)


def star_links(nodes: np.ndarray, sets: list[np.ndarray], centre: int | None, percent: int, probes: np.ndarray | None = None, rows: int = 512) -> list[tuple[int, int]]:
    """A forest of the links among some nodes: those of the centre (an index) first, then those of what it does not reach.

    With `probes` (a mask) and no centre, links of the probes with all others.
    """
    size = np.asarray([len(s) for s in sets])
    edges: list[tuple[int, int]] = []
    label = np.arange(len(sets))

    def like(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (both > 0) & (100 * both >= percent * (a + b - both))

    if centre is not None:
        hub = sets[centre]
        every = np.concatenate(sets)
        at = np.minimum(np.searchsorted(hub, every), len(hub) - 1)
        both = np.add.reduceat((hub[at] == every).astype(np.int64), np.cumsum(size) - size)
        near = like(both, size, size[centre])
        near[centre] = True
        label[near] = centre
        edges += [(int(nodes[centre]), int(n)) for n in nodes[near] if n != nodes[centre]]
        probes = ~near
    out = np.flatnonzero(probes)
    for k in range(0, len(out), rows):
        mine = out[k : k + rows]
        found = like(_shared(sets, mine), size[mine][:, None], size[None, :])
        for i, row in zip(mine, found, strict=True):
            there = np.flatnonzero(row)
            for other in np.unique(label[there]):
                if other != label[i]:
                    j = there[label[there] == other][0]
                    edges.append((int(nodes[i]), int(nodes[j])))
                    label[label == other] = label[i]
    return edges


def _linked(blocks: DataFrame, percent: int, probing: bool) -> DataFrame:
    """Links (a, b) in every block of (grp, centre, part, node, shingles, probe); a group holds some whole blocks."""

    def run(table: pa.Table) -> pa.Table:
        nodes, probe = table.column("node").to_numpy(), table.column("probe").to_numpy(zero_copy_only=False)
        key = np.stack([table.column("centre").to_numpy(), table.column("part").to_numpy()])
        order = np.lexsort((nodes, key[1], key[0]))
        key = key[:, order]
        turns = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0)))) if len(order) else np.zeros(0, np.int64)
        data, at = flat(table.column("shingles"))
        data = np.ascontiguousarray(data[at[0] : at[-1]]).view("<u8") if len(order) else data
        at = (at - at[0]) // 8
        edges: list[tuple[int, int]] = []
        for lo, hi in zip(turns, [*turns[1:], len(order)], strict=True):
            rows = order[lo:hi]
            here = nodes[rows]
            hub = None if probing else int(np.flatnonzero(here == key[0, lo])[0])
            edges += star_links(here, [data[at[r] : at[r + 1]] for r in rows], hub, percent, probe[rows] if probing else None)
        pairs = np.asarray(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs.min(1, initial=2**62), "b": pairs.max(1, initial=-(2**62))})

    return blocks.groupBy("grp").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = 1 << 21) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Words are lower-cased (A-Z) runs of non-space bytes. A text with no word (null, empty, blank) has the empty set and is
    alone. Rows with equal sets are one node, and so are rows of one doc_id, whatever their texts; component_id is the smallest
    doc_id of the component. A row with a null doc_id is alone: component null, kept. Other columns are ignored.

    `block` bounds what one task compares: shingles, and five hundred more for each set.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    every = stored(sketched(docs, words, bands, rows), "sketches")
    linked = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["set_a", "set_b", "n_shingles"]
    leaders = linked.groupBy(*same).agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"))
    banded = leaders.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    members = stored(banded.join(shared, "key"), "members")
    # the nodes that meet most others are the likeliest to be similar to them
    degrees = members.groupBy("node").agg(F.sum("held").alias("degree"))
    ranked = members.join(degrees, "node")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("centre"))
    edges = stored(ranked.join(hubs, "key").groupBy("node", "centre").agg(F.max("n").alias("n")), "stars")
    weight = F.col("n") + 500
    stars = edges.groupBy("centre").agg(F.sum(weight).alias("weight")).withColumn("parts", F.ceil(F.col("weight") / block).cast("int"))
    total = stars.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w"), F.max("parts").alias("parts")).first()
    n_groups = max(1, -(-total.w // block))
    several = stored(stars.where("parts > 1").select("centre", "parts"), "several")
    sets = full_sets(picked(docs, edges.select(F.col("node").alias("doc_id")).distinct()).select(F.col("doc_id").alias("node"), "text"), words)
    sets = stored(sets.repartition("node").dropDuplicates(["node", "digest"]).drop("digest"), "sets")

    hub_parts = F.when(F.col("node") == F.col("centre"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    dealt = edges.join(several, "centre", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    group = F.pmod(F.xxhash64("centre", "part"), F.lit(n_groups))
    placed = dealt.select("node", "centre", F.explode(hub_parts).alias("part"), F.lit(False).alias("probe"))
    links = stored(_linked(placed.join(sets, "node").withColumn("grp", group), percent, False), "links")
    # rows of one doc_id that have several sets
    named = linked.select("doc_id", *same).distinct().join(leaders.select(*same, "node"), same).select("doc_id", "node")
    twins = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("c")).where("a < z")
    twins = named.join(twins.select("doc_id", "a"), "doc_id").where("a < node").select("a", F.col("node").alias("b"))
    links = links.unionByName(twins).unionByName(linked.where(F.lit(False)).select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")))
    labels = components(links)
    if (total.parts or 0) > 1:  # stars of several blocks: their outliers against the blocks that they have not met
        mine = labels.select("node", "component")
        hub = labels.select(F.col("node").alias("centre"), F.col("component").alias("hub"))
        wide = edges.join(several, "centre").where("node <> centre").join(mine, "node", "left").join(hub, "centre", "left")
        lost = wide.where(F.coalesce("component", "node") != F.coalesce("hub", "centre")).select("node", "centre", "n", "parts")
        lost = stored(lost, "outliers")
        shares = lost.groupBy("centre").agg(F.ceil(F.sum(weight) / block).cast("int").alias("shares"))
        queries = lost.join(shares, "centre").withColumn("share", F.pmod(F.xxhash64("node", F.lit(1)), F.col("shares")).cast("int"))
        queries = queries.select("node", "centre", "share", F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.pmod(F.xxhash64("node"), F.col("parts")))).alias("p"), F.lit(True).alias("probe"))
        hosts = edges.join(several, "centre").join(shares, "centre").select("node", "centre", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("p"), F.lit(False).alias("probe"))
        blocks = queries.unionByName(hosts).select("node", "centre", (F.col("share").cast("long") * (1 << 24) + F.col("p")).alias("part"), "probe")
        more = stored(_linked(blocks.join(sets, "node").withColumn("grp", F.xxhash64("centre", "part")), percent, True), "more_links")
        labels = components(links.unionByName(more))
    labelled = leaders.select(*same, "node").join(labels, "node", "left").select(*same, F.coalesce("component", "node").alias("root"))
    return (
        every.drop("bands").join(labelled, same, "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2, percent=80)
