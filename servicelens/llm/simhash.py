"""SimHash near-duplicates through vantage-point shards.

1. Every text becomes a 64-bit fingerprint (majority bits of the XXH64 of its word
   shingles); equal fingerprints are merged before anything is compared.
2. A vantage-point tree is built on a bounded sample of the distinct fingerprints.  A node
   keeps a fingerprint ``v`` and a distance ``mu``: the inner shard takes all at distance
   <= mu, the outer shard all beyond.  Whatever lies in the band (mu, mu + radius] also
   visits the inner shard as a guest.  By the triangle inequality two fingerprints
   within ``radius`` then meet in at least one leaf, whatever the sample was: the sample only
   decides how even the shards are.
3. A leaf searches its own rows exactly, again by vantage points while it is large, and
   returns at most one link per member (to a representative), never all pairs.
4. Links of all leaves are joined into components on the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, hash_sample, own, scratch_table

#: Most fingerprints that the driver sees to lay out the shards.
SAMPLE_LIMIT = 32_768
#: Wanted fingerprints in a leaf shard.
LEAF_TARGET = 2_000
_BRUTE = 1_024


def simhash(text: str | None, shingle: int, seed: int = 42) -> int:
    """64-bit SimHash of a text, as an unsigned integer; no words: 0."""
    words = (text or "").encode().lower().split()  # both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    first = (ends - size)[: len(words) - k + 1].tolist()
    last = ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(first, last)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        bits = np.unpackbits(h[i:i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(texts: pa.Array, shingle: int) -> pa.Array:
    """Fingerprints as longs; 256 texts at a time are Python objects."""
    found = [np.array([simhash(t, shingle) for t in texts.slice(i, 256).to_pylist()], np.uint64) for i in range(0, len(texts), 256)]
    return pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))


def with_fingerprint(docs: DataFrame, shingle: int, text: str = "text", out: str = "__fp") -> DataFrame:
    """Add the fingerprint of ``text`` as a long (the unsigned bits, reinterpreted)."""
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return fingerprints(texts, shingle)

    return docs.withColumn(out, fingerprint(F.col(text).cast("string")))


def _distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, leaves: int, radius: int) -> list[tuple]:
    """Nodes ``(vantage, mu, inner, outer)``; a child < 0 is leaf ``-child - 1``.

    The vantage point and cut of a node are the ones, among 24 points of its sample, that send
    the fewest guests for an even split."""
    nodes: list[tuple] = []
    least = max(8, len(sample) // max(1, leaves))
    n_leaves = 0

    def grow(part: np.ndarray) -> int:
        nonlocal n_leaves
        best = None
        if len(part) >= 2 * least:
            for v in part[:: max(1, len(part) // 24)][:24]:
                d = _distance(part, v)
                below = np.cumsum(np.bincount(d, minlength=65)[:65])
                beyond = len(part) - below
                guests = below[np.minimum(np.arange(65) + radius, 64)] - below
                # rows of the two children, and how much of the node the larger one still holds
                larger = np.maximum(below + guests, beyond)
                ok = (below > 0) & (beyond > 0) & (larger <= 0.85 * len(part))
                if ok.any():
                    price = np.where(ok, (len(part) + guests) / len(part) / -np.log2(larger / len(part) + 1e-9).clip(0.05), np.inf)
                    mu = int(price.argmin())
                    if best is None or price[mu] < best[0]:
                        best = (price[mu], v, mu, d)
        if best is None:
            n_leaves += 1
            return -n_leaves
        _, v, mu, d = best
        at = len(nodes)
        nodes.append(())
        inner, outer = grow(part[d <= mu + radius]), grow(part[d > mu])
        nodes[at] = (int(v), mu, inner, outer)
        return at

    grow(sample)
    return nodes


def route(fingerprints: np.ndarray, nodes: list[tuple], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf number and row number of every visit of every fingerprint."""
    leaf, row = [], []
    todo = [(0 if nodes else -1, np.arange(len(fingerprints)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            leaf.append(np.full(len(rows), -at - 1, np.int32))
            row.append(rows)
            continue
        v, mu, inner, outer = nodes[at]
        d = _distance(fingerprints[rows], np.uint64(v))
        todo += [(inner, rows[d <= mu + radius]), (outer, rows[d > mu])]
    return (np.concatenate(leaf), np.concatenate(row)) if row else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _brute_links(part: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(member, representative) links that join exactly the components of ``part``."""
    linked = np.zeros(len(part), bool)
    for i in range(0, len(part), 128):
        near = np.bitwise_count(part[i:i + 128, None] ^ part[None, :]) <= radius
        linked[i:i + 128] = near.sum(axis=1) > 1
    rest, out = part[linked], []
    while len(rest):
        frontier, rest, group = rest[:1], rest[1:], [rest[:1]]
        while len(frontier) and len(rest):
            hit = np.zeros(len(rest), bool)
            for i in range(0, len(frontier), 128):
                hit |= (np.bitwise_count(frontier[i:i + 128, None] ^ rest[None, :]) <= radius).any(axis=0)
            frontier, rest = rest[hit], rest[~hit]
            group.append(frontier)
        members = np.concatenate(group).view(np.int64)
        if len(members) > 1:
            root = members.min()
            members = members[members != root]
            out.append((members, np.full(len(members), root)))
    return out


def leaf_links(fingerprints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join every two fingerprints of a shard within ``radius`` (distinct input)."""
    out, todo = [], [fingerprints]
    while todo:
        part = todo.pop()
        if len(part) > _BRUTE:
            best = None
            for v in part[:: len(part) // 8][:8]:
                d = _distance(part, v)
                mu = int(np.median(d))
                larger = max(int((d <= mu + radius).sum()), int((d > mu).sum()))
                if best is None or larger < best[0]:
                    best = (larger, mu, d)
            larger, mu, d = best
            if larger <= 0.85 * len(part):
                todo += [part[d <= mu + radius], part[d > mu]]
                continue
        out += _brute_links(part, radius)
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([x[i] for x in out]) if out else empty for i in (0, 1))


def simhash_links(distinct: DataFrame, radius: int, sample_limit: int = SAMPLE_LIMIT,
                  leaf_target: int = LEAF_TARGET) -> DataFrame:
    """Links (``a``, ``b``) joining the distinct fingerprints (column ``__fp``) within ``radius``."""
    spark = distinct.sparkSession
    n = distinct.count()
    leaves = max(1, min(n // leaf_target, sample_limit // 16))
    # the sampled ones have the smallest hashes, so that the tree is the same in every run
    wanted = hash_sample(distinct.select("__fp"), "__fp", n, min(sample_limit, 32 * leaves)) if leaves > 1 else distinct.limit(0)
    sample = [r[0] for r in sorted(wanted.select("__fp", F.xxhash64("__fp")).collect(), key=lambda r: (r[1], r[0]))]
    nodes = build_tree(np.array(sample, np.int64).view(np.uint64), leaves, radius) if leaves > 1 else []

    def visits(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            leaf, row = route(fp.view(np.uint64), nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fp[row])], names=["leaf", "__fp"])

    def search(shard: pa.Table) -> pa.Table:
        a, b = leaf_links(shard["__fp"].to_numpy().view(np.uint64), radius)
        return pa.table({"a": a, "b": b})

    visited = distinct.select("__fp").mapInArrow(visits, "leaf int, __fp long")
    parts = max(leaves, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return visited.repartition(parts, "leaf").groupBy("leaf").applyInArrow(search, "a long, b long")


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """Class of every fingerprint of ``prints`` (``doc_id``, ``__fp``; written already):
    ``__fp``, ``__class`` (smallest fingerprint reachable), ``component_id``."""
    distinct = scratch_table(prints.groupBy("__fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    linked = scratch_table(connected_components(simhash_links(distinct, radius)), "components")
    rooted = distinct.join(linked, distinct["__fp"] == linked["node"], "left").select(
        distinct["__fp"], "first_id", F.coalesce("root", distinct["__fp"]).alias("__class"))
    rooted = scratch_table(rooted, "rooted")
    least = scratch_table(rooted.groupBy("__class").agg(F.min("first_id").alias("component_id")), "least")
    return scratch_table(rooted.join(least, "__class").select("__fp", "__class", "component_id"), "classes")


def simhash_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; more columns are ignored).

    Returns ``doc_id``, ``fingerprint`` (16 lowercase hex digits), ``component_id`` (smallest
    doc_id reachable over links of at most ``radius`` bits) and ``class_fingerprint`` (the
    smallest fingerprint reachable, as signed bits; names the component even where ids are null).
    A null or empty text has no words: fingerprint zero, linked like any other.  Rows with a
    null doc_id are fingerprinted and linked; they never name a component unless all its ids
    are null (component_id is then null).  Repeated rows come back as often as given."""
    prints = scratch_table(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "__fp"), "prints")
    known = classes(prints, radius)
    return prints.join(known, "__fp").select(
        "doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("__class").alias("class_fingerprint"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (of rows that
    repeat this id one stays; of a component without ids one row stays)."""
    key = fresh(docs, "__key")
    hashed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    prints = with_fingerprint(hashed.select("doc_id", "text", F.col(key).alias("__key")), shingle)
    prints = scratch_table(prints.select("doc_id", "__fp", "__key"), "prints")
    known = classes(prints, radius)
    kept = (prints.join(known, "__fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("__class").agg(F.min_by("__key", F.struct("doc_id", "__key")).alias(key)).select(key).distinct())
    kept = scratch_table(kept, "kept")
    return hashed.join(kept, key, "left_semi").dropDuplicates([key]).select(*own(docs))
