"""MinHash near-duplicates by an inverted join over signature coordinates.

1.  Every text becomes its set of distinct word shingles and a signature of
    ``coords`` MinHash coordinates.  Texts of equal sets are one class, named
    by its smallest id; only classes go on, so a group of exact copies costs
    one row.
2.  Classes are posted under each (coordinate, value) pair.  Two sets that
    reach the threshold agree in at least ``matches`` coordinates, but for a
    chance of under ``MISS`` a pair; so their ``coords - matches + 1`` rarest
    postings meet (prefix).  Postings of one class are skipped.
3.  Classes that share a prefix posting form clusters (components of star
    edges, one edge a posting).  A cluster is cut into chunks of bounded size
    and every pair of chunks is one tile, so no task holds a whole cluster.
4.  Inside a tile collisions are counted, pairs under ``matches`` and pairs
    already connected are dropped, the rest is confirmed on the full sets.  A
    tile returns a spanning forest of the confirmed links: at most one row a
    class, never all pairs.
5.  The components of the confirmed links are the groups.

Defined results: null, empty or word-less text has an empty set and no links;
rows sharing an id are one document; rows without an id are linked with
nothing; repeated rows are returned as often as they come; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resemble.llm.graph import components, small, stored
from resemble.llm.wordhash import NON_SPACE, mix, shingle_sets, split_words, text_slices

COORDS = 64
MISS = 1e-7
CHUNK_SHINGLES = 500_000
CHUNK_ROWS = 2_048


def match_threshold(percent: int, coords: int = COORDS, miss: float = MISS) -> int:
    """Largest m so that a pair at the similarity threshold agrees in fewer than m coordinates with chance under ``miss``."""
    p = Fraction(percent, 100)
    tail, m = 0.0, 0
    while m < coords:
        tail += math.comb(coords, m) * float(p ** m * (1 - p) ** (coords - m))
        if tail >= miss:
            break
        m += 1
    return max(m, 1)


def _multipliers(coords: int) -> np.ndarray:
    return mix(np.arange(1, coords + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _signatures(sets: np.ndarray, bounds: np.ndarray, coords: int) -> np.ndarray:
    """One row of ``coords`` tokens for each non-empty set; a token names its coordinate and value."""
    heads = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(heads), coords), np.uint64)
    for k, a in enumerate(_multipliers(coords)):
        if len(heads):
            out[:, k] = mix(np.minimum.reduceat(sets * a, heads) + np.uint64(k))
    return out


def _sets_of(column: pa.Array, width: int):
    for lo, hi, data, offsets in text_slices(column):
        words, _, bounds = split_words(data, offsets, NON_SPACE)
        yield lo, hi, *shingle_sets(words, bounds, width)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, coords: int) -> DataFrame:
    """``(id, n, k1, k2, sig)`` per row: set size, 128-bit key of the set, tokens (empty for an empty set)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([source.schema["id"], T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()),
                           T.StructField("k2", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType()))])

    def step(batches):
        for batch in batches:
            for lo, hi, sets, bounds in _sets_of(batch.column(1), width):
                n = np.diff(bounds)
                full = n > 0
                keys = np.zeros((2, hi - lo), np.uint64)
                if full.any():
                    keys[0, full] = np.add.reduceat(mix(sets), bounds[:-1][full])
                    keys[1, full] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
                sig = _signatures(sets, bounds, coords).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(full) * coords]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(keys[0].view(np.int64)),
                     pa.array(keys[1].view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))],
                    names=["id", "n", "k1", "k2", "sig"])

    return source.mapInArrow(step, schema)


def _clusters(classes: DataFrame, coords: int, matches: int) -> DataFrame:
    """``(node, cluster)`` of the classes that share a prefix posting with another class."""
    postings = classes.select("node", F.explode("sig").alias("token"))
    common = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # the coordinates that are not in ``common`` are the rarest ones: they fill the prefix first
    ranked = (postings.join(common, "token").groupBy("node")
              .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared")))
    room = F.lit(1 - matches) + F.size("shared")
    prefix = ranked.where(room > 0).select("node", F.explode(F.slice("shared", F.lit(1), room)).alias("p"))
    prefix = stored(prefix.select("node", F.col("p.token").alias("token")))
    heads = prefix.groupBy("token").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("df")).where("df > 1")
    edges = prefix.join(heads.select("token", "head"), "token").where("node <> head")
    return components(edges, "node", "head").withColumnRenamed("component", "cluster")


def _tiles(clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(tile, cluster, node, chunk, cross)``: where each class goes; small clusters share a tile."""
    nodes = stored(clusters.join(sizes, "node"))
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    packs = max(1, math.ceil(total / CHUNK_SHINGLES), nodes.sparkSession.sparkContext.defaultParallelism)
    shape = nodes.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum("n") / CHUNK_SHINGLES), F.ceil(F.count(F.lit(1)) / CHUNK_ROWS)).cast("int").alias("chunks"))
    # a large cluster has one row in ``shape`` and many in ``nodes``; the join streams ``nodes``
    placed = nodes.join(shape, "cluster").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    small = placed.where("chunks = 1").select(
        F.concat(F.lit("p"), F.pmod(F.xxhash64("cluster"), F.lit(packs)).cast("string")).alias("tile"),
        "cluster", "node", "chunk")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    large = placed.where("chunks > 1").select("cluster", "node", "chunk", other).select(
        F.concat_ws("-", "cluster", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tile"),
        "cluster", "node", "chunk")
    return small.union(large)


def _forest(sets: np.ndarray, bounds: np.ndarray, chunk: np.ndarray, coords: int, matches: int, percent: int):
    """Pairs ``(i, j)`` that span the confirmed links among the texts of one cluster in one tile."""
    n = np.diff(bounds)
    rows = np.flatnonzero(n > 0)
    sig = _signatures(sets, bounds, coords)
    _, local = np.unique(sets, return_inverse=True)
    label, mark = np.arange(len(rows)), np.zeros(int(local.max(initial=0)) + 1, bool)
    cross = len(np.unique(chunk)) > 1
    for u in range(len(rows) - 1):
        rest = np.arange(u + 1, len(rows))
        rest = rest[label[rest] != label[u]]
        if cross:  # pairs inside one chunk belong to that chunk's own tile
            rest = rest[chunk[rows[rest]] != chunk[rows[u]]]
        if not len(rest):
            continue
        rest = rest[(sig[rest] == sig[u]).sum(axis=1) >= matches]
        if not len(rest):
            continue
        mine = local[bounds[rows[u]]:bounds[rows[u] + 1]]
        mark[mine] = True
        size = n[rows[rest]]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) - np.repeat(ends - size, size) + np.repeat(bounds[rows[rest]], size)
        both = np.add.reduceat(mark[local[at]].astype(np.int64), ends - size)
        mark[mine] = False
        union = len(mine) + size - both
        for v in rest[100 * both >= percent * union]:
            if label[v] != label[u]:
                label[label == label[v]] = label[u]
                yield int(rows[u]), int(rows[v])


def confirmed_links(docs: DataFrame, tiles: DataFrame, id_col: str, text_col: str, width: int, percent: int,
                    coords: int, matches: int) -> DataFrame:
    """``(a, b)`` class pairs that span all confirmed links."""
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).cast("string").alias("t")).where(F.col("node").isNotNull())
    rows = texts.join(small(tiles), "node").select("tile", "cluster", "node", "chunk", "t")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def confirm(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("node", "ascending")]).combine_chunks()
        out_a, out_b = [], []
        if table.num_rows:
            cluster = table.column("cluster").to_pylist()
            node = table.column("node").to_pylist()
            chunk = table.column("chunk").to_numpy()
            text = table.column("t").chunk(0)
            cuts = [0] + [i for i in range(1, len(cluster)) if cluster[i] != cluster[i - 1]] + [len(cluster)]
            for lo, hi in zip(cuts, cuts[1:]):
                parts = list(_sets_of(text.slice(lo, hi - lo), width))
                sets = np.concatenate([p[2] for p in parts])
                bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[3]) for p in parts]))])
                for i, j in _forest(sets, bounds, chunk[lo:hi], coords, matches, percent):
                    out_a.append(node[lo + i])
                    out_b.append(node[lo + j])
        return pa.table({"a": pa.array(out_a, table.schema.field("node").type),
                         "b": pa.array(out_b, table.schema.field("node").type)})

    return rows.groupBy("tile").applyInArrow(confirm, schema)


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                coords: int = COORDS) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` per row of ``docs``; links have 100 * intersection >= percent * union.

    ``component_id`` is the smallest id of the row's group (itself where it has no link; null without an id).
    """
    matches = match_threshold(percent, coords)
    signed = stored(signatures(docs, id_col, text_col, width, coords))
    known = signed.where("n > 0 and id is not null")
    class_of = known.groupBy("k1", "k2", "n").agg(F.min("id").alias("node"))
    classes = known.join(class_of, ["k1", "k2", "n"]).where("id = node").dropDuplicates(["node", "k1", "k2", "n"])
    classes = stored(classes.select("node", "n", "sig"))
    clusters = _clusters(classes.select("node", "sig"), coords, matches)
    tiles = stored(_tiles(clusters, classes.groupBy("node").agg(F.sum("n").alias("n"))))
    links = confirmed_links(docs, tiles, id_col, text_col, width, percent, coords, matches)
    # rows that share an id are one document: its classes' names are linked with it
    own = known.join(class_of, ["k1", "k2", "n"]).where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    groups = components(links.union(own)).withColumnRenamed("node", "id")
    rows = signed.select("id", "n").join(groups, "id", "left")
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id; of rows sharing an id the least one (by its columns).

    Rows without an id stay.
    """
    groups = stored(near_groups(docs, width, percent, id_col, text_col))
    gone = stored(groups.where(f"{id_col} <> component_id").select(F.col(id_col).alias("_gone")).distinct())
    repeated = stored(groups.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("_twice")))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    staying = docs.join(small(gone), F.col(id_col) == F.col("_gone"), "left_anti")
    if not repeated.limit(1).count():
        return staying.select(*cols)
    same = F.col(id_col) == F.col("_twice")
    once = staying.join(small(repeated), same, "left_anti").select(*cols)
    least = staying.join(small(repeated), same, "left_semi").groupBy(id_col).agg(F.min(F.struct(*cols)).alias("r")).select("r.*")
    return once.unionByName(least)
