"""Cluster post-processing: centroids, merging, noise, splits, caps, statistics and gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.sources.shared import discard, written

from .reports import ranked
from .retrieval import QUERY_BLOCK, dot, normalised
from .retrieval import _against as against


def centroids(points: DataFrame) -> DataFrame:
    """(cluster_id, centroid): normalised means of the normalised vectors of (id, cluster_id, vector), noise (-1) aside."""
    each = points.where("cluster_id >= 0").select("cluster_id", F.posexplode(normalised(F.col("vector"))).alias("pos", "x"))
    means = each.groupBy("cluster_id", "pos").agg(F.avg("x").alias("x"))
    return means.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p")).select("cluster_id", normalised(F.col("p.x"), 1e-12).alias("centroid"))


def nearest_centroid(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster_id, score): of each point the centroid of largest cosine; ties go to the smaller cluster id. Null vectors go.

    Blocks of centroids, counted, are broadcast, and a batch of points is one matrix product; where there is more than one block, the
    best of each meet by point.
    """
    kinds = [to_arrow_type(d.schema[c].dataType) for d, c in ((points, "id"), (centres, "cluster_id"))]

    def work(block):
        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = block.value
            order = np.argsort(np.array(names), kind="stable")
            names, matrix = np.array(names)[order], matrix[order]
            for batch in batches:
                if batch.num_rows:
                    scores = np.round(matrix @ np.array(batch.column(1).to_pylist(), dtype=np.float64).T, 6)
                    at = scores.argmax(axis=0)  # the first of equals, which has the smallest id
                    yield pa.record_batch([batch.column(0).cast(kinds[0]), pa.array(names[at].tolist(), kinds[1]), pa.array(scores[at, np.arange(len(at))])], ["id", "cluster_id", "score"])

        return best

    schema = f"id {points.schema['id'].dataType.simpleString()}, cluster_id {centres.schema['cluster_id'].dataType.simpleString()}, score double"
    asked = written(centres.select(F.col("cluster_id").alias("query_id"), F.col("centroid").alias("vector")), "centres")
    one_block = asked.count() <= QUERY_BLOCK // 2
    met = against(points.where("vector is not null").select(F.col("id").alias("chunk_id"), "vector"), asked, work, schema)
    if one_block:
        return met
    top = met.groupBy("id").agg(F.max(F.struct("score", (-F.col("cluster_id")).alias("low"))).alias("m"))
    return top.select("id", (-F.col("m.low")).alias("cluster_id"), F.col("m.score").alias("score"))


def merge_pairs(centres: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of centroid pairs a < b whose cosine reaches the threshold."""
    x, y = centres.select(F.col("cluster_id").alias("a"), F.col("centroid").alias("x")), centres.select(F.col("cluster_id").alias("b"), F.col("centroid").alias("y"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(dot(F.col("x"), F.col("y")), 6).alias("score")).where(F.col("score") >= threshold)


def merge_map(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, root, new_id): which cluster takes each one in, and the roots' numbers from 0 in the order of their ids.

    pairs: (a, b), a < b, of similar centroids. By ascending id, a cluster that no earlier root is similar to is a root and takes in all later
    ones similar to it that are not yet taken: merging compares the centroids of roots, so likeness is not passed on. In rounds: who has no
    smaller open neighbour is a root, its later neighbours are members, and both leave with their pairs. A member's root is
    its smallest neighbour that is one. Each round is written; rounds are as many as the longest chain of waiting clusters.
    """
    known = written(pairs.select("a", "b").distinct(), "merge-pairs")
    open_pairs, members = known, None
    while not open_pairs.isEmpty():
        heads = open_pairs.select("a").distinct().join(open_pairs.select(F.col("b").alias("a")), "a", "left_anti")
        taken = written(open_pairs.join(heads, "a", "left_semi").select("b").distinct(), "merge-members")
        left = open_pairs.join(heads, "a", "left_anti").join(taken, "b", "left_anti").join(taken.select(F.col("b").alias("a")), "a", "left_anti")
        before, open_pairs = open_pairs, written(left.select("a", "b"), "merge-open")
        if before is not known:
            discard(before)
        members = taken if members is None else members.union(taken)
    each = clusters.select("cluster_id").distinct()
    if members is None:
        joined = each.select("cluster_id", F.col("cluster_id").alias("root"))
    else:
        roots = each.join(members.select(F.col("b").alias("cluster_id")), "cluster_id", "left_anti")
        near = known.join(roots.select(F.col("cluster_id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("cluster_id")).agg(F.min("a").alias("root"))
        joined = each.join(near, "cluster_id", "left").select("cluster_id", F.coalesce("root", "cluster_id").alias("root"))
    joined = written(joined, "merge-roots")
    dense = ranked(joined.select("root").distinct(), "root").select("root", F.col("__rank").cast("int").alias("new_id"))
    return joined.join(dense, "root").select("cluster_id", "root", "new_id")


def merged(points: DataFrame, threshold: float = 0.85) -> DataFrame:
    """points (id, cluster_id, vector) with new_id, clusters with similar centroids being merged; noise (-1) stays noise."""
    centres = written(centroids(points), "centroids")
    new = merge_map(merge_pairs(centres, threshold), centres).select("cluster_id", "new_id")
    return points.join(new, "cluster_id", "left").withColumn("new_id", F.coalesce("new_id", F.lit(-1)))


def label(cluster_id: Column) -> Column:
    return F.when(cluster_id < 0, "dropped").otherwise(F.format_string("cluster_%03d", cluster_id))


def split_counts(clusters: DataFrame, val: float = 0.2, sealed: float = 0.1) -> DataFrame:
    """(cluster_id, n) with n_dev, n_val, n_sealed: under three members all are dev; counts round half to even."""
    n = F.col("n")
    v = F.greatest(F.bround(n * val, 0).cast("long"), F.lit(1).cast("long"))
    s = F.bround(n * sealed, 0).cast("long")
    c = clusters.select("*", F.when(n < 3, 0).otherwise(v).cast("long").alias("v"), F.when(n < 3, 0).otherwise(s).cast("long").alias("s"))
    tight = (n >= 3) & (n - F.col("v") - F.col("s") < 1)
    v2 = F.greatest(n - 1 - F.col("s"), F.lit(1))
    c = c.select("*", F.when(tight, v2).otherwise(F.col("v")).alias("n_val"))
    c = c.select("*", F.when(tight & (n - 1 - F.col("s") < 1), n - 1 - F.col("n_val")).otherwise(F.col("s")).alias("n_sealed"))
    return c.select(*clusters.columns, (n - F.col("n_val") - F.col("n_sealed")).alias("n_dev"), "n_val", "n_sealed")


def split_members(points: DataFrame, seed: int = 42) -> DataFrame:
    """points (id, cluster_id) with split: members in the order of a keyed MD5, dev first, then val, then sealed."""
    counts = split_counts(points.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")))
    luck = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    turn = points.withColumn("turn", F.row_number().over(W.partitionBy("cluster_id").orderBy(luck, "id")))
    met = turn.join(counts, "cluster_id")
    return met.select("id", "cluster_id", F.when(F.col("turn") <= F.col("n_dev"), "dev").when(F.col("turn") <= F.col("n_dev") + F.col("n_val"), "val").otherwise("sealed").alias("split"))


def reweight_caps(clusters: DataFrame, least: float = 0.02, most: float = 0.15) -> DataFrame:
    """(cluster_id, n) with fraction and cap: ceil(total * least) for small clusters, floor(total * most) for large."""
    total = clusters.agg(F.sum("n").alias("total"))
    c = clusters.crossJoin(F.broadcast(total)).withColumn("fraction", F.col("n") / F.col("total"))
    cap = F.when(F.col("fraction") < least, F.ceil(F.col("total") * least)).when(F.col("fraction") > most, F.floor(F.col("total") * most))
    return c.select("cluster_id", "n", F.round("fraction", 6).alias("fraction"), cap.cast("long").alias("cap"))


def statistics(clusters: DataFrame) -> DataFrame:
    """One row: clusters, smallest, largest, mean, median and population deviation of n, to one digit."""
    return clusters.agg(F.count(F.lit(1)).alias("clusters"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 1).alias("mean"), F.round(F.median("n"), 1).alias("median"), F.round(F.stddev_pop("n"), 1).alias("std"))


def gates(clusters: DataFrame, noise: Column, min_clusters: int = 20, warn_clusters: int = 50) -> DataFrame:
    """One row: too_few (hard), few, noisy and lopsided (warnings)."""
    n = F.count(F.lit(1))
    return clusters.agg((n < min_clusters).alias("too_few"), ((n >= min_clusters) & (n < warn_clusters)).alias("few"), F.coalesce(F.max("n") / F.sum("n") > 0.40, F.lit(False)).alias("lopsided")).withColumn("noisy", noise > 0.30)


def manifest(members: DataFrame, caps: DataFrame, min_clusters: int = 20, few_clusters: int = 50, most_noise: float = 0.30, most_share: float = 0.40) -> DataFrame:
    """One row over members (id, cluster_id, split; -1 is noise) and reweight_caps: status, docs, noise_docs, noise_fraction, clusters,
    largest_fraction, capped_low, capped_high, warnings and failures, by name and what was found.

    Failures: too few clusters, and clusters of three members or more without a validation member, whose number is told. Counts
    are made by cluster before they are added up.
    """
    each = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "val").alias("val"))
    real = F.col("cluster_id") >= 0
    one = each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("noise_docs"), F.count_if(real).alias("clusters"),
        F.max(F.when(real, F.col("n"))).alias("largest"), F.count_if(real & (F.col("n") >= 3) & (F.col("val") == 0)).alias("without_val"),
    )
    capped = caps.where("cap is not null").agg(F.count_if(F.col("cap") > F.col("n")).alias("capped_low"), F.count_if(F.col("cap") < F.col("n")).alias("capped_high"))
    active = F.col("docs") - F.col("noise_docs")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    d = one.crossJoin(capped).withColumns({"noise_fraction": F.round(share(F.col("noise_docs"), F.col("docs")), 4), "largest_fraction": F.round(share(F.coalesce("largest", F.lit(0)), active), 4)})  # one row each
    said = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    warnings = [F.when((F.col("clusters") >= min_clusters) & (F.col("clusters") < few_clusters), said("few clusters", F.col("clusters"))), F.when(share(F.col("noise_docs"), F.col("docs")) > most_noise, said("noise fraction", F.col("noise_fraction"))), F.when(share(F.coalesce("largest", F.lit(0)), active) > most_share, said("largest fraction", F.col("largest_fraction")))]
    failures = [F.when(F.col("clusters") < min_clusters, said("too few clusters", F.col("clusters"))), F.when(F.col("without_val") > 0, said("clusters without validation members", F.col("without_val")))]
    d = d.withColumns({"warnings": F.array_compact(F.array(*warnings)), "failures": F.array_compact(F.array(*failures))})
    return d.select(F.when(F.size("failures") == 0, "complete").otherwise("failed").alias("status"), "docs", "noise_docs", "noise_fraction", "clusters", "largest_fraction", "capped_low", "capped_high", "warnings", "failures")


def checked(row: DataFrame) -> DataFrame:
    """A manifest, once it has no failures; else an error that names them."""
    failures = row.select("failures").first().failures
    if failures:
        raise ValueError("clusters fail their gates: " + "; ".join(failures))
    return row


def reduced(points: DataFrame, method: str, k: int, embed: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[DataFrame, dict]:
    """((id, reduced), what was done) of (id, vector) by pca, none or passthrough, or umap, a plug-in embed(points, k) that gives (id, reduced).

    umap falls back to pca, and tells why, without a plug-in or for no more points than k or three. All vectors come out with length one.
    """
    if method not in ("umap", "pca", "none", "passthrough"):
        raise ValueError(f"unknown reduction: {method}; known are umap, pca, none and passthrough")
    told = {"method": method, "fallback": None}
    if method in ("none", "passthrough"):
        return points.select("id", normalised(F.col("vector"), 1e-12).alias("reduced")), told | {"method": "passthrough"}
    n = points.count()
    if method == "umap":
        if embed is not None and n > max(k, 3):
            out = embed(points, k)
            return out.select("id", normalised(F.col("reduced"), 1e-12).alias("reduced")), told | {"dimension": k}
        told |= {"method": "pca", "fallback": "no plug-in for umap" if embed is None else f"{n} points are too few for {k} components"}
    if n <= 1:
        return points.select("id", normalised(F.col("vector"), 1e-12).alias("reduced")), told
    return pca(points, min(k, n)), told | {"dimension": min(k, n)}


def pca(points: DataFrame, k: int) -> DataFrame:
    """(id, reduced): normalised vectors, centred, on their first k principal axes (as many as there are dimensions at most), normalised again."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    width = points.select(F.size("vector").alias("n")).first()
    if width is None:
        return points.select("id", F.col("vector").cast("array<double>").alias("reduced"))
    v = points.select("id", array_to_vector(normalised(F.col("vector"))).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(v).transform(v)
    out = PCA(k=min(k, width.n), inputCol="centred", outputCol="out").fit(centred).transform(centred)
    return out.select("id", normalised(vector_to_array("out"), 1e-12).alias("reduced"))


def density_clusters(points: DataFrame, min_size: int = 5, most: int = 20_000) -> DataFrame:
    """(id, cluster_id; -1 is noise) by hierarchical density clustering: single linkage of mutual reachability, condensed to
    clusters of at least min_size points, of which those of the largest excess of mass are taken.

    For up to ``most`` points, on one task; larger inputs are refused.
    """
    if points.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} points")
    return points.select(F.lit(0).alias("one"), "id", "vector").groupBy("one").applyInPandas(lambda pdf: _density(pdf, min_size), "id long, cluster_id int")


def _density(pdf, min_size: int):
    import numpy as np
    import pandas as pd

    x = np.array(pdf["vector"].tolist(), dtype=np.float64)
    n = len(x)
    core = np.empty(n)
    for i in range(0, n, 512):
        d = np.sqrt(np.maximum(((x[i : i + 512, None] - x[None]) ** 2).sum(axis=2), 0)) if n <= 2000 else np.sqrt(np.maximum((x[i : i + 512] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[i : i + 512] @ x.T, 0))
        core[i : i + 512] = np.partition(d, min(min_size, n - 1), axis=1)[:, min(min_size, n - 1)]
    best, to, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):  # Prim's tree over mutual reachability
        inside[at] = True
        d = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(axis=1)), core), core[at])
        nearer = ~inside & (d < best)
        best[nearer], to[nearer] = d[nearer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[at], to[at], at))
    edges.sort()
    # The dendrogram: node n + i joins two earlier ones at a distance.
    parent, size, joins = list(range(2 * n - 1)), [1] * n, []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for w, a, b in edges:
        a, b = root(a), root(b)
        parent[a] = parent[b] = n + len(joins)
        joins.append((a, b, w))
        size.append(size[a] + size[b])
    # Condensed from the top: a split counts only if both sides are large enough; else the smaller side falls out.
    birth, above, mass, fell = [0.0], [-1], [0.0], np.zeros(n, int)

    def leaves(node):
        out, stack = [], [node]
        while stack:
            i = stack.pop()
            if i < n:
                out.append(i)
            else:
                stack += joins[i - n][:2]
        return out

    stack = [(2 * n - 2, 0)] if n > 1 else []
    while stack:
        node, cluster = stack.pop()
        a, b, w = joins[node - n]
        level = 1 / max(w, 1e-12)
        large = [x for x in (a, b) if size[x] >= min_size]
        gone = [a, b] if len(large) != 1 else [x for x in (a, b) if size[x] < min_size]
        mass[cluster] += (level - birth[cluster]) * sum(size[x] for x in gone)
        if len(large) == 2:
            for x in large:
                birth.append(level)
                above.append(cluster)
                mass.append(0.0)
                fell[leaves(x)] = len(birth) - 1
                stack.append((x, len(birth) - 1))
        elif large and large[0] >= n:
            stack.append((large[0], cluster))
    below = [[c for c in range(len(above)) if above[c] == k] for k in range(len(above))] if len(above) < 2000 else None
    taken = np.ones(len(birth), bool)
    taken[0] = False  # all points as one cluster are no answer
    for k in range(len(birth) - 1, 0, -1):
        children = below[k] if below is not None else [c for c in range(k + 1, len(above)) if above[c] == k]
        inner = sum(mass[c] for c in children)
        if children and inner > mass[k]:
            taken[k], mass[k] = False, inner
    names = np.full(len(birth), -1)
    for k in range(1, len(birth)):  # a cluster inside a taken one is part of it
        names[k] = names[above[k]] if names[above[k]] >= 0 else (names.max() + 1 if taken[k] else -1)
    labels = names[fell]
    return pd.DataFrame({"id": pdf["id"], "cluster_id": labels.astype(np.int32)})
