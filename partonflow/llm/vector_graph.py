"""Embedding near-dedup on a flat, robust-pruned graph.

Equal vectors are one node with one representative.  Nodes are assigned to their
nearest few of K centroids, which gives overlapping shards; each shard links its
nodes by robust pruning (a neighbour is dropped when one that was kept already
is closer to it, by a factor, than the node itself), and the adjacency lists of
a node from all its shards are united.  In each shard every node then runs a
greedy search from the medoid and, once it is near, expands through all nodes in
range; what it meets is verified by cosine in double precision.  Recall is
audited against brute force over all nodes, as the mean over nodes with true
links, and the overlap grows until it reaches the target.  The queries grow in
number until enough of them have true links; if too few have, slightly disturbed
copies of stored vectors are indexed with the nodes and judged as well.

Centroids are fitted on at most ``sample`` vectors; every vector is indexed and
searched.  A shard above ``shard`` nodes is split by hash and each split searches
all splits of its shard, one at a time, so that a task holds two splits (about
2 x ``shard`` nodes) and no neighbour is lost.
A pair that meets in several shards counts once, whichever of them finds it.

Contract: vectors that are NULL, zero, or hold NULL or non-finite components are
linked with nothing; so are rows without an id.  Vectors of different length are
not compared.  Rows that repeat an id are one vector if they are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partonflow.llm.common import stored
from partonflow.llm.components import components

DEGREE, ALPHA, POOL, BEAM = 16, 1.2, 48, 24


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components stay finite.
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nodes(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(rep, size, v): distinct usable vectors with their smallest id and their number."""
    usable = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = usable.filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~odd & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are the same component.
    usable = usable.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    return usable.groupBy("v").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("size")).select("rep", "size", "v")


def _centroids(found: DataFrame, count: int, sample: int, shard: int, overlap: int) -> dict[int, np.ndarray]:
    """Centroids for each length of vectors, fitted on about ``sample`` nodes."""
    some = found.filter(F.pmod(F.xxhash64(F.lit("fit"), "rep"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, count)))))
    rows = sorted(some.select("rep", "v").limit(2 * sample).collect())
    out: dict[int, np.ndarray] = {}
    for size in {len(r[1]) for r in rows}:
        own = _unit(np.array([r[1] for r in rows if len(r[1]) == size]))
        share = count * len(own) / len(rows)
        k = int(min(max(1, len(own) // 20), -(-share * overlap // (shard // 2))))
        rng = np.random.default_rng(7)
        centers = own[rng.choice(len(own), size=max(1, k), replace=False)]
        for _ in range(8):
            owner = np.argmax(own @ centers.T, axis=1)
            for c in range(len(centers)):
                if (owner == c).any():
                    centers[c] = own[owner == c].mean(0)
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        out[size] = centers
    return out


def _assigned(found: DataFrame, centers: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """(rep, size, v, shards): the nearest ``overlap`` shards of each node."""
    # At most sample / 20 centroids of one length.
    shared = found.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["v"].str.len()
            for size, part in batch.groupby(lengths):
                known = shared.value.get(int(size))
                unit = _unit(_matrix(part["v"]))
                if known is None:
                    near = np.zeros((len(part), 1), int)
                else:
                    near = np.argsort(-(unit @ known.T), axis=1, kind="stable")[:, :overlap]
                made = part.copy()
                made["shards"] = [[(int(size) << 32) + int(c) for c in sorted(row)] for row in near]
                yield made

    return found.mapInPandas(run, "rep bigint, size bigint, v array<double>, shards array<bigint>")


def pruned_graph(unit: np.ndarray) -> list[list[int]]:
    """Adjacency by robust pruning among the nearest POOL nodes of each node, made symmetric."""
    n = len(unit)
    lists: list[set[int]] = [set() for _ in range(n)]
    pool = min(POOL, n - 1)
    if pool <= 0:
        return [[] for _ in range(n)]
    for start in range(0, n, 512):
        cosine = unit[start : start + 512] @ unit.T
        cosine[np.arange(len(cosine)), np.arange(start, start + len(cosine))] = -2
        near = np.argpartition(-cosine, pool - 1, axis=1)[:, :pool]
        for k, candidates in enumerate(near):
            order = candidates[np.argsort(-cosine[k, candidates], kind="stable")]
            away = np.sqrt(np.maximum(0, 2 - 2 * cosine[k, order]))
            between = np.sqrt(np.maximum(0, 2 - 2 * (unit[order] @ unit[order].T)))
            alive = np.ones(len(order), bool)
            for j in range(len(order)):
                if alive[j]:
                    lists[start + k].add(int(order[j]))
                    if len(lists[start + k]) >= DEGREE:
                        break
                    alive &= ALPHA * between[j] > away
            for j in lists[start + k].copy():
                lists[j].add(start + k)
    return [sorted(x) for x in lists]


def range_search(query: np.ndarray, unit: np.ndarray, graph: list[list[int]], entry: int, threshold: float) -> list[int]:
    """Nodes with a cosine of ``threshold`` or more met by a greedy search that expands through all nodes in range."""
    seen = {entry}
    best = [(float(unit[entry] @ query), entry)]
    done: set[int] = set()
    while True:
        node = next((x for x in best[:BEAM] if x[1] not in done), None)
        if node is None:
            node = next((x for x in best if x[0] >= threshold and x[1] not in done), None)
        if node is None:
            return [x for c, x in best if c >= threshold]
        done.add(node[1])
        fresh = [x for x in graph[node[1]] if x not in seen]
        if fresh:
            seen.update(fresh)
            best += zip((unit[fresh] @ query).tolist(), fresh, strict=True)
            best.sort(reverse=True)
            # Beyond the beam only what is in range is remembered.
            best = best[:BEAM] + [x for x in best[BEAM:] if x[0] >= threshold]


def _search(assigned: DataFrame, threshold: float, shard: int) -> DataFrame:
    """(rep, links, others, heavy, other): what a task has found of a node, and links that connect what a task has found.

    ``links`` counts the vectors of nodes that only this shard can find.  ``others`` are nodes that share further
    shards with it, ``heavy`` those of them with several vectors, as "node vectors".
    """
    spread = assigned.select("rep", "size", "v", "shards", F.explode("shards").alias("shard"))
    splits = spread.groupBy("shard").agg(F.ceil(F.count("*") / shard).cast("int").alias("splits"))
    placed = spread.join(splits, "shard").withColumn("split", F.pmod(F.xxhash64("rep"), F.col("splits")).cast("int"))
    placed = stored(placed, "shards")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        reps = pdf["rep"].to_numpy()
        graph = pruned_graph(_unit(_matrix(pdf["v"])))
        return pd.DataFrame({"rep": reps, "out": [reps[x].tolist() for x in graph]})

    lists = placed.groupBy("shard", "split").applyInPandas(build, "rep bigint, out array<bigint>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out"))
    home = placed.join(united, "rep", "left")
    # Each split of a shard is a block of queries to each of its splits, whose members come to each block.
    every, own = F.sequence(F.lit(0), F.col("splits") - 1), F.col("split")
    asks = F.transform(every, lambda x: F.struct(x.alias("at"), own.alias("block")))
    holds = F.transform(F.filter(every, lambda x: x != own), lambda x: F.struct(own.alias("at"), x.alias("block")))
    everywhere = home.withColumn("role", F.explode(F.concat(asks, holds))).select("*", "role.at", "role.block").drop("role")
    everywhere = everywhere.withColumn("out", F.when(F.col("at") == own, F.col("out")))

    names = ["rep", "links", "others", "heavy", "other"]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        member = pdf[pdf["split"] == pdf["at"]]
        if not len(member):
            return pd.DataFrame(columns=names, dtype=object)
        reps, sizes = member["rep"].to_numpy(), member["size"].to_numpy()
        place = {r: k for k, r in enumerate(reps.tolist())}
        unit = _unit(_matrix(member["v"]))
        graph = [[place[int(x)] for x in (out if out is not None else ()) if int(x) in place] for out in member["out"]]
        shards = [set(x) for x in member["shards"]]
        entry = int(np.argmax(unit @ unit.mean(0)))
        pdf = pdf[pdf["split"] == pdf["block"]]
        if not len(pdf):
            return pd.DataFrame(columns=names, dtype=object)
        queries = _unit(_matrix(pdf["v"]))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for row, (rep, own) in enumerate(zip(pdf["rep"].tolist(), pdf["shards"], strict=True)):
            start = place.get(rep, entry)
            hits = set(range_search(queries[row], unit, graph, entry, threshold))
            if start != entry:
                # A member also starts from itself, so that a poorly connected entry does not hide its surroundings.
                hits.update(range_search(queries[row], unit, graph, start, threshold))
            total, others, heavy = 0, [], []
            for k in hits:
                other = int(reps[k])
                if other != rep:
                    a, b = find(rep), find(other)
                    root[max(a, b)] = min(a, b)
                    if len(shards[k].intersection(own)) == 1:
                        total += int(sizes[k])
                    else:
                        others.append(other)
                        if sizes[k] > 1:
                            heavy.append(f"{other} {sizes[k]}")
            if total or others:
                out.append((rep, total, sorted(others), heavy, None))
        edges = [(x, 0, [], [], find(x)) for x in root if find(x) != x]
        return pd.DataFrame(out + edges, columns=names).astype({"other": "Int64"})

    schema = "rep bigint, links bigint, others array<bigint>, heavy array<string>, other bigint"
    return stored(everywhere.groupBy("shard", "at", "block").applyInPandas(search, schema), "found")


def _counted(result: DataFrame) -> DataFrame:
    """(rep, links): the linked vectors of other nodes, each counted once over all shards."""
    rows = result.filter("other IS NULL").groupBy("rep").agg(
        F.sum("links").alias("links"),
        F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"),
        F.array_distinct(F.flatten(F.collect_list("heavy"))).alias("heavy"),
    )
    more = F.aggregate("heavy", F.lit(0).cast("long"), lambda a, x: a + F.split(x, " ")[1].cast("long") - 1)
    return rows.select("rep", (F.col("links") + F.size("others") + more).alias("links"))


def _some(found: DataFrame, total: int, queries: int) -> dict[int, np.ndarray]:
    """About ``queries`` nodes by a hash of their id, each a part of any larger choice."""
    place = F.pmod(F.xxhash64(F.lit("audit"), "rep"), F.lit(1 << 30))
    chosen = found.filter(place < F.lit(int((1 << 30) * min(1.0, queries / max(1, total)))))
    return {r["rep"]: np.asarray(r["v"]) for r in chosen.select("rep", "v").collect()}


def true_links(found: DataFrame, asked: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(rep, real): the linked vectors of other nodes by brute force, of the nodes ``asked`` that have any."""
    # As many vectors as the audit has queries, whatever the input.
    shared = found.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["v"].str.len()):
                own = [(r, v) for r, v in shared.value.items() if len(v) == size]
                unit, reps, sizes = _unit(_matrix(part["v"])), part["rep"].to_numpy(), part["size"].to_numpy()
                for at in range(0, len(own), 256):
                    ids = np.array([r for r, _ in own[at : at + 256]])
                    cosine = _unit(np.stack([v for _, v in own[at : at + 256]])) @ unit.T
                    links = ((cosine >= threshold) & (ids[:, None] != reps[None, :])) @ sizes
                    yield pd.DataFrame({"rep": ids[links > 0], "links": links[links > 0]})

    return found.mapInPandas(run, "rep bigint, links bigint").groupBy("rep").agg(F.sum("links").alias("real"))


def _judged(real: DataFrame, result: DataFrame) -> list[float]:
    """The share of its true links that ``result`` counts, for each node of ``real``."""
    rows = real.join(_counted(result), "rep", "left").select("real", F.coalesce("links", F.lit(0))).collect()
    return [min(1.0, got / true) for true, got in rows]


class Audit:
    """Queries with their true links, found once, and the probes added where too few nodes have any."""

    def __init__(self, found: DataFrame, count: int, threshold: float, queries: int, most: int, enough: int):
        self.probes, self.whole = None, False
        asked = min(queries, most)
        while True:
            some = _some(found, count, asked)
            self.real = stored(true_links(found, some, threshold), "audit")
            linked = self.real.count()
            # All nodes asked is the whole truth, also without a link.
            self.whole = asked >= count
            if linked >= enough or self.whole:
                return
            if asked >= most:
                break
            asked = min(4 * asked, most)
        low, high = found.agg(F.min("rep"), F.max("rep")).first()
        rng = np.random.default_rng(11)
        rows = []
        for k, (_, v) in enumerate(sorted(_some(found, count, 4 * enough).items())):
            v = _unit(v[None, :])[0]
            if len(v) < 2:
                continue
            # Turned by an angle just inside the threshold, where a pair is the hardest to find.
            away = rng.normal(size=len(v))
            away = _unit((away - (away @ v) * v)[None, :])[0]
            cosine = threshold + 0.05 * (1 - threshold)
            new = high + 1 + k if high < 2**62 else low - 1 - k
            rows.append((new, 1, (cosine * v + np.sqrt(1 - cosine**2) * away).tolist()))
        if rows:
            probes = found.sparkSession.createDataFrame(rows, "rep bigint, size bigint, v array<double>")
            self.probes = stored(found.select("rep", "size", "v").unionByName(probes), "probes")
            self.probed = stored(true_links(self.probes, {r[0]: np.asarray(r[2]) for r in rows}, threshold), "audit")

    def recall(self, result: DataFrame, search: Callable[[DataFrame], DataFrame]) -> float:
        """Mean over the nodes with true links, and over the probes if there are any."""
        shares = _judged(self.real, result)
        if self.probes is not None:
            shares += _judged(self.probed, search(self.probes))
        if not shares:
            return 1.0 if self.whole else 0.0
        return sum(shares) / len(shares)


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95,
    overlap: int = 2, shard: int = 2000, sample: int = 20_000, target: float = 0.98,
    queries: int = 256, most_queries: int = 4096, enough: int = 64,
) -> DataFrame:
    """(vec_id, n_links, component_id) for each row."""
    found = stored(nodes(vectors, vec_id, embedding), "nodes")
    count = found.count()
    audit = None
    while True:
        centers = _centroids(found, count, sample, shard, overlap)

        def search(rows: DataFrame) -> DataFrame:
            return _search(_assigned(rows, centers, overlap), threshold, shard)  # noqa: B023

        result = search(found)
        if overlap >= max((len(c) for c in centers.values()), default=1):
            break
        audit = audit or Audit(found, count, threshold, queries, most_queries, enough)
        if audit.recall(result, search) >= target:
            break
        overlap *= 2
    linked = _counted(result)
    usable = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    member = usable.join(found, "v", "left").join(linked, "rep", "left")
    edges = result.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    same = member.filter("rep IS NOT NULL AND vec_id != rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    groups = components(edges.union(same)).select(F.col("id").alias("vec_id"), "component")
    links = F.when(F.col("rep").isNotNull() & F.col("vec_id").isNotNull(), F.col("size") - 1 + F.coalesce("links", F.lit(0))).otherwise(0)
    out = member.select("vec_id", links.alias("n_links")).join(groups, "vec_id", "left")
    return out.select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
