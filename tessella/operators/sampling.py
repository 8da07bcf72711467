"""Downsampling, sampling and iterative search over factorised spaces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalars import size_cap


def seeded_order(seed: int, *cols: str) -> Column:
    """A pseudo-random order that depends on the seed and the columns alone."""
    return F.xxhash64(F.lit(seed), *cols)


def _tanimoto_rows(fps: np.ndarray, one: np.ndarray) -> np.ndarray:
    both = np.bitwise_count(fps & one).sum(axis=1, dtype=np.int64)
    either = np.bitwise_count(fps | one).sum(axis=1, dtype=np.int64)
    return np.divide(both, either, out=np.zeros(len(fps)), where=either > 0)


def k_centers(items: DataFrame, min_similarity: float = 0.75, max_centers: int = 8, scale: float = 0.0, offset: float = 0.0, seed: int = 42, by: tuple[str, ...] = ("rxn_id", "set_idx")) -> DataFrame:
    """Greedy k-centers within every set of ``items(by..., item, fp)``.

    Items come in seeded order; one opens a center if no center is at least
    ``min_similarity`` to it and fewer than the cap are open, else it joins the most similar
    (the earliest on ties). With ``scale`` the cap is ``ceil(scale * sqrt(n) + offset)``, at
    most ``max_centers``. Returns ``by..., item, center, similarity``. Only the centers are
    held in memory, the items of a set stream past them.
    """
    sizes = items.groupBy(*by).agg(F.count("*").alias("n_"))
    cap = size_cap(F.col("n_"), scale, offset, max_centers) if scale > 0 else F.lit(max_centers)
    ordered = items.join(sizes.select(*by, cap.cast("int").alias("cap_")), list(by)).withColumn("o_", seeded_order(seed, "item"))
    kinds = dict(items.dtypes)

    def one_set(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["o_", "item"])
        fps = np.stack([np.asarray(x, dtype=np.int64) for x in frame["fp"]])
        cap, items_ = int(frame["cap_"].iloc[0]), frame["item"].tolist()
        centers: list[int] = []
        center_fps = np.zeros_like(fps[:cap])
        out = []
        for i, fp in enumerate(fps):
            sims = _tanimoto_rows(center_fps[: len(centers)], fp)
            best = int(np.argmax(sims)) if len(sims) else -1
            if best < 0 or (sims[best] < min_similarity and len(centers) < cap):
                center_fps[len(centers)] = fp
                centers.append(i)
                out.append((*key, items_[i], items_[i], 1.0))
            else:
                out.append((*key, items_[i], items_[centers[best]], float(sims[best])))
        return pd.DataFrame(out, columns=[*by, "item", "center", "similarity"])

    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), f"item {kinds['item']}", f"center {kinds['item']}", "similarity double"])
    return ordered.groupBy(*by).applyInPandas(one_set, schema)


def reaction_weights(sizes: DataFrame, exponent: float = 0.5, least: float = 1e-6) -> DataFrame:
    """``max(least, exp(e * (sum of ln n) - largest))`` of every reaction.

    ``sizes(rxn_id, set_idx, n)``.
    """
    logs = sizes.groupBy("rxn_id").agg((F.lit(exponent) * F.sum(F.log("n"))).alias("l"))
    top = logs.agg(F.max("l").alias("top"))
    return logs.crossJoin(F.broadcast(top)).select("rxn_id", F.greatest(F.lit(least), F.exp(F.col("l") - F.col("top"))).alias("weight"))  # one row


def bucketed_weights(sizes: DataFrame, limits: tuple[int, ...] = (10, 100, 1000), weights: tuple[float, ...] = (1.0, 2.0, 3.0, 4.0)) -> DataFrame:
    """F23, second form: the product of a weight for the size class of every set."""
    w = F.lit(weights[-1])
    for limit, value in reversed(list(zip(limits, weights))):
        w = F.when(F.col("n") < limit, value).otherwise(w)
    return sizes.groupBy("rxn_id").agg(F.exp(F.sum(F.log(w))).alias("weight"))


def picks(n: Column, seed: int, *cols: str) -> Column:
    """A hash-based choice among ``n``: the first seven hex digits of an md5, modulo ``n``."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *cols)), 1, 7), 16, 10).cast("long"), n)


def random_assemblies(synthons: DataFrame, attempts: int, seed: int = 0) -> DataFrame:
    """``attempts`` random products of every reaction: ``rxn_id, attempt, set_idx, frag_id``.

    Members are numbered within their set; every attempt picks a number by hash, and one
    equi-join on (reaction, set, number) finds the members.
    """
    w = Window.partitionBy("rxn_id", "set_idx")
    numbered = synthons.select("rxn_id", "set_idx", "frag_id", (F.row_number().over(w.orderBy("frag_id")) - 1).cast("long").alias("k"))
    sets = synthons.groupBy("rxn_id", "set_idx").agg(F.count("*").alias("n"))
    tries = sets.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    chosen = tries.withColumn("k", picks(F.col("n"), seed, F.col("rxn_id").cast("string"), F.col("set_idx").cast("string"), F.col("attempt").cast("string")))
    return chosen.join(numbered, ["rxn_id", "set_idx", "k"]).select("rxn_id", "attempt", "set_idx", "frag_id")


def weighted_reactions(weights: DataFrame, jobs: DataFrame, seed: int = 0) -> DataFrame:
    """A reaction for every row of ``jobs(job_id)`` by inverse weights.

    Reactions get consecutive ranges of the unit interval; a job's hash falls in one. Ranges
    are cut at a grid, so the range join is an equality on the cell with a residual.
    """
    grid = 1024
    w = Window.orderBy("rxn_id")  # reactions of a space: a small dimension
    total = Window.partitionBy()
    spans = weights.withColumn("hi", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(total))
    spans = spans.withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0)))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * grid), F.least(F.floor(F.col("hi") * grid), F.lit(grid - 1).cast("long")))))
    u = F.pmod(F.xxhash64(F.lit(seed), "job_id"), F.lit(1 << 40).cast("long")) / float(1 << 40)
    drawn = jobs.withColumn("u", u).withColumn("cell", F.floor(F.col("u") * grid))
    return drawn.join(cells, "cell").where("u >= lo and u < hi").select("job_id", "rxn_id")


def neighbour_table(items: DataFrame, top: int = 100, by: tuple[str, ...] = ("rxn_id", "set_idx")) -> DataFrame:
    """X11: the ``top`` most similar members of the same set for every member, itself aside."""
    from tessella.functions import bits

    left = items.select(*by, F.col("item").alias("a"), F.col("fp").alias("fa"))
    right = items.select(*by, F.col("item").alias("b"), F.col("fp").alias("fb"))
    near = left.join(right, list(by)).where("a <> b").withColumn("similarity", bits.tanimoto(F.col("fa"), F.col("fb"))).drop("fa", "fb")
    w = Window.partitionBy(*by, "a").orderBy(F.desc("similarity"), "b")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)


def sampled_neighbours(table: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A seeded choice of ``k`` of every member's neighbours."""
    w = Window.partitionBy("a").orderBy(seeded_order(seed, "a", "b"))
    return table.withColumn("s", F.row_number().over(w)).where(F.col("s") <= k).drop("s")


Scorer = Callable[[np.ndarray], np.ndarray]


def beam_search(seeds: DataFrame, members: DataFrame, target: list[int], beam: int = 4, rounds: int = 6, patience: int = 2, per_position: int = 2, neighbours: int = 16, seed: int = 0) -> DataFrame:
    """Improve seeds ``(seed_id, rxn_id, frag_ids)`` one position at a time.

    The score of an assembly is the Tanimoto similarity of the union of its members'
    bitsets to ``target``. Every round tries, at every position of every assembly in the
    beam, the most similar members of that set; at most ``per_position`` new assemblies of
    a position enter the next beam. Ends after ``rounds``, or ``patience`` rounds without a
    better best, or when nothing new is left. The seeds of a reaction are searched beside
    its sets: ``members(rxn_id, set_idx, frag_id, fp)``.
    """
    goal = np.array(target, dtype=np.int64)

    def search(key: tuple, own: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        out = []
        names = {s: f["frag_id"].tolist() for s, f in sets.sort_values("frag_id").groupby("set_idx")}
        fps = {s: np.stack(f["fp"].tolist()).astype(np.int64) for s, f in sets.sort_values("frag_id").groupby("set_idx")}
        order = sorted(names)
        for row in own.itertuples():
            start = tuple(names[s].index(f) for s, f in zip(order, row.frag_ids))

            def score(a: tuple[int, ...]) -> float:
                merged = np.bitwise_or.reduce([fps[s][i] for s, i in zip(order, a)])
                return float(_tanimoto_rows(merged[None], goal)[0])

            seen = {start: score(start)}
            current, best, calm, reason, done = [start], seen[start], 0, "rounds", 0
            for done in range(1, rounds + 1):
                found: list[tuple[float, tuple[int, ...], int]] = []
                for a in current:
                    for p, s in enumerate(order):
                        near = np.argsort(-_tanimoto_rows(fps[s], fps[s][a[p]]), kind="stable")[: neighbours + 1]
                        for i in near.tolist():
                            b = a[:p] + (i,) + a[p + 1 :]
                            if b not in seen:
                                seen[b] = score(b)
                                found.append((seen[b], b, p))
                if not found:
                    reason = "exhausted"
                    break
                taken: list[tuple[int, ...]] = []
                used = dict.fromkeys(range(len(order)), 0)
                for value, b, p in sorted(found, key=lambda f: (-f[0], f[1])):
                    if len(taken) < beam and used[p] < per_position:
                        taken.append(b)
                        used[p] += 1
                current = taken
                top = max(seen[b] for b in taken)
                calm = 0 if top > best else calm + 1
                best = max(best, top)
                if calm >= patience:
                    reason = "patience"
                    break
            winner = min(seen, key=lambda b: (-seen[b], b))
            out.append((row.seed_id, key[0], [names[s][i] for s, i in zip(order, winner)], seen[winner], seen[start], done, reason))
        return pd.DataFrame(out, columns=["seed_id", "rxn_id", "frag_ids", "score", "seed_score", "rounds", "reason"])

    schema = "seed_id long, rxn_id string, frag_ids array<string>, score double, seed_score double, rounds int, reason string"
    own = members.select(F.col("rxn_id").alias("m_rxn_id"), "set_idx", "frag_id", "fp")
    return seeds.groupBy("rxn_id").cogroup(own.groupBy("m_rxn_id")).applyInPandas(search, schema)


def diverse(items: list[np.ndarray], k: int) -> Iterator[int]:
    """Max-min choice: the item farthest from all chosen so far, the first item first."""
    if not items:
        return
    fps = np.stack(items)
    far = np.full(len(items), np.inf)
    at = 0
    for _ in range(min(k, len(items))):
        yield at
        far = np.minimum(far, 1 - _tanimoto_rows(fps, fps[at]))
        far[at] = -1
        at = int(np.argmax(far))
