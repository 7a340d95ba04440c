"""Mixing sources to target weights.

Documents are added up by membership pattern, that is, by the set of target sources they belong to. A flow network
leads from the patterns' tokens to the sources' quotas: a first use of a pattern's tokens is free, every further use
costs more than the one before, and a source takes no more of a pattern than max_repeats times its tokens. The
least-cost flow says how many tokens of each pattern every source gets; they are taken from the pattern's documents in
a seeded order, first those that no other source took.

The mix is the largest one in which all sources that have any tokens reach their weights; a source without any gets
nothing, and its weight falls to the others in proportion. A larger total can be asked for; then sources that cannot
repeat enough stay short and the report shows it.

Defined results: null sources and sources without a target are not in the mix, nor are documents without tokens (null
and empty texts). A null or negative weight counts as 0, a null max_repeats as 1; of repeated target rows of a source
the one with the largest weight holds. A source's tokens are met to within the halves of the documents at its
stretches' ends, two for each pattern of which it takes a part; most patterns are taken whole. Repeated rows are
documents of their own. Without documents or targets the mix is empty. The input's size changes no rule: any number of
patterns is planned with, and the seeded order is that of the documents' hashes alone.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.llm.tokens import VOCABULARY, token_counts
from weftline.session import buckets_for, cut_lineage, shared_folder

DOCUMENTS_PER_BUCKET, LEAST_BUCKETS = 5_000, 256
MOST_BROADCAST = 10_000


class Flow:
    """Least-cost flow from patterns to sources. A path into a source enters at a pattern and costs as much as the
    pattern's use there; then it may go on from source to source, where one gives a pattern's tokens to the next. So the
    cheapest paths come first if the uses of all patterns rise together, and the rest is a largest flow at every use.

    All is done for many patterns at once, by arrays of a source's patterns, in the patterns' order; so but for one
    pattern a step, patterns are taken by whole uses.
    """

    def __init__(self, member: np.ndarray, tokens: np.ndarray, repeats: list[int], quotas: list[int]):
        self.tokens, self.need, self.top = tokens, list(quotas), max(quotas, default=0)
        self.taken = np.zeros(member.shape, np.int64)
        # Whole uses, more than the quota at most by one, which keeps products small.
        self.spare = np.zeros(member.shape, np.int64)
        for s, own in enumerate(member):
            self.spare[s, own] = np.minimum(repeats[s], quotas[s] // tokens[own] + 1) * tokens[own]
        self.used = np.zeros(len(tokens), np.int64)
        self.room = self.used

    def _entry(self, s: int) -> np.ndarray:
        return np.minimum(self.room, self.spare[s])

    def _passed(self, a: int, b: int) -> np.ndarray:
        """Tokens of each pattern that a can leave to b."""
        return np.minimum(self.taken[a], self.spare[b])

    def _leading(self) -> list[int]:
        """The sources that are short and those that can pass tokens on to them."""
        found = [s for s, n in enumerate(self.need) if n]
        left = [s for s, n in enumerate(self.need) if not n]
        for b in found:
            joined = [a for a in left if self._passed(a, b).any()]
            found += joined
            left = [a for a in left if a not in joined]
        return found

    def _path(self, sources: list[int]) -> list[int] | None:
        """The shortest path of sources from one with an entry to one that is short."""
        after: dict[int, int | None] = {s: None for s in sources if self.need[s]}
        queue = list(after)
        for s in queue:
            if self._entry(s).any():
                path = [s]
                while (s := after[s]) is not None:
                    path.append(s)
                return path
            for a in sources:
                if a not in after and self._passed(a, s).any():
                    after[a] = s
                    queue.append(a)
        return None

    def _push(self, path: list[int]) -> None:
        hops = list(itertools.pairwise(path))
        parts = [self._entry(path[0])] + [self._passed(a, b) for a, b in hops]
        amount = int(min(self.need[path[-1]], *(p.sum(dtype=float) for p in parts), math.inf))
        # From the end, so that what a source gives is gone before it gets more.
        for a, b in reversed(hops):
            part = _first(self._passed(a, b), amount)
            self.taken[a] -= part
            self.spare[a] += part
            self.taken[b] += part
            self.spare[b] -= part
        part = _first(self._entry(path[0]), amount)
        self.taken[path[0]] += part
        self.spare[path[0]] -= part
        self.room -= part
        self.used += part
        self.need[path[-1]] -= amount

    def run(self) -> np.ndarray:
        """Tokens each source (row) takes of each pattern (column)."""
        step = 1
        while any(self.need):
            sources = self._leading()
            useful = (self.spare[sources] > 0).any(axis=0)
            uses = self.used // self.tokens
            # Several uses at once are the same as one after another if all of them are taken; otherwise they are undone.
            saved = (self.taken.copy(), self.spare.copy(), self.used.copy(), list(self.need)) if step > 1 else None
            rise = np.minimum(int(uses[useful].min()) + step - uses, self.top // self.tokens + 1)
            self.room = np.maximum(rise * self.tokens - self.used % self.tokens, 0)
            while (path := self._path(sources)) is not None:
                self._push(path)
            if saved and any(self._entry(s).any() for s in sources):
                self.taken, self.spare, self.used, self.need = saved
                step //= 2
            else:
                step *= 2
        return self.taken


def _first(parts: np.ndarray, amount: int) -> np.ndarray:
    """Of the parts, the first that make up the amount."""
    return np.clip(amount - (np.cumsum(parts, dtype=float) - parts), 0, parts).astype(np.int64)


def _most(member: np.ndarray, tokens: np.ndarray, repeats: list[int]) -> list[int]:
    """The most each source can take. Sources do not take it from each other, as each repeats on its own account."""
    return [int(tokens[own].sum()) * r for own, r in zip(member, repeats)]


def _asked(most: list[int], weights: list[float], total: int | None) -> list[int]:
    """Tokens asked of each source; without a total, of the largest mix in which they all can give them."""
    whole = sum(weights)
    quotas = lambda size: [int(size * w / whole) for w in weights]
    if total is None:
        total = sum(most)
        while any(q > m for q, m in zip(quotas(total), most)):
            total = min(total - 1, int(min(m * whole / w for m, w in zip(most, weights))))
    return quotas(total)


def _filled(member: np.ndarray, tokens: np.ndarray, repeats: list[int], quotas: list[int]) -> np.ndarray:
    return Flow(member, tokens, repeats, [min(q, m) for q, m in zip(quotas, _most(member, tokens, repeats))]).run()


def _arrays(patterns: dict[frozenset, int], names: list[str]) -> tuple[list[frozenset], np.ndarray, np.ndarray]:
    keys = sorted((k for k in patterns if patterns[k] > 0), key=lambda k: (len(k), sorted(k)))
    return keys, np.array([[s in k for k in keys] for s in names], bool).reshape(len(names), len(keys)), np.array([patterns[k] for k in keys], np.int64)


def route(patterns: dict[frozenset, int], repeats: dict[str, int], quotas: dict[str, int]) -> dict[tuple[frozenset, str], int]:
    """Tokens of each pattern for each source; the first use of tokens comes before a second one, and so on."""
    names = sorted(quotas)
    keys, member, tokens = _arrays(patterns, names)
    taken = _filled(member, tokens, [repeats[s] for s in names], [quotas[s] for s in names])
    return {(keys[i], names[s]): int(taken[s, i]) for s, i in zip(*np.nonzero(taken))}


def plan(
    patterns: dict[frozenset, int], weights: dict[str, float], repeats: dict[str, int], total: int | None = None
) -> tuple[dict[tuple[frozenset, str], int], frozenset, dict[str, int]]:
    """The routes of the mix, the sources that take part, and the tokens asked of each; without a total, of the largest
    mix in which they all meet their weights. Patterns count without the sources that take no part.
    """
    alive = frozenset(s for key, tokens in patterns.items() if tokens > 0 for s in key if weights.get(s, 0) > 0 and repeats[s] > 0)
    if not alive:
        return {}, alive, {}
    merged: dict[frozenset, int] = {}
    for key, tokens in patterns.items():
        if tokens > 0 and key & alive:
            merged[key & alive] = merged.get(key & alive, 0) + tokens
    names = sorted(alive)
    _, member, held = _arrays(merged, names)
    wanted = dict(zip(names, _asked(_most(member, held, [repeats[s] for s in names]), [weights[s] for s in names], total)))
    return route(merged, repeats, wanted), alive, wanted


def mix(
    documents: DataFrame, targets: DataFrame, seed: int = 17, total: int | None = None, vocabulary: str = VOCABULARY,
    most_patterns: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, copies, n_tokens) and its report, one row a target source.

    documents has doc_id, text, and source as a text or, where sources overlap, a list of texts. The driver gets the
    targets and the patterns' sums, which are as many as the sets of target sources that occur; all of them are planned
    with. Only a caller who gives most_patterns has documents count for one of their sources where there are more.
    """
    spark = documents.sparkSession
    rows = targets.groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("t")).where("source IS NOT NULL").collect()
    weights = {r["source"]: max(0.0, r["t"]["weight"] or 0.0) for r in rows}
    repeats = {r["source"]: max(0, 1 if r["t"]["max_repeats"] is None else r["t"]["max_repeats"]) for r in rows}
    named = lambda sources: F.array(*map(F.lit, sorted(sources))).cast("array<string>")
    listed = F.col("source") if documents.schema["source"].dataType.typeName() == "array" else F.array("source")
    pattern = F.array_sort(F.array_distinct(F.array_intersect(F.coalesce(listed, named([])), named(weights))))
    members = documents.select("doc_id", "text", pattern.alias("pattern")).where((F.size("pattern") > 0) & F.col("text").isNotNull())
    sized = cut_lineage(token_counts(members, vocabulary=vocabulary).where("n_tokens > 0"))
    longest = dict.fromkeys(weights, 0)
    idle = [s for s in weights if not (weights[s] > 0 and repeats[s] > 0)]
    if idle:
        # Sources that take nothing do not part documents into patterns; only the report has them.
        held = sized.select(F.explode(F.array_intersect("pattern", named(idle))).alias("s"), "n_tokens").groupBy("s")
        longest |= {r["s"]: r["longest"] for r in held.agg(F.max("n_tokens").alias("longest")).collect()}
        sized = sized.withColumn("pattern", F.array_except("pattern", named(idle))).where(F.size("pattern") > 0)
    sums = sized.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"), F.max("n_tokens").alias("longest"))
    if most_patterns is not None and sums.limit(most_patterns + 1).count() > most_patterns:
        held = sized.select(F.explode("pattern").alias("s"), "n_tokens").groupBy("s").agg(F.sum("n_tokens").alias("n")).collect()
        ranks = F.create_map(*[F.lit(x) for i, r in enumerate(sorted(held, key=lambda r: (r["n"], r["s"]))) for x in (r["s"], i)])
        scarce = F.array_min(F.transform("pattern", lambda x: F.struct(ranks[x].alias("rank"), x.alias("s"))))["s"]
        sized = cut_lineage(sized.withColumn("pattern", F.array(scarce)))
        sums = sized.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"), F.max("n_tokens").alias("longest"))
    found = sums.toArrow().combine_chunks()
    keys = pa.concat_arrays([pa.array([], pa.list_(pa.string())), *(c.cast(pa.list_(pa.string())) for c in found["pattern"].chunks)])
    names = sorted(pc.unique(keys.flatten()).to_pylist())
    member = np.zeros((len(names), len(keys)), bool)
    if names:
        member[pc.index_in(keys.flatten(), pa.array(names)).to_numpy(), np.repeat(np.arange(len(keys)), pc.list_value_length(keys).to_numpy())] = True
    tokens, most = found["n"].to_numpy(), found["longest"].to_numpy()
    longest |= {s: int(most[own].max()) for s, own in zip(names, member)}
    if names:
        # Patterns of few sources first, which leave the others for those who need them.
        ranked = np.lexsort((*~member[::-1], member.sum(axis=0)))
        keys, member, tokens = keys.take(pa.array(ranked)), member[:, ranked], tokens[ranked]
    buckets = buckets_for(int(found["rows"].to_numpy().sum()), DOCUMENTS_PER_BUCKET, LEAST_BUCKETS)
    times = [repeats[s] for s in names]
    asked = _asked(_most(member, tokens, times), [weights[s] for s in names], total) if names else []
    taken = _filled(member, tokens, times, asked)
    asked = dict(zip(names, asked))

    # All documents of a pattern lie on a ring in a seeded order, each as long as its tokens. A source takes the stretch
    # behind the one before it, as often round the ring as its route asks for; so no document is used twice while
    # another is unused.
    stretches, at = [], np.zeros(len(tokens), np.int64)
    for s, part in zip(names, taken):
        stop = (at + part) % tokens
        own = np.flatnonzero(part)
        ring = tokens[own]
        stretches.append(pa.table({
            "pattern": keys.take(pa.array(own)), "source": pa.array([s] * len(own), pa.string()), "whole": (part[own] // ring).astype(np.int32),
            "rest": part[own] % ring, "start": at[own], "stop": stop[own], "ring": ring,
        }))
        at = stop
    # One row for each pattern and source; broadcast only while that is few. Many are written, a source at a time, so that
    # plans and tasks do not carry them.
    schema = "pattern ARRAY<STRING>, source STRING, whole INT, rest BIGINT, start BIGINT, stop BIGINT, ring BIGINT"
    few = sum(map(len, stretches)) <= MOST_BROADCAST
    small = F.broadcast if few else lambda df: df
    if few:
        drawn = spark.createDataFrame(pa.concat_tables(stretches), schema) if stretches else spark.createDataFrame([], schema)
    else:
        folder = shared_folder(spark, "stretches")
        for part in stretches:
            spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        drawn = spark.read.schema(schema).parquet(folder)
    order = F.xxhash64(F.lit(seed), "doc_id")
    # Buckets are ranges of that order, so their number does not change it.
    range_of = F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * F.lit(buckets))
    placed = sized.withColumn("place", order).withColumn("bucket", range_of)
    group = W.partitionBy("pattern")
    filled = placed.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("held"))
    before = F.sum("held").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    filled = filled.withColumn("before", F.coalesce(before, F.lit(0)))
    # Only a bucket with a stretch's end inside is put in order document by document; any other lies on one side of it.
    inside = lambda e: (F.col(e) > F.col("before")) & (F.col(e) < F.col("before") + F.col("held"))
    ends = drawn.select("pattern", F.explode(F.array("start", "stop")).alias("e"))
    cut = filled.join(small(ends), "pattern").where(inside("e")).select("pattern", "bucket").distinct().withColumn("cut", F.lit(True))
    known = placed.join(filled.join(cut, ["pattern", "bucket"], "left"), ["pattern", "bucket"])
    inner = F.sum("n_tokens").over(W.partitionBy("pattern", "bucket").orderBy("place", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1))
    exact = known.where("cut").withColumn("middle", F.col("before") + F.coalesce(inner, F.lit(0)) + F.col("n_tokens") / 2)
    rough = known.where("cut IS NULL").withColumn("middle", F.col("before") + F.col("held") / 2)
    drawn_by = exact.unionByName(rough).join(small(drawn), "pattern")
    beyond = F.pmod(F.col("middle") - F.col("start"), F.col("ring").cast("double"))
    copies = F.col("whole") + (beyond < F.col("rest")).cast("int")
    chosen = drawn_by.select("doc_id", "source", copies.alias("copies"), "n_tokens").where("copies > 0")

    got = chosen.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies")
    )
    goals = [(s, float(weights[s]), repeats[s], asked.get(s, 0), longest[s]) for s in sorted(weights)]
    goal = spark.createDataFrame(goals, "source STRING, weight DOUBLE, max_repeats INT, asked BIGINT, longest BIGINT")
    # As many rows as there are targets.
    every = F.sum("tokens").over(W.partitionBy())
    report = goal.join(got, "source", "left").select(
        "source", "weight", "max_repeats", "asked", "longest", F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / every, F.lit(0.0)).alias("share"),
    )
    return chosen, report
