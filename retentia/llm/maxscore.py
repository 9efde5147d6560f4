"""Exact top-k inner-product search by MaxScore.

Vectors become integers, floor(256 * x). A query's terms are the dimensions
and a dimension's posting list holds the value of every vector of a shard. Per shard each
term has a score bound, the query's value times the highest or lowest value of the
list. With a score to beat, the terms of a query split: the non-essential
ones are the longest run of terms with the smallest spread whose bounds together cannot
reach that score. Essential postings are traversed whole; the others are
probed, a few terms at a time, only for the vectors that can still compete.
The score to beat starts from a few fully scored vectors of the shard. A
shard's best entries are exact, so the best of all shards are exact too.

Queries and vectors are cut into blocks and shards of bounded size; each
(block, shard) is one group, the unit that Spark schedules and repeats. Equal
rows are one entry with a count, so a row that repeats without end is one row.

Defined results: vectors that are null or hold null or non-finite components
take no part; a shorter vector has zeros for what it lacks (an empty one
scores 0); equal rows are candidates of each other and each gets its own
result rows; a null id is a candidate (last among ties) and never a query; an
empty table gives no rows. Components beyond a long saturate there, scores
are exact (Python integers where 64-bit floats would round), and one beyond a
long counts as the largest or smallest long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.common import discard, materialise

# Vectors of a shard and queries of a block: bound the memory of one group.
SHARD = 2048
BLOCK = 4096
# Vectors of a shard that are scored in full first, for the score to beat.
SEEDS = 256
# Non-essential terms probed between two looks at who still competes.
STEP = 8
LONG = 2**63 - 1

FOUND = "query_id long, query_hash long, copies long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, n): the valid integer vectors, equal rows once with their number."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("e"))
            .filter(F.col("e").isNotNull()).filter(finite)
            .select("vec_id", F.transform("e", lambda x: F.floor(x * float(scale))).alias("v"))
            .groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    if len({len(r) for r in rows}) == 1 and len(rows.iloc[0]) == width:
        return np.stack(rows.to_numpy()).astype(np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """The cheapest number type in which every inner product of a's and b's rows is exact."""
    peak = max(1, a.shape[1]) * max((abs(int(x)) for x in (a.min(initial=0), a.max(initial=0))), default=0) \
        * max(abs(int(x)) for x in (b.min(initial=0), b.max(initial=0)))
    return np.float32 if peak < 2**24 else np.float64 if peak < 2**53 else object


def competitors(query: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray, beat: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of every vector whose score is ``beat`` or more; some others may be among them."""
    bound = np.where(query > 0, query * high, query * low)
    order = np.argsort(-(np.abs(query) * (high - low)).astype(np.float64), kind="stable")
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # bound of the terms from a place on
    weaker = np.flatnonzero(rest < beat)
    essential = len(query) if not len(weaker) else int(weaker[0])
    places, score = None, query[order[:essential]] @ postings[order[:essential]]
    for at in range(essential, len(query), STEP):
        alive = np.flatnonzero(score + rest[at] >= beat)
        places = alive if places is None else places[alive]
        terms = order[at: at + STEP]
        score = score[alive] + query[terms] @ postings[np.ix_(terms, places)]
    return (np.arange(postings.shape[1]) if places is None else places), score


def search_shard(docs: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best entries of a shard for each query of a block."""
    names = ["query_id", "query_hash", "copies", "vec_id", "score"]
    if not len(docs) or not len(queries):
        return pd.DataFrame({n: pd.Series(dtype="Int64") for n in names})
    docs = docs.sort_values("vec_id", na_position="last", kind="stable")
    width = max(max(map(len, docs["v"])), max(map(len, queries["v"])))
    d, q = _matrix(docs["v"], width), _matrix(queries["v"], width)
    kind = _exact(d, q)
    ids = docs["vec_id"].astype("Int64")
    no_id, id_of = ids.isna().to_numpy(), ids.fillna(0).to_numpy(np.int64)
    count = docs["n"].to_numpy(np.int64)
    postings = np.ascontiguousarray(d.T.astype(kind))
    high, low = (postings.max(1), postings.min(1)) if width else (np.zeros(0, kind), np.zeros(0, kind))
    weights = q.astype(kind)
    beat = np.full(len(q), -np.inf)
    if min(SEEDS, len(d)) > k and kind is not object:  # the (k + 1)-th, as one may be the query's own row
        beat = -np.partition(-(weights @ postings[:, :SEEDS]), k, axis=1)[:, k]
    out: list[list] = [[], [], [], [], []]
    for i, (query_id, query_hash, copies) in enumerate(zip(queries["vec_id"], queries["query_hash"], queries["n"], strict=True)):
        places, score = competitors(weights[i], postings, high, low, beat[i])
        here = count[places]
        own = np.flatnonzero((id_of[places] == query_id) & ~no_id[places])
        own = own[(d[places[own]] == q[i]).all(1)] if len(own) else own
        lengths = [len(docs["v"].iloc[places[j]]) == len(queries["v"].iloc[i]) for j in own]
        here[own[np.asarray(lengths, bool)]] -= 1
        keep = here > 0
        places, score, here = places[keep], score[keep], here[keep]
        if kind is object:
            score = np.array([max(-LONG - 1, min(LONG, int(x))) for x in score], object)
        best = np.argsort(-score, kind="stable")[:k]  # places stand in the order of ids
        best = np.repeat(best, np.minimum(here[best], k))[:k]
        n = len(best)
        out[0] += [query_id] * n
        out[1] += [query_hash] * n
        out[2] += [copies] * n
        out[3] += [None if no_id[p] else int(id_of[p]) for p in places[best]]
        out[4] += [int(x) for x in score[best]]
    return pd.DataFrame({n: pd.array(c, dtype="Int64") for n, c in zip(names, out, strict=True)})


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row whose id is divisible by ``every``."""
    rows = materialise(integer_vectors(vectors, id_col, vector_col, scale), "vectors")
    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("query_hash", F.xxhash64("vec_id", "v"))
    shards, blocks = -(-rows.count() // SHARD), -(-queries.count() // BLOCK)
    if not blocks:
        discard(rows)
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    grid = ["shard", "block"]
    left = (rows.withColumn("shard", F.pmod(F.xxhash64("v", "vec_id"), F.lit(shards)))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (queries.withColumn("block", F.pmod(F.xxhash64("query_hash"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))
    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(lambda a, b: search_shard(a, b, k), FOUND)
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    merged = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    # Equal query rows each get their result; a row that repeats without end is dealt out before it is repeated.
    some = 1 << 16
    dealt = (merged.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {some}"))))
             .repartition("query_id", "query_hash", "part"))
    return dealt.select("query_id", "rank", "vec_id", "score",
                        F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(some).cast("long"), F.col("copies") - F.col("part") * some))).alias("copy")).drop("copy")
