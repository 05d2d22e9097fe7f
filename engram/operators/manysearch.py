"""Many searches as one lazy plan, keyed by ``query_id``.

Every recall list comes from one pass over the memories: the rows of a cube are dealt to
parts, each of which meets a copy of the cube's queries once, as matrices and posting
lists.  A part keeps the best k candidates of each query (by vector, by words, by key,
tags or entities), and each query the best k of all parts.  What a query has found so
far, a few times k rows, is one array; fusion, hops, penalties, rescoring, selection and
ranking carry it on.  The last hop, where hubs reach whole tables, also meets the rows by
parts.  Nothing runs before the result is asked for.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram import models
from engram.functions import scoring, text, vector
from engram.operators import dedup, graph
from engram.schema import SKILL_TYPES, TEXT_TYPES, TOOL_TYPES

#: Parts that the rows of a cube are dealt to, each of which meets a copy of the cube's queries.
SALT = 32
#: A staged search needs so many rows, looks at so many, and shortlists so many.
STAGE_LEAST, STAGE_FIRST, STAGE_SHORTLIST = 5, 50, 10
#: Candidates of a contradiction, and edges that are followed.
PENALTY_TOP, PENALTY_EDGES = 10, 20

#: Scores of a tile of queries by rows, and the slack under the k-th of them before the exact ones are taken.
TILE, SLACK = 1 << 20, 1e-9
#: A reached row is one number, hop * HOP + place of its seed.
HOP, NEVER = 1 << 24, 1 << 40

_CANDIDATE = "query_id long, id string, score double, memory string, bucket string, embedding array<double>"


def request_rows(spark, requests: list[dict]) -> DataFrame:
    """Queries (query_id, query, vector, cubes) out of requests as ``search.resolve_params`` takes them."""
    rows = [(i, r.get("query", ""), [float(x) for x in r.get("vector", ())], list(r.get("cubes", ()))) for i, r in enumerate(requests)]
    return spark.createDataFrame(rows, "query_id long, query string, vector array<double>, cubes array<string>")


def types_of(p) -> list[str]:
    if p.level != "l3":
        return {"l1": ["WorkingMemory"], "l2": ["EpisodicMemory"]}[p.level]
    return TEXT_TYPES + (SKILL_TYPES if p.include_skill else []) + (TOOL_TYPES if p.include_tool else [])


def in_scope(memory: DataFrame, p) -> DataFrame:
    """Rows that any query with these parameters may see; cubes are matched later."""
    rows = memory.where((F.col("status") == "activated") & F.col("memory_type").isin(*types_of(p)))
    rows = rows.where(F.col("user_id") == p.user_id) if p.user_id else rows
    return rows.where(F.col("agent_id") == p.agent_id) if p.agent_id else rows


def _queries(queries: DataFrame) -> DataFrame:
    tokens = F.array_distinct(text.keywords(F.coalesce("query", F.lit(""))))
    return queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("vector", F.array().cast("array<double>")).cast("array<double>").alias("vector"), "cubes", F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))


def _salted(rows: DataFrame, q: DataFrame) -> DataFrame:
    """Rows (user_name, id, ...) of the cubes that a query asks for, dealt to parts, so that a hot cube is many tasks."""
    cubes = q.select(F.explode("cubes").alias("user_name")).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(cubes, ["user_name", "salt"], "left_semi")


def _met(rows: DataFrame, q: DataFrame, meet, schema: str) -> DataFrame:
    """``meet`` (rows, queries), as Arrow tables, of each part of a cube and the queries (cubes, ...) of the cube."""
    each = q.withColumn("user_name", F.explode(F.array_distinct("cubes"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).drop("cubes")

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return meet(left.sort_by("id"), right) if left.num_rows and right.num_rows else _table(schema, [[]] * len(schema.split(",")))

    return _salted(rows, q).groupBy("user_name", "salt").cogroup(each.groupBy("user_name", "salt")).applyInArrow(both, schema)


def _table(schema: str, columns: list) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    named = [c.split() for c in schema.split(", ")]
    return pa.table([c.cast(kinds[k]) if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for (_, k), c in zip(named, columns)], [n for n, _ in named])


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A list column's values, and the start and the length of each row's."""
    one = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(one), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return one.flatten(), np.cumsum(sizes) - sizes, sizes


def _places(values: pa.Array, of: pa.Array) -> np.ndarray:
    """Where each value is in ``of``, else -1."""
    return pc.fill_null(pc.index_in(values, value_set=of), -1).to_numpy(zero_copy_only=False)


class _Vectors:
    """A column of vectors as matrices, one for each length that is asked for."""

    def __init__(self, column: pa.ChunkedArray):
        values, self.starts, self.sizes = _lists(column)
        self.none = column.is_null().to_numpy()
        self.flat = values.to_numpy(zero_copy_only=False).astype(float)
        holes = np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)) if values.null_count else np.array([], int)
        self.holes = np.zeros(len(self.sizes), bool)
        self.holes[np.repeat(np.arange(len(self.sizes)), self.sizes)[holes]] = True
        self._held: dict = {}

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors, 0 where they have another length, and their norms."""
        if size not in self._held:
            x = np.zeros((len(self.sizes), size))
            at = np.flatnonzero(self.sizes == size)
            x[at] = self.flat[self.starts[at][:, None] + np.arange(size)]
            self._held[size] = x, np.sqrt(_dots(x, x))
        return self._held[size]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added in the order of ``vector.dot``."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _cosines(q: _Vectors, lot: np.ndarray, rows: _Vectors) -> np.ndarray:
    """Cosines, to within ``SLACK``, of a lot of queries with all rows; -inf where there is none, 2 for a NaN."""
    out = np.full((len(lot), len(rows.sizes)), -np.inf)
    for size in np.unique(q.sizes[lot]):
        if size:
            at = np.flatnonzero(q.sizes[lot] == size)
            (a, na), (b, nb) = q.of(size), rows.of(size)
            with np.errstate(all="ignore"):
                s = (a[lot[at]] / np.where(na[lot[at]] == 0, 1, na[lot[at]])[:, None]) @ (b / np.where(nb == 0, 1, nb)[:, None]).T
            s = np.where(np.isnan(s), 2.0, s)
            s[:, rows.none] = -np.inf
            s[(rows.holes[None, :] | q.holes[lot[at]][:, None]) & (rows.sizes == size)[None, :]] = -np.inf
            out[at] = s
    return out


def _exact(q: _Vectors, qi: np.ndarray, rows: _Vectors, ri: np.ndarray) -> np.ndarray:
    """The cosines of pairs as ``vector.cosine`` gives them."""
    out = np.zeros(len(qi))
    for size in np.unique(q.sizes[qi]):
        at = np.flatnonzero((q.sizes[qi] == size) & (rows.sizes[ri] == size))
        (a, na), (b, nb) = q.of(size), rows.of(size)
        with np.errstate(all="ignore"):
            n = na[qi[at]] * nb[ri[at]]
            out[at] = np.where(n == 0, 0.0, _dots(a[qi[at]], b[ri[at]]) / np.where(n == 0, 1, n))
    return out


def _may_enter(s: np.ndarray, k: int) -> np.ndarray:
    """Scores that may be among the best ``k`` of their row."""
    some = s > -np.inf
    if s.shape[1] > k:
        some &= s >= (np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - SLACK)[:, None]
    return some


def _first(qi: np.ndarray, ri: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` of each query, ties by row; a NaN is above all, as in Spark."""
    order = np.lexsort((ri, -np.where(np.isnan(score), np.inf, score), qi))
    sorted_q = qi[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q) < k]


def _postings(column: pa.ChunkedArray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that hold each of the words, once an occurrence: rows, and where each word's begin and end."""
    values, _, sizes = _lists(column)
    code = _places(values, words)
    row = np.repeat(np.arange(len(sizes)), sizes)[code >= 0]
    code = code[code >= 0]
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(words)))
    return row[order], np.r_[0, ends[:-1]], ends


def _best(candidates: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidates(memory: DataFrame, edges: DataFrame, q: DataFrame, p, k: int) -> DataFrame:
    """(query_id, kind, id, score, rank): the best ``k`` by 'vector', by 'text' and, at level l3, by 'recall'."""
    rows = in_scope(memory, p).select("id", "user_name", F.col("embedding").cast("array<double>").alias("embedding"), text.lexemes(F.col("memory")).alias("words"), F.lower("key").alias("key"), "tags")
    exact = F.array("key")
    if p.level == "l3":
        # memories that mention an entity which the query names
        named = graph.live(edges).where("relation = 'MENTIONS_ENTITY'").groupBy("from_id").agg(F.collect_set("to_id").alias("named"))
        rows = rows.join(named, rows.id == named.from_id, "left")
        exact = F.concat(exact, F.coalesce("named", F.array().cast("array<string>")))
    rows = rows.select("id", "user_name", "embedding", "words", (1 + F.log1p(F.size("words"))).alias("damp"), exact.alias("exact"), F.array_distinct("tags").alias("tags"))
    level = p.level
    schema = "query_id long, kind string, id string, score double"

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, query_ids, n = pa.concat_arrays(rows["id"].chunks), queries["query_id"].to_numpy(), rows.num_rows
        found = []  # (kind, queries, rows, scores)
        v, w = _Vectors(rows["embedding"]), _Vectors(queries["vector"])
        tile = max(1, TILE // n)
        for at in range(0, len(query_ids), tile):
            lot = np.arange(at, min(at + tile, len(query_ids)))
            qi, ri = np.nonzero(_may_enter(_cosines(w, lot, v), k))
            qi = lot[qi]
            score = _exact(w, qi, v, ri)
            best = _first(qi, ri, score, k)
            found.append(("vector", qi[best], ri[best], score[best]))
        # queries of the same words have the same lists
        sets: dict = {}
        for i, t in enumerate(queries["tokens"].to_pylist() if level != "l2" else []):
            sets.setdefault(tuple(t), []).append(i)
        words = pa.array(sorted({t for s in sets for t in s}), pa.string())
        number = {t: i for i, t in enumerate(words.to_pylist())}
        held, exact, tags = (_postings(rows[c], words) for c in ("words", "exact", "tags"))
        damp = rows["damp"].to_numpy()

        def counts(postings, s) -> np.ndarray:
            row, first, end = postings
            at = [row[first[number[t]] : end[number[t]]] for t in s]
            return np.bincount(np.concatenate(at), minlength=n) if at else np.zeros(n, int)

        for s, of in sets.items():
            hits = counts(held, s)
            lists = [("text", np.where(hits > 0, hits / damp, -np.inf))]
            if level == "l3":
                shared = counts(tags, s)
                recall = np.where(shared >= 2, np.minimum(scoring.KEY_SCORE, scoring.TAG_BASE + scoring.TAG_STEP * shared), -np.inf)
                lists.append(("recall", np.where(counts(exact, s) > 0, np.maximum(recall, scoring.KEY_SCORE), recall)))
            for kind, score in lists:
                ri = np.flatnonzero(_may_enter(score[None, :], k)[0])
                ri = ri[_first(np.zeros(len(ri), int), ri, score[ri], k)]
                found.append((kind, np.repeat(of, len(ri)), np.tile(ri, len(of)), np.tile(score[ri], len(of))))
        kinds = pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.string())
        qi, ri, score = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3))
        return _table(schema, [query_ids[qi.astype(int)], kinds, ids.take(pa.array(ri.astype(int))), score])

    return _best(_met(rows, q.select("query_id", "vector", "tokens", "cubes"), meet, schema), k, ("query_id", "kind"))


def fused(lists: DataFrame) -> DataFrame:
    """(query_id, found): of each query its candidates [(id, score)], lists fused by reciprocal rank, recalled rows by the larger score."""
    by_rank = F.sum(F.when(F.col("kind") != "recall", 1.0 / (F.col("rank") + scoring.RRF_K)))
    recalled = F.max(F.when(F.col("kind") == "recall", F.col("score")))
    one = lists.groupBy("query_id", "id").agg(F.greatest(by_rank, recalled).alias("score"))
    return one.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("found"))  # three times k at most, by id


def near_nodes(memory: DataFrame, edges: DataFrame, found: DataFrame, q: DataFrame, p, most: int) -> DataFrame:
    """(query_id, id, hop, score, rel): of each query the best rows within ``p.hops`` live hops of its candidates, by the least hop and then the least seed.

    ``score`` is the seed's, ``rel`` the cosine.  The hops before the last are joined; for the last, the rows and
    their neighbours, by parts, meet the nodes that each query has reached, and a part gives ``most`` rows a query.
    """
    both, depth = graph.symmetric(graph.live(edges)), p.hops
    front = found.select("query_id", F.posexplode("found.id").alias("seed", "id"))
    steps = [front.withColumn("hop", F.lit(0))]
    for hop in range(1, depth):
        front = front.join(both, front.id == both.a).groupBy("query_id", "b").agg(F.min("seed").alias("seed")).select("query_id", "seed", F.col("b").alias("id"))
        steps.append(front.withColumn("hop", F.lit(hop)))
    steps = reduce(DataFrame.unionByName, steps[1:] or steps)
    steps = steps.groupBy("query_id").agg(F.collect_list(F.struct("id", "hop", "seed")).alias("s"))
    asked = steps.join(found, "query_id").join(q.select("query_id", "vector", "cubes"), "query_id")
    asked = asked.select("query_id", "vector", "cubes", F.col("found.id").alias("ids"), F.col("found.score").alias("scores"), F.col("s.id").alias("nodes"), F.col("s.hop").alias("hops"), F.col("s.seed").alias("seeds"))
    rows = in_scope(memory, p).select("id", "user_name", F.col("embedding").cast("array<double>").alias("embedding"))
    linked = both.join(rows.select("id"), F.col("b") == F.col("id"), "left_semi").groupBy("b").agg(F.collect_list("a").alias("near"))
    rows = rows.join(linked, F.col("id") == F.col("b")).drop("b")
    schema = "query_id long, id string, hop int, score double, rel double"

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, query_ids, n = pa.concat_arrays(rows["id"].chunks), queries["query_id"].to_numpy(), rows.num_rows
        v, w = _Vectors(rows["embedding"]), _Vectors(queries["vector"])
        near, starts, _ = _lists(rows["near"])  # no row is without
        nodes = near.unique()
        edge = _places(near, nodes)
        reached, first, sizes = _lists(queries["nodes"])
        of = np.repeat(np.arange(len(sizes)), sizes)
        node, row = _places(reached, nodes), _places(reached, ids)
        hops, seeds = (_lists(queries[c])[0].to_numpy().astype(np.int64) for c in ("hops", "seeds"))
        known, known_first, known_sizes = _lists(queries["ids"])
        known_of, known_row = np.repeat(np.arange(len(known_sizes)), known_sizes), _places(known, ids)
        scores = _lists(queries["scores"])[0].to_numpy()
        factor = np.array([scoring.HOP_DECAY**h for h in range(depth + 1)])
        tile, out = max(1, TILE // max(len(edge), n)), []
        for at in range(0, len(query_ids), tile):
            lot = np.arange(at, min(at + tile, len(query_ids)))
            mine = slice(*np.searchsorted(of, [at, at + len(lot)]))
            i, h, s, c, r = of[mine] - at, hops[mine], seeds[mine], node[mine], row[mine]
            last = (h == depth - 1) & (c >= 0)
            step = np.full((len(lot), len(nodes)), NEVER)
            step[i[last], c[last]] = depth * HOP + s[last]
            step = np.minimum.reduceat(step[:, edge], starts, axis=1)
            sooner = (h > 0) & (r >= 0)
            np.minimum.at(step, (i[sooner], r[sooner]), (h * HOP + s)[sooner])
            mine = slice(*np.searchsorted(known_of, [at, at + len(lot)]))
            old = known_row[mine] >= 0
            step[known_of[mine][old] - at, known_row[mine][old]] = NEVER
            if not (step < NEVER).any():
                continue
            never = step == NEVER
            hop = np.where(never, 0, step // HOP)
            seed_score = scores[np.where(never, 0, step % HOP) + known_first[lot][:, None]]
            cos = _cosines(w, lot, v)
            score = np.where(cos > -np.inf, (cos + 1) / 2, seed_score) * factor[hop]
            score[never] = -np.inf
            qi, ri = np.nonzero(_may_enter(score, most))
            has = cos[qi, ri] > -np.inf
            rel = np.where(has, _exact(w, lot[qi], v, ri), 0.0)
            hop, seed_score = hop[qi, ri], seed_score[qi, ri]
            best = _first(qi, ri, np.where(has, (rel + 1) / 2, seed_score) * factor[hop], most)
            out.append((lot[qi[best]], ri[best], hop[best], seed_score[best], rel[best], ~has[best]))
        if not out:
            return _table(schema, [[]] * 5)
        qi, ri, hop, score, rel, none = (np.concatenate(x) for x in zip(*out))
        return _table(schema, [query_ids[qi], ids.take(pa.array(ri)), hop, score, pa.array(rel, mask=none)])

    return _met(rows, asked, meet, schema)


def _expanded(found: DataFrame, edges: DataFrame, memory: DataFrame, q: DataFrame, p, most: int) -> DataFrame:
    """(query_id, rows): candidates and, as many at most, their neighbours, with what the steps below need of them.

    A neighbour has (cosine + 1) / 2 x 0.8^hop, or its seed's score x 0.8^hop without a vector.
    """
    wanted = found.select("query_id", F.explode("found").alias("f")).select("query_id", "f.id", F.col("f.score").alias("score"))
    if p.level == "l3":
        factor = F.pow(F.lit(scoring.HOP_DECAY), F.col("hop").cast("double"))
        near = near_nodes(memory, edges, found, q, p, most)
        near = near.select("query_id", "id", (F.coalesce(vector.relativity(F.col("rel")), "score") * factor).alias("score"))
        near = _best(near, most, ("query_id",)).join(found.select("query_id", F.size("found").alias("n")), "query_id").where("rank <= n")
        wanted = wanted.unionByName(near.select("query_id", "id", "score"))
    m = in_scope(memory, p).select("id", "user_name", "memory", "memory_type", "updated_at", "access_count", "hierarchy_level", "pagerank", F.col("embedding").cast("array<double>").alias("embedding"))
    t = wanted.join(m, "id").join(q.select("query_id", "vector", "cubes"), "query_id").where(F.array_contains("cubes", F.col("user_name")))
    t = t.withColumn("rel", F.when(F.size("vector") > 0, vector.relativity(vector.cosine(F.col("embedding"), F.col("vector")))))
    keep = ["id", "score", "rel", "memory", "memory_type", "updated_at", "access_count", "hierarchy_level", "pagerank", "embedding"]
    return t.groupBy("query_id").agg(F.collect_list(F.struct(*keep)).alias("rows"))  # six times k at most


def _penalised(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, id, ...): targets of contradictions from a query's best rows lose 0.30, not below 0."""
    best = F.slice(F.array_sort(F.transform("rows", lambda x: F.struct((-x["score"]).alias("s"), x["id"].alias("id")))), 1, PENALTY_TOP)
    top = rows.select("query_id", F.explode(best).alias("b")).select("query_id", F.col("b.id").alias("from_id"))
    bad = graph.live(edges).where("relation = 'CONTRADICTS'").select("from_id", "to_id").join(top, "from_id")
    w = Window.partitionBy("query_id").orderBy("from_id", "to_id")
    bad = bad.withColumn("r", F.row_number().over(w)).where(F.col("r") <= PENALTY_EDGES).groupBy("query_id").agg(F.collect_set("to_id").alias("bad"))
    t = rows.join(bad, "query_id", "left").select("query_id", F.coalesce("bad", F.array().cast("array<string>")).alias("bad"), F.explode("rows").alias("x")).select("query_id", "bad", "x.*")
    hit = F.greatest(F.col("score") - scoring.CONTRADICTION_PENALTY, F.lit(0.0))
    return t.withColumn("score", F.when(F.array_contains("bad", F.col("id")), hit).otherwise(F.col("score"))).drop("bad")


def _chosen(pdf: pd.DataFrame, p, scorer) -> pd.DataFrame:
    """One query's rows after near copies are dropped and, where asked for, rescored by ``scorer``."""
    if p.dedup in ("sim", "mmr"):
        kinds = ["text"] if p.dedup == "sim" else ["text", "pref"]
        some = pdf[pdf["bucket"].isin(kinds)].sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        c = some.assign(kind=some["bucket"], bucket=0)
        lam = p.mmr_lambda if 0 < p.mmr_lambda <= 1 else 0.7
        out = dedup.greedy_similarity(c, p.top_k) if p.dedup == "sim" else dedup.mmr(c, p.top_k, p.top_k, list(pdf["vector"].iloc[0]), lam)
        pdf = pd.concat([some[some["id"].isin(out["id"])], pdf[~pdf["bucket"].isin(kinds)]])
    if p.llm_rerank and len(pdf):
        query, most = pdf["query"].iloc[0], models.RERANKED
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        if p.num_stages > 1 and len(pdf) >= STAGE_LEAST:
            head = pdf.head(STAGE_FIRST)
            short = head.assign(score=models.overlap_reranker(query, list(head["memory"]))).sort_values(["score", "id"], ascending=[False, True], kind="stable").head(STAGE_SHORTLIST)
            pdf, most = pdf[pdf["id"].isin(short["id"])].reset_index(drop=True), STAGE_SHORTLIST
        n = min(most, len(pdf))
        pdf["score"] = np.r_[np.asarray(scorer(query, list(pdf["memory"].head(n))), float), pdf["score"].to_numpy(float)[n:]]
    return pdf


def search_many(memory: DataFrame, edges: DataFrame, queries: DataFrame, p, as_of: Column, scorer=None, web: DataFrame | None = None) -> DataFrame:
    """(query_id, bucket, rank, id, memory, score) of queries (query_id, query, vector, cubes), all with the parameters ``p``.

    ``scorer`` (query, texts) -> scores serves ``llm_rerank``, without one by word overlap;
    ``num_stages`` above 1 puts a shortlist before it.  ``web`` (id, memory, score, and
    query_id if they aren't for all) are rows from outside, which only ``internet`` lets
    in.  A query without a vector or words has what the other recalls find; a repeated
    query_id is an error of the caller.
    """
    from engram.operators import search  # it calls this module

    k = search.inflated_k(p.top_k, p.dedup)
    q = _queries(queries)
    # one small row a query, read several times: kept when first computed, and computed anew if lost
    found = fused(candidates(memory, edges, q, p, k)).persist()
    rows = _expanded(found, edges, memory, q, p, 3 * k).persist()
    rows = _penalised(rows, edges) if p.level == "l3" else rows.select("query_id", F.explode("rows").alias("x")).select("query_id", "x.*")
    rel = F.coalesce("rel", "score")
    if p.importance:
        score = scoring.importance_decay(rel, F.col("updated_at"), as_of, F.col("access_count"), F.col("hierarchy_level"), F.col("pagerank"), F.col("memory_type"), p.decay_alpha)
    else:
        score = scoring.decay(rel, F.col("updated_at"), as_of, F.col("memory_type"), p.decay_alpha)
    rows = rows.select("query_id", "id", score.alias("score"), "memory", search.bucket_of(F.col("memory_type")).alias("bucket"), "embedding").where(F.col("score") >= p.relativity)
    if p.internet and web is not None:
        outer = web if "query_id" in web.columns else q.select("query_id").join(F.broadcast(web.limit(search.WEB_ROWS)), F.lit(True))  # WEB_ROWS rows for every query
        rows = rows.unionByName(outer.select("query_id", F.col("id"), F.col("score").cast("double").alias("score"), "memory", F.lit("text").alias("bucket"), F.lit(None).cast("array<double>").alias("embedding")))
    if p.dedup in ("sim", "mmr") or p.llm_rerank:
        use = scorer or models.overlap_reranker

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            return _chosen(pdf, p, use)[["query_id", "id", "score", "memory", "bucket", "embedding"]]

        rows = rows.join(q.select("query_id", "query", "vector"), "query_id").groupBy("query_id").applyInPandas(one, _CANDIDATE)
    rows = search.first_by_text(rows, F.expr(search.BUCKET_PRIORITY), ("query_id",))
    return _best(rows, p.top_k, ("query_id", "bucket")).select("query_id", "bucket", "rank", "id", "memory", "score")
