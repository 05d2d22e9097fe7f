"""How far the sources of a language differ, by term shares.

Every (language, source) group gives each kept term a smoothed share; a pair of
groups is worth the sum, over all kept terms, of the squared difference over the
other's share.  No pair looks at all terms: it starts at V times the value of two
zero counts, and an inverted index (a term's sources and counts) adds corrections
for counts that are not zero.  A term's correction against the zero count of the
other side depends on the count alone, so those come from a histogram of counts;
only terms that both sources hold are met in the postings.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.llm.columns import picked
from engram.session import materialize

#: A term is kept if so many documents of the language hold it.
LEAST_DOCS = 3
#: Ranks of a group's own terms that are returned.
TERMS = 200
#: Groups up to which their totals are broadcast (about 60 bytes each); more are joined by shuffles.
BROADCAST_GROUPS = 100_000
#: Distinct terms that a task counts before it passes them on.
HELD_TERMS = 300_000

#: Bytes to lower case A-Z; what is no letter and below 128 becomes a blank.
_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters, lower-cased, and of all characters from U+0080 on."""
    return text.translate(_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), added up as far as HELD_TERMS allow."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        keys = [k for k, c in counts.items() for _ in c]
        terms = [t for c in counts.values() for t in c]
        n = [x for c in counts.values() for x in c.values()]
        d = [docs[k][t] for k, c in counts.items() for t in c]
        counts.clear()
        docs.clear()
        lang, source, term = (pa.array(x, pa.binary()).view(pa.string()) for x in ([k[0] for k in keys], [k[1] for k in keys], terms))
        return pa.RecordBatch.from_arrays([lang, source, term, pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        columns = [batch.column(i).view(pa.binary()) for i in range(3)]
        for lang, source, text in zip(*columns):
            key, words = (lang.as_py(), source.as_py()), terms_of(text.as_py())
            if not words:
                continue
            own = set(words)
            before = len(counts[key])
            counts[key].update(words)
            docs[key].update(own)
            held += len(counts[key]) - before
            if held >= HELD_TERMS:
                yield flush()
                held = 0
    yield flush()


def postings(docs: DataFrame, sources: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The inverted index (lang, term, at): of each kept term its [(no, n)], n its occurrences in the source with that number.

    ``sources`` (lang, source, no) has every group of the documents.
    """
    raw = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    one = raw.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).join(sources, ["lang", "source"])
    index = one.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("no", "n"))).alias("at"))
    return index.where(F.col("docs") >= least_docs).select("lang", "term", "at")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total) in longs: three long divisions by steps of 1,000, exact for totals below 9 * 10^15."""
    k = F.lit(1000).cast("long")
    a = (count + 1) * k
    left = (a % total) * k
    return 1 + _div(a, total) * 1_000_000 + _div(left, total) * 1000 + _div((left % total) * k, total)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def worth(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): every group against its language's other sources, and its own terms.

    Part ``pair`` has each other source of the language, all ranks; part ``term`` the
    kept terms that the group holds and uses more than its language, up to rank
    ``terms``.  Ties end on the item, by UTF-8.  A null text, language or source is
    read as ''; a group without terms still meets the others, a language without kept
    terms has pairs of value 0; repeated rows count as documents of their own; other
    columns are ignored; an empty table gives no row.  Shares add up to 10^9 + V at
    most, so a sum of values stays below 2^63 while no term's share exceeds
    9 * 10^18 / (10^9 + V); beyond that Spark raises an overflow.

    The index holds one row a kept term with at most the language's sources in it, as
    many as each of them has rows in the result.
    """
    rows = picked(docs, lang=(lang_col, "string"), source=(source_col, "string"), text=(text_col, "string")).fillna("")
    sources = rows.select("lang", "source").distinct()
    sources = sources.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")))  # as many rows as a group has pairs
    sources = materialize(sources, "sources")
    few = sources.count() <= BROADCAST_GROUPS

    def beside(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if few else t

    index = materialize(postings(rows, beside(sources), least_docs), "postings")
    kept = index.groupBy("lang").agg(F.count("*").alias("v"))
    totals = index.select("lang", F.explode("at").alias("s")).groupBy("lang", "s.no").agg(F.sum("s.n").alias("n"))
    groups = sources.join(totals, ["lang", "no"], "left").join(kept, "lang", "left").fillna(0, ["n", "v"])
    total = F.greatest(F.col("n") + F.col("v"), F.lit(1))  # 1 where the language keeps no term, whose pairs are V = 0 times something
    groups = materialize(groups.select("lang", "source", "no", "v", "n", total.alias("total"), share(F.lit(0).cast("long"), total).alias("zero")), "groups")
    by_no = F.array_sort(F.collect_list(F.struct("no", "total", "zero")))
    langs = groups.groupBy("lang").agg((F.sum("n") + F.max("v")).alias("whole"), by_no.alias("own"))
    langs = langs.select("lang", "whole", F.col("own.total").alias("totals"), F.col("own.zero").alias("zeros"))

    def with_share(s: Column) -> Column:
        return F.struct(s["no"].alias("no"), share(s["n"], F.element_at("totals", s["no"])).alias("p"), F.element_at("zeros", s["no"]).alias("zero"))

    count = F.aggregate("at", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    shared = index.join(beside(langs), "lang").select("lang", "term", F.transform("at", with_share).alias("at"), share(count, F.col("whole")).alias("q"))
    shared = materialize(shared, "shares")  # read for the terms, the single counts and the pairs
    one = shared.select("lang", "term", "q", F.explode("at").alias("a")).select("lang", "term", "q", "a.*")

    own = one.where("p > q").join(beside(sources), ["lang", "no"])
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), worth(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= terms)
    return own.unionByName(_pairs(groups, shared, one, beside).withColumn("rank", F.row_number().over(best))).select("lang", "source", "part", "item", "value", "rank")


def _pairs(groups: DataFrame, shared: DataFrame, one: DataFrame, beside) -> DataFrame:
    """(lang, source, part, item, value): the baseline of each ordered pair and its corrections, added up."""
    a = groups.select("lang", F.col("no").alias("a"), "source", F.col("zero").alias("a0"), "v")
    b = groups.select("lang", F.col("no").alias("b"), F.col("source").alias("item"), F.col("zero").alias("b0"))
    a0, b0 = F.col("a0"), F.col("b0")
    start = a.join(beside(b), "lang").where("a <> b").select("lang", "a", "b", "source", "item", (F.col("v") * worth(a0, b0)).alias("value"))
    # counts against the zero of the other side: p and how many terms have it
    p, n = F.col("p"), F.col("terms")
    seen = one.groupBy("lang", F.col("no").alias("a"), "p", F.col("zero").alias("a0")).agg(F.count("*").alias("terms"))
    seen = seen.join(beside(b.drop("item")), "lang").where("a <> b")
    ways = F.array(
        F.struct(F.col("a"), F.col("b"), (n * (worth(p, b0) - worth(a0, b0))).alias("value")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), (n * (worth(b0, p) - worth(b0, a0))).alias("value")),
    )
    lone = seen.select("lang", F.explode(ways).alias("w")).select("lang", "w.*")
    # terms of both: what the two corrections above leave
    first = shared.where(F.size("at") > 1).select("lang", "at", F.posexplode("at").alias("i", "x"))
    both = first.select("lang", "x", F.explode(F.slice("at", F.col("i") + 2, F.size("at"))).alias("y"))
    both = both.select("lang", F.col("x.no").alias("a"), F.col("y.no").alias("b"), *[F.col(f"{s}.{c}").alias(f"{s}{k}") for s in "xy" for c, k in (("p", 1), ("zero", 0))])

    def left(s: str, t: str) -> Column:
        s1, s0, t1, t0 = F.col(f"{s}1"), F.col(f"{s}0"), F.col(f"{t}1"), F.col(f"{t}0")
        return worth(s1, t1) - worth(s1, t0) - worth(s0, t1) + worth(s0, t0)

    both = both.groupBy("lang", "a", "b").agg(F.sum(left("x", "y")).alias("there"), F.sum(left("y", "x")).alias("back"))
    ways = F.array(F.struct("a", "b", F.col("there").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("value")))
    both = both.select("lang", F.explode(ways).alias("w")).select("lang", "w.*")
    every = start.unionByName(lone, True).unionByName(both, True)
    summed = every.groupBy("lang", "a", "b").agg(F.max("source").alias("source"), F.max("item").alias("item"), F.sum("value").alias("value"))
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def oracle(least_docs: int = LEAST_DOCS, terms: int = TERMS) -> str:
    """DuckDB SQL of ``audit``, by all terms of all pairs."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
kept AS (SELECT lang, term FROM d GROUP BY lang, term HAVING count(DISTINCT r) >= {least_docs}),
c AS (SELECT d.lang, d.source, d.term, count(*) AS n FROM d JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(s.v, 0) AS v, coalesce((SELECT sum(c.n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total FROM g LEFT JOIN sizes s ON s.lang = g.lang),
p AS (SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + t.v) AS p
    FROM t JOIN kept ON kept.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // ((SELECT sum(t.total) + max(t.v) FROM t WHERE t.lang = p.lang)) AS q FROM p GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM t a JOIN t b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
w AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM o)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM w WHERE part = 'pair' OR r <= {terms}"""
