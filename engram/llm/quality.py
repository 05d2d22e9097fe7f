"""Quality rules: one threshold table compiled into one Spark projection.

Only built-in column functions are used, so the whole operator is a narrow
projection over the scan: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.columns import name_of, numbered

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it with as was on be by this are from at an or not "
    "der die das und ist von mit den im nicht ein eine auf zu als dem sich auch "
    "le la les de des du et est un une que qui pour dans pas par sur en avec au il elle "
    "el los las y se del con su para es al lo no una por"
).split()
WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Threshold:
    """A text passes if ``metric`` lies in [least, most]; None leaves a side open."""

    metric: str
    least: float | None = None
    most: float | None = None


#: Ratios a word or a line; 'bangs' counts exclamation marks.
THRESHOLDS = (
    Threshold("chars_per_word", 2.5, 12.0),
    Threshold("symbols_per_word", None, 0.25),
    Threshold("bangs_per_word", None, 0.5),
    Threshold("stop_share", 0.06, None),
    Threshold("dup_line_share", None, 0.45),
)
LEAST_WORDS = 50


def stop_forms() -> list[str]:
    """The words as they stand in running text: lower case, and capitalised."""
    return sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})


def _metrics(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` as struct __row of numbered columns, with the counts as __-columns; each array is computed once."""
    rows = numbered(docs)
    t = rows.select(F.struct(*rows.columns).alias("__row"), F.coalesce(F.col(name_of(docs, text_col)).cast("string"), F.lit("")).alias("__t"))
    t = t.select("__row", "__t", F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)).alias("__w"))
    t = t.select("__row", "__t", "__w", F.size("__w").cast("long").alias("__n"))
    hashed = F.transform(
        F.sequence(F.lit(0), (F.col("__n") - 3).cast("int")),
        lambda i: F.struct(F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i")),
    )
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.regexp_replace(x, "[\\x20\\x09-\\x0D]+", "")) > 0)
    t = t.select(
        "__row",
        "__t",
        "__n",
        F.length(F.regexp_replace("__t", "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("__chars"),
        F.size(F.filter("__w", lambda w: w.isin(*stop_forms()))).cast("long").alias("__stops"),
        lines.alias("__lines"),
        # the 3-word windows by hash: equal ones are neighbours
        F.when(F.col("__n") > 3, F.array_sort(hashed)).alias("__g"),
    )
    pairs = F.zip_with(
        F.slice("__g", F.lit(1), F.size("__g") - 1), F.slice("__g", F.lit(2), F.size("__g") - 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))
    )
    repeats = F.when(F.col("__g").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))))
    t = t.select(
        "__row", "__n", "__chars", "__stops", _count("__t", "#*$%&|<>").alias("__symbols"), _count("__t", "!").alias("__bangs"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup"), F.size("__lines").cast("long").alias("__n_lines"), repeats.alias("__r"),
    )
    # windows starting at i and j cover 3 words each, less the overlap
    steps = F.zip_with(F.slice("__r", F.lit(1), F.size("__r") - 1), F.slice("__r", F.lit(2), F.size("__r") - 1), lambda x, y: F.least(y - x, F.lit(3)))
    covered = F.when(F.size("__r") > 0, F.aggregate(steps, F.lit(3).cast("long"), lambda acc, x: acc + x))
    return t.select("__row", "__n", "__chars", "__stops", "__symbols", "__bangs", "__dup", "__n_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("__rep"))


def _count(column: str, characters: str) -> Column:
    return (F.length(column) - F.length(F.translate(column, characters, ""))).cast("long")


def _verdict(thresholds: tuple[Threshold, ...]) -> Column:
    words, lines = F.greatest("__n", F.lit(1)), F.greatest("__n_lines", F.lit(1))
    ratio = {
        "chars_per_word": F.col("__chars") / words,
        "symbols_per_word": F.col("__symbols") / words,
        "bangs_per_word": F.col("__bangs") / words,
        "stop_share": F.col("__stops") / words,
        "dup_line_share": F.col("__dup") / lines,
    }
    ok = F.lit(True)
    for t in thresholds:
        if t.least is not None:
            ok = ok & (ratio[t.metric] >= t.least)
        if t.most is not None:
            ok = ok & (ratio[t.metric] <= t.most)
    return ok


def _failed() -> Column:
    return (F.col("__n") < LEAST_WORDS) | (100 * F.col("__rep") > 50 * F.col("__n"))


def measure(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its counts, ``base_failed`` and ``kept``.

    Null or empty text has no words and fails the base; null and repeated ids keep
    their rows; other columns are ignored, whatever their names; an empty table
    gives no row.
    """
    base = _failed()
    return _metrics(docs, text_col).select(
        F.col(f"__row.{name_of(docs, id_col)}").alias("doc_id"),
        F.col("__n").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        F.col("__dup").alias("n_dup_lines"),
        F.col("__rep").alias("n_repeat_words"),
        base.alias("base_failed"),
        (~base & _verdict(thresholds)).alias("kept"),
    )


def keep_good(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever their names.

    Rows of null or empty text go; null and repeated ids are rows of their own, each
    judged by its text alone; an empty table gives no row.
    """
    # a row number, never negative, keeps the filter above the projections: pushed below
    # them it would compute every array again for each element that looks at it
    t = _metrics(docs, text_col).select("__row", (~_failed() & _verdict(thresholds)).alias("__ok"), F.monotonically_increasing_id().alias("__at"))
    return t.where("__ok AND __at >= 0").select("__row.*").toDF(*docs.columns)


def oracle() -> str:
    """DuckDB SQL for ``measure(documents)``."""
    forms = ", ".join(f"'{w}'" for w in stop_forms())
    conditions = []
    ratio = {
        "chars_per_word": "word_chars / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "bangs_per_word": "n_bangs / greatest(n_words, 1)",
        "stop_share": "n_stops / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    }
    for t in THRESHOLDS:
        conditions += [f"{ratio[t.metric]} >= {t.least}"] * (t.least is not None) + [f"{ratio[t.metric]} <= {t.most}"] * (t.most is not None)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
v AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
  len(list_filter(w, lambda x: list_contains([{forms}], x))) AS n_stops, coalesce(v.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN v USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(conditions)} AS kept FROM b"""
