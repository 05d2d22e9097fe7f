"""URL filtering by a template tree.

Every host's paths form a tree of segments.  Variable segments are generalised:
first by shape (numbers, hashes, dates), then, at each node of the tree, a segment
level with many values of which none dominates becomes a wildcard, and sibling
branches that the labels cannot tell apart merge into one.

Above its host a template has ancestors too: the host's top-level and registered
domain, and the same path at all hosts.  A template's share of blocked labels is
smoothed level by level along these ancestors, so one without labels of its own
follows the nearest that have some.  A template whose smoothed purity reaches the
threshold is blocked, with every URL that it covers.  The threshold is the least
one that keeps PRECISION on labels of hosts that their own purity did not see; what
the purities promise counts as a few labels more (``held_out``).

Hand-made rules (host and path prefix, the longest wins) come first; their verdicts
are the labels.  All tree statistics are taken from one aggregate of distinct
templates, so a host with a third of all rows shrinks to its templates before any
shuffle by host.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.columns import picked
from engram.session import materialize

#: Levels of the tree, a parameter of the model; what lies deeper is one last segment, so more levels tell longer paths apart.
DEPTH = 4
#: A level is variable if it has more values than this and none holds this share.
VALUES, SHARE = 20, 0.5
#: Labels that the parent's purity counts for.
SMOOTHING = 4.0
#: Share of rejected labels that must be blocked ones, on held-out hosts; the least purity that may reject; the purity that is asked for where no such label is.
PRECISION, FLOOR, REJECT = 0.95, 0.5, 0.8
#: Groups of hosts of which each is held out once, and steps of the purity at which a threshold may lie.
FOLDS, STEPS = 5, 100
#: Tasks over which the rows of one template are dealt.
SALT = 8
#: Two branches differ if their shares of blocked labels are this many standard errors apart.
APART = 2.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``prefix`` is host and path, like ``example.org/en/``; it covers subdomains."""

    prefix: str
    verdict: str

    @property
    def host(self) -> str:
        return self.prefix.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.prefix.partition("/")[2]


#: The rules of the query.
RULES = (Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block"))


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(raw, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, null if none: one CASE over a rule list of fixed size."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.prefix), r.prefix)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.prefix)).otherwise(found)
    return found


def shape(segment: Column) -> Column:
    """A segment with its variable characters generalised; an ending like .html stays."""
    s = F.regexp_replace(segment, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "{date}")
    s = F.regexp_replace(s, r"^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}(?=$|\.)", "{id}")
    s = F.regexp_replace(s, r"^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{12,}(?=$|\.)", "{id}")
    return F.regexp_replace(s, r"[0-9]+", "{n}")


def _levels(path: Column, depth: int) -> list[Column]:
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/", depth)
    return [F.when(F.size(parts) > k, shape(F.get(parts, F.lit(k)))) for k in range(depth)]


def template_tree(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, r0.., t0..): for each distinct raw template its generalised one.

    ``leaves``: host, r0.., n, blocked, allowed - one row a raw template.  The levels
    are decided one after another, each from the already generalised prefix.
    """
    t = leaves
    for k in range(depth):
        t = t.withColumn(f"t{k}", F.col(f"r{k}"))
    for k in range(depth):
        node = ["host", *[f"t{j}" for j in range(k)]]
        below = F.coalesce(F.col(f"t{k + 1}").rlike(r"\{"), F.lit(False)).cast("string") if k + 1 < depth else F.lit("")
        # the form of a branch: how deep it goes and whether its next level is variable
        form = F.concat_ws("|", *[F.col(f"r{j}").isNotNull().cast("string") for j in range(k, depth)], below)
        branch = t.where(F.col(f"r{k}").isNotNull()).groupBy(*node, f"t{k}").agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.min(form).alias("form"))
        labels = F.col("b") + F.col("a")
        share = F.col("b") / labels
        about = branch.withColumn("share", F.when(labels > 0, share)).groupBy(*node, "form").agg(
            F.count("*").alias("values"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("b").alias("sb"), F.sum(labels).alias("sl"),
            F.min("share").alias("low"), F.max("share").alias("high"),
            F.min(F.when(labels > 0, labels)).alias("few"), F.count("share").alias("labelled"),
        )
        p = F.col("sb") / F.col("sl")
        error = F.sqrt(p * (1 - p) * 2 / F.col("few"))
        alike = (F.col("labelled") >= 2) & (F.col("labelled") == F.col("values")) & (F.col("high") - F.col("low") <= APART * error)
        many = (F.col("values") > VALUES) & (F.col("most") < SHARE * F.col("all"))
        wild = about.where(many | (alike & (F.col("values") > 1))).select(*[F.col(c).alias(f"w_{c}") for c in node], F.col("form").alias("w_form"))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in node])
        t = t.join(wild, same & (form == F.col("w_form")), "left")
        t = t.withColumn(f"t{k}", F.when(F.col("w_form").isNotNull() & F.col(f"r{k}").isNotNull(), F.lit("*")).otherwise(F.col(f"t{k}")))
        t = t.drop(*[f"w_{c}" for c in node], "w_form")
    return t


def _ancestors(depth: int) -> list[tuple[list[Column], bool]]:
    """The nodes above a template and itself, from far to near, and whether the next one lies inside."""
    host = F.col("host")
    domain = F.concat_ws(".", F.slice(F.split(host, r"\."), -F.least(F.lit(2), F.size(F.split(host, r"\."))), F.lit(2)))
    t = [F.coalesce(F.col(f"t{k}"), F.lit("\x00")) for k in range(depth)]
    nodes = [([F.substring_index(host, ".", -1)], True), ([domain], True), ([host], False)]
    nodes += [(t[: k + 1], True) for k in range(depth)]
    nodes += [([domain, *t], False)]
    return nodes + [([host, *t[: k + 1]], k + 1 < depth) for k in range(depth)]


def template_purity(tree: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``tree`` with ``purity``, smoothed along the ancestors, ``held_purity`` without the labels of the host's fold, and ``labels`` of its own.

    An ancestor whose labels all lie in the next one adds nothing and is skipped.
    """
    said = F.col("blocked") + F.col("allowed")
    b, labels = tree.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum(said), F.lit(0))).first()
    chain = _ancestors(depth)
    keys = F.array(*[F.struct(F.lit(i).alias("level"), F.concat_ws("\x1f", F.lit(str(i)), *c).alias("key")) for i, (c, _) in enumerate(chain)])
    leaf = F.struct("host", *[f"r{k}" for k in range(depth)])
    rows = tree.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")).withColumn("leaf", F.to_json(leaf))
    long = rows.select("leaf", "fold", "blocked", said.alias("said"), F.explode(keys).alias("node")).select("*", "node.level", "node.key").drop("node")
    per_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)) for c in ("blocked", "said") for f in range(FOLDS)]
    nodes = long.where("said > 0").groupBy("key").agg(F.sum("blocked").alias("b"), F.sum("said").alias("n"), F.array(*per_fold).alias("folds"))
    seen = long.join(nodes, "key").groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct("level", "b", "n", (F.col("b") - F.col("folds")[F.col("fold")]).alias("hb"), (F.col("n") - F.col("folds")[F.col("fold") + FOLDS]).alias("hn")))).alias("path")
    )
    nested = F.array(*[F.lit(inside) for _, inside in chain])
    start = b / (labels + SMOOTHING)  # allowed until labels say otherwise

    def smoothed(blocked: str, n: str) -> Column:
        def skipped(x: Column, i: Column) -> Column:
            after = F.get(F.col("path"), i + 1)
            return F.coalesce(nested[x["level"]] & (after["level"] == x["level"] + 1) & (after[n] == x[n]), F.lit(False))

        kept = F.filter("path", lambda x, i: ~skipped(x, i))
        return F.aggregate(kept, F.lit(start), lambda p, x: (x[blocked] + SMOOTHING * p) / (x[n] + SMOOTHING))

    seen = seen.select("leaf", smoothed("b", "n").alias("purity"), smoothed("hb", "hn").alias("held_purity"))
    made = rows.join(seen, "leaf", "left").withColumn("labels", said)
    return made.withColumn("purity", F.coalesce("purity", F.lit(start))).withColumn("held_purity", F.coalesce("held_purity", F.lit(start))).drop("leaf", "fold")


def held_out(purity: DataFrame, precision: float = PRECISION, floor: float = FLOOR) -> tuple[float, float, float]:
    """(threshold, precision, recall) by the labels of held-out hosts; a threshold above 1 rejects nothing.

    Of the n labels that a threshold t rejects by their held-out purity, ``precision``
    should be blocked ones; the purity t itself, against REJECT, weighs as SMOOTHING
    labels more.  So by one rule at every size few labels leave the threshold near REJECT,
    and many leave it to what is seen.  It is the lowest that passes; below REJECT, and
    not below ``floor``, only purities of labelled templates are looked at.
    """
    said = F.col("blocked") + F.col("allowed")
    step = F.floor(F.least(F.col("held_purity"), F.lit(1.0)) * STEPS).cast("int").alias("step")
    # at most STEPS + 1 rows
    bins = {r.step: (r.b, r.a) for r in purity.where(said > 0).groupBy(step).agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).collect()}
    every = sum(b for b, _ in bins.values())
    blocked = n = 0
    best = (2.0, 0.0, 0.0)
    for k in range(STEPS, math.ceil(floor * STEPS) - 1, -1):
        b, a = bins.get(k, (0, 0))
        blocked, n = blocked + b, n + b + a
        t = k / STEPS
        if (t >= REJECT or k in bins) and blocked + SMOOTHING * t >= precision * n + SMOOTHING * REJECT:
            best = (t, blocked / max(1, n), blocked / max(1, every))
    return best


def labelled_templates(pages: DataFrame, rules: tuple[Rule, ...] = RULES, depth: int = DEPTH, id_col: str = "page_id", url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """The judged rows with their raw templates, and every distinct template with its purity."""
    rows = picked(pages, page_id=(id_col, "long"), url=(url_col, "string")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for r in rules:
        said = F.when(F.col("rule") == r.prefix, F.lit(r.verdict)).otherwise(said)
    rows = rows.withColumn("said", said)
    raw = [f"r{k}" for k in range(depth)]
    rows = rows.select("*", *[c.alias(n) for c, n in zip(_levels(F.col("path"), depth), raw)])
    leaves = rows.groupBy("host", *raw).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("said") == "block", 1)).alias("blocked"), F.count(F.when(F.col("said") == "allow", 1)).alias("allowed")
    )
    tree = materialize(template_tree(materialize(leaves, "leaves"), depth), "tree")
    return rows, materialize(template_purity(tree, depth), "purity")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, depth: int = DEPTH, reject: float | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row.

    ``reject`` is the purity that blocks; without it the held-out labels set it.  A null
    url, or one without a host, has no rule and no labels, and is allowed.  Repeated rows
    and null ids keep their rows; other columns are ignored; an empty table gives no row.
    """
    rows, made = labelled_templates(pages, rules, depth, id_col, url_col)
    if reject is None:
        reject = held_out(made)[0]
    raw = [f"r{k}" for k in range(depth)]
    name = F.concat(F.lit("/"), F.concat_ws("/", *[f"t{k}" for k in range(depth)]))
    refused = (F.col("purity") >= reject) & (F.col("host") != "")
    made = made.select("host", *raw, name.alias("template"), "purity", F.when(refused, "block").otherwise("allow").alias("method"))
    # a hot template's rows go to SALT tasks; the templates are few beside the rows
    right = made.select(F.col("host").alias("m_host"), *[F.col(c).alias(f"m_{c}") for c in raw], "template", "purity", "method", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("m_salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in ["host", "salt", *raw]])
    return rows.join(right, same, "left").select("page_id", "host", "path", "rule", F.coalesce("said", "method").alias("verdict"), "template", "purity")
