"""URL filters: rules first, then a tree of path templates for each host, whose branches are rejected by their purity.

The rules label the addresses that they fit. The tree carries the labels to addresses that no rule fits:

- Every path becomes a row of segments. Digits are generalised at once (`34359.html` is `{n}.html`), so are long hexadecimal
  names and segments of more than LONG characters; what lies below `depth` segments becomes one last segment `**`.
- Level by level, a node's frequent values (`share` of its addresses, at least `support` of them) stay as branches, all
  others become the wildcard `*`. So a node has at most 1 / share + 1 branches, whatever variety its host has.
- Of a node's branches, ordered by their share of blocked addresses, neighbours merge if their shares of blocked, of allowed
  and of ended addresses do not differ significantly (three tests of two proportions at Z2); merged branches share their subtree.
- A node's purity is the share of its addresses that are known to be bad, drawn to its parent's purity by `weight`
  addresses: (blocked + weight * parent) / (all + weight). Above the hosts stands the share of all addresses. A template of
  purity `threshold` or more is rejected; addresses without a label do not count as bad.

Scale. Rows are summed to (host, generalised path) before any shuffle, and each level is a few grouped sums and equi-joins on
(host, node, segment): no host is gathered in one task, a hot host is spread over its nodes and segments. Levels are written
to the shared folder. The templates come back to the addresses by a join that broadcasts them only if they are few.

Defined results: a null address, or one without `://`, has an empty host and path; an empty path fits no rule; of rules that
fit, the longest wins; repeated rows count again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import materialize, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG = 64
#: The square of the z value at which two shares differ.
Z2 = 3.84


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host in small letters and path of an address; both empty without `://`."""
    begins = F.locate("://", url)
    rest = F.when(begins > 0, F.substring(url, begins + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null; rules: a short list."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
    first = lambda what: F.coalesce(*(F.when(fits(r), F.lit(what(r))) for r in ordered), F.lit(None).cast("string"))
    return first(lambda r: r.name), first(lambda r: r.verdict)


def segments(path: Column, depth: int) -> Column:
    """Generalised segments of a path, at most depth of them and one for the rest."""
    named = lambda s: F.when(F.length(s) > LONG, "{long}").when(s.rlike("^[0-9a-fA-F-]{16,}$"), "{x}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))
    every = F.filter(F.split(path, "/"), lambda s: s != "")
    top = F.transform(F.slice(every, 1, depth), named)
    return F.when(F.size(every) > depth, F.concat(top, F.array(F.lit("**")))).otherwise(top)


def _alike(share: str, before: str) -> Column:
    """Whether two counts `share` of n do not differ significantly from those of the branch before."""
    x, y, n, m = (F.col(c).cast("double") for c in (share, before, "n", "n_before"))
    gap, both, total = x * m - y * n, x + y, n + m
    return gap * gap * total <= F.lit(Z2) * n * m * both * (total - both)


def templates(rows: DataFrame, depth: int = 8, share: float = 0.05, support: int = 3, weight: float = 4.0) -> DataFrame:
    """(host, shape, template, score): the template and purity of every generalised path; rows: host, path, label ('block',
    'allow' or null). A template's merged branches are named (a|b)."""
    shapes = rows.select("host", segments(F.col("path"), depth).alias("rest"), (F.col("label") == "block").alias("bad"), (F.col("label") == "allow").alias("good"))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b"), F.count_if("good").alias("a")]
    shapes = materialize(shapes.groupBy("host", "rest").agg(*sums), "shapes")
    total = shapes.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max(F.size("rest")).alias("depth")).first()
    overall = total["b"] / total["n"] if total["n"] else 0.0
    pure = lambda b, n, above: (b.cast("double") + F.lit(weight) * above) / (n.cast("double") + F.lit(weight))
    added = [F.sum(c).alias(c) for c in ("n", "b", "a", "e")]

    hosts = shapes.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb")).select("host", pure(F.col("hb"), F.col("hn"), F.lit(float(overall))).alias("score"))
    live = shapes.join(hosts, "host").select("host", F.array_join("rest", "/").alias("shape"), "rest", F.lit("").alias("node"), "score", "n", "b", "a")
    done = []
    for _ in range(total["depth"] or 0):
        done.append(live.filter(F.size("rest") == 0).select("host", "shape", "node", "score"))
        live = live.filter(F.size("rest") > 0).withColumn("seg", F.get("rest", F.lit(0))).withColumn("rest", F.slice("rest", 2, depth + 1))
        values = live.withColumn("e", F.when(F.size("rest") == 0, F.col("n")).otherwise(0)).groupBy("host", "node", "score", "seg").agg(*added)
        nodes = values.groupBy("host", "node").agg(F.sum("n").alias("total"))
        stays = (F.col("n") >= support) & (F.col("n") >= F.lit(share) * F.col("total"))
        values = values.join(nodes, ["host", "node"]).withColumn("branch", F.when(stays, F.col("seg")).otherwise("*"))
        values = materialize(values, "values")
        branches = values.groupBy("host", "node", "score", "branch").agg(*added)
        # a node has few branches: the windows are short
        order = Window.partitionBy("host", "node").orderBy(F.col("branch") == "*", (F.col("b") / F.col("n")).desc(), (F.col("a") / F.col("n")).desc(), (F.col("e") / F.col("n")).desc(), "branch")
        branches = branches.withColumns({f"{c}_before": F.lag(c).over(order) for c in ("n", "b", "a", "e")})
        same = (F.col("branch") != "*") & _alike("b", "b_before") & _alike("a", "a_before") & _alike("e", "e_before")
        branches = branches.withColumn("g", F.sum(F.when(same, 0).otherwise(1)).over(order))
        merged = branches.groupBy("host", "node", "score", "g").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.array_sort(F.collect_list("branch")).alias("names"))
        merged = merged.select("host", "node", F.explode("names").alias("branch"), pure(F.col("b"), F.col("n"), F.col("score")).alias("below"), F.when(F.size("names") > 1, F.concat(F.lit("("), F.array_join("names", "|"), F.lit(")"))).otherwise(F.get("names", F.lit(0))).alias("name"))
        ways = values.select("host", "node", "seg", "branch").join(merged, ["host", "node", "branch"]).select("host", "node", "seg", "below", "name")
        live = live.join(ways, ["host", "node", "seg"]).select("host", "shape", "rest", F.concat("node", F.lit("/"), "name").alias("node"), F.col("below").alias("score"), "n", "b", "a")
        live = materialize(live, "level")
    done.append(live.select("host", "shape", "node", "score"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("node", "template")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, depth: int = 8, **fit) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, score) of every row of (page_id, url)."""
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, label = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), label.alias("label"), F.array_join(segments(F.col("path"), depth), "/").alias("shape"))
    found = materialize(templates(rows, depth, **fit), "templates")
    verdict = F.coalesce("label", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return rows.join(small(found), ["host", "shape"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "score")
