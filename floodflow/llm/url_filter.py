"""URL filter: host rules, and a path-template tree per host for the rest.

A rule (verdict, host, path) fits its host and all subdomains when the path starts
with the rule's; of several the longest (as text) decides, then the first given. Urls
no rule fits are judged by templates learned from those that a rule fits (or from
``labels``), host by host:

1. Paths are cut at ``/``. A segment that varies by its form becomes a wildcard:
   digits give ``{n}``, long hex or mixed letters and digits ``{id}``; an extension
   stays. Segments from ``max_depth`` on are one wildcard ``{rest}``.
2. Level by level, a segment that fewer than ``min_rows`` urls of its branch have
   becomes ``*`` of that branch: values that vary without a form.
3. Sibling branches are merged when their statistics agree: same kind of branch (a
   wildcard or a name) and the same side of the decision, by the Wilson interval of
   the share of blocked labels (surely above a half, surely below, undecided,
   without labels). Merged branches share one subtree from there on.
4. Each node has a purity: its blocked labels, smoothed by its parent's purity with
   the weight of ``prior`` labels (the root by the share in all labels, which the
   labels of other hosts set). A template, the deepest node of a url, is rejected
   when its purity is at least ``least_purity`` and its first-level branch has labels
   (``evidence``): that other sections of the host are bad says nothing against it.

Each level is one grouping of (host, branch, segment) rows with map-side sums, then
joins of branch tables back to the distinct shapes, so a host with a third of all
urls costs a row per shape and task. A url meets its shape's verdict in a last join,
a broadcast one only while the table of verdicts is under ``BROADCAST_BYTES``.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule
and the verdict of the template of the empty host; without labels all are allowed;
rows that repeat get equal results; a null page id stays null; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodflow.llm.base import lower_ascii, materialize

#: Fixed values of the contract: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
MAX_DEPTH = 6
MIN_ROWS = 8
PRIOR = 4.0
LEAST_PURITY = 0.8
#: z of the interval that tells branches apart.
_Z = 1.96
BROADCAST_BYTES = 8 << 20


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, whole.substr(at + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(whole)), r"^([^?#]*)", 1)
    return lower_ascii(host), path


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the deciding rule, null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shape(path: Column, max_depth: int) -> Column:
    """Segments of a path after the first ``/``, those that vary by form as wildcards."""
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/", max_depth + 1)

    def form(s: Column) -> Column:
        name = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1)
        ending = F.lower(F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))
        mixed = name.rlike("[0-9]") & name.rlike("[A-Za-z]") & (F.length(name) >= 6)
        return (F.when(name.rlike(r"^[0-9]+$"), F.concat(F.lit("{n}"), ending))
                .when(name.rlike(r"^[0-9a-fA-F-]{8,}$") | mixed, F.concat(F.lit("{id}"), ending))
                .otherwise(s))

    return F.transform(parts, lambda s, i: F.when(i >= max_depth, F.lit("{rest}")).otherwise(form(s)))


def _side(blocked: Column, labelled: Column) -> Column:
    """-1, 0 or 1: share of blocked labels below, around or above a half; null: none."""
    share = blocked / labelled
    middle = (share + _Z * _Z / 2 / labelled) / (1 + _Z * _Z / labelled)
    half = (_Z * F.sqrt(share * (1 - share) / labelled + _Z * _Z / 4 / labelled / labelled)
            / (1 + _Z * _Z / labelled))
    return (F.when(labelled == 0, F.lit(None)).when(middle - half > 0.5, F.lit(1))
            .when(middle + half < 0.5, F.lit(-1)).otherwise(F.lit(0)))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]


def templates(shapes: DataFrame, max_depth: int = MAX_DEPTH, min_rows: int = MIN_ROWS,
              prior: float = PRIOR) -> DataFrame:
    """Per (host, segs) of ``shapes`` (with n, labelled, blocked): template, its purity
    and ``evidence``, the labels of its first-level branch."""
    everything = shapes.agg(F.sum("labelled"), F.sum("blocked")).first()
    base = (everything[1] or 0) / everything[0] if everything[0] else 0.0
    root = shapes.groupBy("host").agg(*_sums())
    nodes = root.select("host", ((F.col("blocked") + prior * base) / (F.col("labelled") + prior)).alias("purity"))
    rows = materialize(shapes.join(nodes, "host").select(
        "host", "segs", "n", "labelled", "blocked", F.lit("").alias("branch"), "purity",
        F.lit(0).cast("long").alias("evidence")), "url-level")
    for depth in range(max_depth + 1):
        here = rows.where(F.size("segs") > depth).withColumn("seg", F.get("segs", F.lit(depth)))
        if here.isEmpty():
            break
        children = here.groupBy("host", "branch", "seg").agg(*_sums(), F.first("purity").alias("above"))
        wild = F.col("seg").startswith("{") | (F.col("seg") == "")
        children = children.withColumn("kind", F.when(wild, F.col("seg")).when(
            F.col("n") < min_rows, F.lit("*")).otherwise(F.lit("a")))
        # Rare names are one branch; then branches of one kind and one side are one.
        rare = (children.where("kind = '*'").groupBy("host", "branch", "kind").agg(*_sums(), F.first("above").alias("above"))
                .withColumn("key", F.lit("*")))
        named = children.where("kind <> '*'").withColumn("key", F.col("seg"))
        split = rare.unionByName(named.drop("seg")).withColumn("side", _side(F.col("blocked"), F.col("labelled")))
        merged = (split.groupBy("host", "branch", "kind", "side").agg(
            *_sums(), F.first("above").alias("above"), F.min("key").alias("name"), F.count(F.lit(1)).alias("many"))
            .withColumn("label", F.when(F.col("many") == 1, F.col("name")).otherwise(
                F.concat(F.lit("["), F.col("name"), F.lit("|.."), F.col("many").cast("string"), F.lit("]")))))
        child = (split.select("host", "branch", "kind", "key", "side")
                 .join(merged.withColumnRenamed("side", "side2").select(
                     "host", "branch", "kind", "side2", "label", F.col("labelled").alias("m_labelled"),
                     ((F.col("blocked") + prior * F.col("above")) / (F.col("labelled") + prior)).alias("m_purity")),
                     ["host", "branch", "kind"]).where(F.col("side").eqNullSafe(F.col("side2")))
                 .select("host", "branch", "kind", "key", "label", "m_labelled", "m_purity"))
        keys = children.select("host", "branch", "seg", "kind", F.when(F.col("kind") == "*", F.lit("*")).otherwise(
            F.col("seg")).alias("key")).join(child, ["host", "branch", "kind", "key"]).drop("kind", "key")
        joined = rows.withColumn("seg", F.get("segs", F.lit(depth))).join(keys, ["host", "branch", "seg"], "left")
        found = F.col("label").isNotNull()
        rows = materialize(joined.select(
            "host", "segs", "n", "labelled", "blocked",
            F.when(found, F.concat_ws("/", "branch", "label")).otherwise(F.col("branch")).alias("branch"),
            F.when(found, F.col("m_purity")).otherwise(F.col("purity")).alias("purity"),
            (F.coalesce("m_labelled", F.lit(0)) if not depth else F.col("evidence")).alias("evidence")), "url-level")
    return rows.select("host", "segs", F.col("branch").alias("template"), "purity", "evidence")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES,
          max_depth: int = MAX_DEPTH, min_rows: int = MIN_ROWS, prior: float = PRIOR,
          least_purity: float = LEAST_PURITY) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, template, purity, verdict.

    ``labels`` (page_id, blocked boolean) replaces the rules' verdicts as what is
    learned from; of several labels of a page the blocking one counts."""
    host, path = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_verdict", verdict).withColumn("segs", shape(F.col("path"), max_depth))
    if labels is None:
        taught = rows.withColumn("_blocked", F.col("_verdict") == "block")
    else:
        known = labels.where(F.col("page_id").isNotNull() & F.col("blocked").isNotNull()) \
            .groupBy("page_id").agg(F.max("blocked").alias("_blocked"))
        taught = rows.join(known, "page_id", "left")
    shapes = materialize(taught.groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count("_blocked").alias("labelled"),
        F.count(F.when(F.col("_blocked"), 1)).alias("blocked")), "url-shapes")
    learned = materialize(templates(shapes, max_depth, min_rows, prior).withColumn(
        "_reject", (F.col("evidence") > 0) & (F.col("purity") >= least_purity)), "url-templates")
    size = learned.agg(F.sum(F.octet_length("host") + F.octet_length(F.concat_ws("/", "segs"))
                             + F.octet_length("template") + 64)).first()[0] or 0
    out = rows.join(F.broadcast(learned) if size <= BROADCAST_BYTES else learned, ["host", "segs"], "left")
    return out.select("page_id", "host", "path", "rule", "template", "purity", F.coalesce(
        "_verdict", F.when(F.col("_reject"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
