"""URL verdicts by rules, and by a tree of path templates for each host.

*Rules* (host, path, verdict) fit a host and its subdomains where the path starts with the rule's; the longest one wins.

*Templates.*  A path's segments are the levels of a tree below its host, as deep as paths branch.  Numbers, long hexadecimal
strings and those with a file ending are wildcards from the start; then, level by level, the children of a node become one wildcard if
they are many and none has much of the node's pages.  Sibling branches whose labelled shares don't differ statistically are merged into
one class.  A template is rejected if its class's share of pages labelled bad, smoothed by a prior of PRIOR_WEIGHT pages, reaches REJECT.
The prior is PRIOR for a class of MERGE_PAGES labels or more.  One of fewer has the purity of the nearest class above it that has as many,
the host being the last; where there is none, that of the same template on other hosts, each host counting as one page beside the prior.

Pages are summed to distinct paths of templates before any key is dealt out, so a host with a third of all pages costs as many rows as it
has templates; the judged templates are written, so that Spark knows their size before it joins them.

Defined cases: a null url or one without :// has empty host and path, fits no rule and is allowed; an empty table gives none; repeated rows stay rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.workspace import Workspace

#: Children that may become one wildcard, at least, and the greatest share one of them may have.
WILD_KINDS, WILD_SHARE = 16, 0.2
#: The prior share of bad pages and its weight in pages; the smoothed share that rejects; labelled pages that a merge or a purity of its own takes, and the normal quantile it allows.
PRIOR, PRIOR_WEIGHT, REJECT, MERGE_PAGES, MERGE_Z = 0.1, 5.0, 0.8, 5, 1.96

Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: str, path: str, rules: list[Rule]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last that fits is the longest
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.startswith(F.col(path), F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _segments(path: str) -> Column:
    """The segments, wildcards where one is plainly variable."""
    parts = F.filter(F.split(F.col(path), "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, r"^(?:[0-9]+|[0-9a-fA-F-]{8,})(?=$|\.[A-Za-z0-9]{1,5}$)", "*"))


def _smoothed(hits: str, labelled: str, prior: Column) -> Column:
    return (F.col(hits) + prior * PRIOR_WEIGHT) / (F.col(labelled) + PRIOR_WEIGHT)


def _level(tree: DataFrame, i: int) -> DataFrame:
    """tree one level down: templates and classes a segment longer, the purity of the nearest class with labels enough, and whether there is more to tell apart."""
    rows = tree.withColumn("s", F.coalesce(F.get("segments", F.lit(i)), F.lit("")))
    kinds = rows.groupBy("host", "made", "s").agg(F.sum("n").alias("n")).groupBy("host", "made").agg(F.count("*").alias("kinds"), (F.max("n") / F.sum("n")).alias("share"))
    wild = (F.col("kinds") >= WILD_KINDS) & (F.col("share") <= WILD_SHARE) & (F.col("s") != "")
    rows = rows.join(kinds, ["host", "made"]).withColumn("t", F.when(wild, "*").otherwise(F.col("s"))).drop("kinds", "share")
    # A branch belongs to the class of siblings like their parent, or to one of its own; no segment has a slash.
    here = rows.groupBy("host", "class", "t").agg(F.sum("labelled").alias("here_n"), F.sum("hits").alias("here_k"))
    above = here.groupBy("host", "class").agg(F.sum("here_n").alias("up_n"), F.sum("here_k").alias("up_k"))
    rate = F.col("up_k") / F.greatest("up_n", F.lit(1))
    z = F.abs(F.col("here_k") - F.col("here_n") * rate) / F.sqrt(F.greatest(F.col("here_n") * rate * (1 - rate), F.lit(1e-9)))
    alike = (F.col("here_n") >= MERGE_PAGES) & (z < MERGE_Z) & (F.col("t") != "")
    here = here.join(above, ["host", "class"]).select("host", "class", "t", F.when(alike, "/").otherwise(F.col("t")).alias("c"))
    rows = rows.join(here, ["host", "class", "t"])
    pure = rows.groupBy("host", "class", "c").agg(F.sum("labelled").alias("class_n"), F.sum("hits").alias("class_k"), F.count("*").alias("paths"))
    rows = rows.drop("class_n", "class_k").join(pure, ["host", "class", "c"])
    near = F.when(F.col("class_n") >= MERGE_PAGES, _smoothed("class_k", "class_n", F.lit(PRIOR))).otherwise(F.col("near"))
    made = F.when(F.col("t") != "", F.concat("made", F.array("t"))).otherwise(F.col("made"))
    return rows.select("host", "segments", "n", "labelled", "hits", made.alias("made"), F.concat("class", F.array("c")).alias("class"), near.alias("near"), "class_n", "class_k", ((F.col("s") != "") & (F.col("paths") > 1)).alias("open"))


def judged_templates(pages: DataFrame, space: Workspace) -> DataFrame:
    """host, segments, template, purity, rejected, of pages (host, path, bad: true, false, or null where unlabelled)."""
    tree = pages.select("host", "bad", _segments("path").alias("segments"))
    tree = tree.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("hits"))
    tree = space.keep(tree, "paths")
    none = F.array().cast("array<string>")
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("class_n"), F.sum("hits").alias("class_k"))
    hosts = hosts.withColumn("near", F.when(F.col("class_n") >= MERGE_PAGES, _smoothed("class_k", "class_n", F.lit(PRIOR))))
    tree = tree.join(hosts, "host").withColumns({"made": none, "class": none})
    ended, i = [], 0
    while True:  # a path alone in its class ends, so levels go as far as paths branch
        rows = space.keep(_level(tree, i), f"level-{i}")
        i += 1
        rest = F.slice("segments", i + 1, F.greatest(F.size("segments") - i, F.lit(0)))
        ended.append(rows.where("not open").withColumn("made", F.concat("made", rest)))
        tree = rows.where("open")
        if not tree.limit(1).count():
            break
    tree = ended[0]
    for rows in ended[1:]:
        tree = tree.unionByName(rows)
    tree = tree.withColumn("template", F.concat_ws("/", F.lit(""), F.col("made")))
    # What other hosts' pages of the template say, a host counting once.
    told = tree.groupBy("template", "host").agg(F.sum("labelled").alias("of"), F.sum("hits").alias("k")).where("of > 0").select("template", "host", (F.col("k") / F.col("of")).alias("own"))
    every = told.groupBy("template").agg(F.count("*").alias("hosts"), F.sum("own").alias("shares"))
    tree = tree.join(told, ["template", "host"], "left").join(every, "template", "left")
    others = F.coalesce("hosts", F.lit(0)) - F.col("own").isNotNull().cast("int")
    across = (F.coalesce("shares", F.lit(0.0)) - F.coalesce("own", F.lit(0.0)) + PRIOR * PRIOR_WEIGHT) / (others + PRIOR_WEIGHT)
    few = _smoothed("class_k", "class_n", F.coalesce(F.col("near"), across))
    purity = F.round(F.when(F.col("class_n") >= MERGE_PAGES, F.col("near")).otherwise(few), 12).alias("purity")
    out = tree.select("host", "segments", "template", purity).withColumn("rejected", F.col("purity") >= REJECT)
    return space.keep(out, "judged")


def judged_pages(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each row of pages (page_id, url); the rules' verdicts label the templates."""
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule("host", "path", rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    space = Workspace(pages.sparkSession, "urls")
    judged = judged_templates(rows.select("host", "path", (F.col("by_rule") == "block").alias("bad")), space)
    space.only("judged")
    rows = rows.withColumn("segments", _segments("path")).join(judged, ["host", "segments"], "left")
    by_template = F.when(F.col("rejected"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_template).alias("verdict"), "template", "purity")
