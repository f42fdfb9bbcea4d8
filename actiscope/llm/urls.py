"""URL filters: rules, then trust and distrust spread over the graph of hosts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actiscope.session import stored

RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
DAMPING = 0.85
ROUNDS = 10
"""Rounds after which ``trust`` and ``distrust`` are reported; verdicts wait until scores settle."""
SETTLED = 1e-6
"""Share of each score that five rounds may still change once scores count as settled."""
MOST_ROUNDS = 200
"""Rounds at most: what is still to be spread is then 1e-14 of what was given out, less than the rounding of sums."""
TOLERANCE = 1e-9
"""Share of their sum by which distrust must exceed trust, so that the order of sums doesn't decide."""
DIGITS = 12
"""Decimals of the reported trust and distrust."""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for others and null."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and what it says; null without one. The same rule twice: the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1]), reverse=True)[::-1]:
        its_host, _, its_path = text.partition("/")
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith("/" + its_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """``src, dst, share``: links between hosts and between a host and its parent domains, each with its share of ``src``.

    ``pages`` has ``host``. A page counts once for each host it links to, so weights are numbers of
    pages. Every host of three labels or more is tied to the domain above it, both ways with weight 1.
    """
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK)), lambda h: F.translate(h, UPPER, LOWER)))).alias("dst"))
    # Written, so that the pages are searched once.
    links = stored(links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")), "links")
    hosts = links.select(F.col("src").alias("host")).union(links.select("dst")).union(pages.select("host")).distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    chain = hosts.where(F.size(labels) > 2).select(F.explode(F.arrays_zip(F.slice(above, 1, F.size(above) - 1).alias("a"), F.slice(above, 2, F.size(above)).alias("b"))).alias("x"))
    up = chain.select(F.col("x.a").alias("src"), F.col("x.b").alias("dst")).distinct()
    ties = up.union(up.select("dst", "src")).withColumn("weight", F.lit(1.0))
    edges = stored(links.union(ties).where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    return edges.join(out, "src").select("src", "dst", "weight", (F.col("weight") / F.col("total")).alias("share"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Personalised PageRank: ``kind, host, score`` after some rounds, and once settled.

    ``seeds`` is (kind, host, score) and ``edges`` (kind, src, dst, share); both kinds spread in the same
    joins. Every fifth round is written to the work folder, which cuts the lineage. Scores are settled when five
    rounds reach no new host and change each score by a small share of itself, however small it is, or when
    ``MOST_ROUNDS`` have left nothing to spread.
    """
    edges, seeds = stored(edges, "shares"), stored(seeds, "seeds")
    again = seeds.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    scores = before = seeds
    n, early = 0, None
    while True:
        n += 1
        sent = edges.join(scores.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("share") * F.col("score") * damping).alias("score")
        )
        scores = sent.union(again).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if n == rounds or n % 5 == 0:
            scores = stored(scores, "scores")
        if n == rounds:
            early = scores
        if n % 5 == 0:
            moved = scores.join(before.withColumnRenamed("score", "was"), ["kind", "host"], "left")
            if n >= MOST_ROUNDS or n >= rounds and moved.where(f"was is null or abs(score - was) > {SETTLED} * score").isEmpty():
                return early, scores
            before = scores


def reversed_shares(edges: DataFrame) -> DataFrame:
    into = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    return edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("total")).alias("share"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` per page.

    Pages that a rule decides are the seeds: trust starts at hosts in proportion to their
    allowed pages and follows links, distrust at their blocked pages and goes against links. A page
    without a rule is blocked when its host's settled distrust exceeds its trust, at full precision; a host that neither
    reaches is allowed. The two columns show the scores after ten rounds, rounded. Null or odd urls have an empty host, null html no links; repeated
    rows are judged alike. The page side of the last join is keyed by host, and adaptive execution splits hot hosts.
    """
    read = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    ruled = read.withColumns({"rule": rule, "said": says})
    edges = stored(host_edges(read), "graph")
    kinds = ruled.where("said is not null and host != ''").groupBy(F.col("said").alias("kind"), "host").agg(F.count(F.lit(1)).cast("double").alias("score"))
    kinds = stored(kinds, "kinds")
    total = {r.kind: r.n for r in kinds.groupBy("kind").agg(F.sum("score").alias("n")).collect()}
    share = F.col("score") / F.when(F.col("kind") == "allow", F.lit(total.get("allow", 1.0))).otherwise(F.lit(total.get("block", 1.0)))
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "share").union(reversed_shares(edges).select(F.lit("block"), "src", "dst", "share"))
    early, settled = propagate(both, kinds.withColumn("score", share))
    score = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    hosts = early.groupBy("host").agg(score("allow").alias("trust"), score("block").alias("distrust"))
    final = settled.groupBy("host").agg(score("allow").alias("for"), score("block").alias("against"))
    blocked = final.select("host", (F.col("against") - F.col("for") > TOLERANCE * (F.col("against") + F.col("for"))).alias("blocked"))
    trust, distrust = (F.round(F.coalesce(c, F.lit(0.0)), DIGITS) for c in ("trust", "distrust"))
    judged = ruled.select("page_id", "host", "path", "rule", "said").join(blocked.join(hosts, "host", "left"), "host", "left")
    spread = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", spread).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def oracle() -> str:
    """The same judgement in SQL, the rounds written out."""
    when = []
    for says, text in sorted(RULES, key=lambda r: len(r[1]), reverse=True):
        host, _, path = text.partition("/")
        when.append((f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')", text, says))
    rule = "case " + " ".join(f"when {w} then '{t}'" for w, t, _ in when) + " end"
    said = "case " + " ".join(f"when {w} then '{s}'" for w, _, s in when) + " end"
    steps = ["s0 as (select kind, host, n / sum(n) over (partition by kind) as score from seed)"]
    for n in range(1, ROUNDS + 1):
        steps.append(
            f"""s{n} as materialized (select kind, host, sum(score) as score from (
            select e.kind, dst as host, share * score * {DAMPING} as score from e join s{n - 1} s on e.kind = s.kind and e.src = s.host
            union all select kind, host, score * (1 - {DAMPING}) from s0) group by 1, 2)"""
        )
    return f"""with a as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path, coalesce(html, '') as html from pages),
    b as (select *, {rule} as rule, {said} as said from a),
    l as (select src, dst, count(*)::double as weight from (select distinct page_id, host as src, translate(unnest(regexp_extract_all(html,
        '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s>]+)', 1)), '{UPPER}', '{LOWER}') as dst from a) group by 1, 2),
    h as (select src as host from l union select dst from l union select host from a),
    c as (select distinct list_aggregate(x[i:], 'string_agg', '.') as src, list_aggregate(x[i + 1:], 'string_agg', '.') as dst
        from (select string_split(host, '.') as x from h) cross join range(1, 20) t(i) where i <= len(x) - 2),
    g as (select src, dst, sum(weight) as weight from (select * from l union all select src, dst, 1 from c union all select dst, src, 1 from c)
        where src <> dst and src <> '' and dst <> '' group by 1, 2),
    e as materialized (select 'allow' as kind, src, dst, weight / sum(weight) over (partition by src) as share from g
        union all select 'block', dst, src, weight / sum(weight) over (partition by dst) from g),
    seed as (select said as kind, host, count(*)::double as n from b where said is not null and host <> '' group by 1, 2),
    {", ".join(steps)},
    t as (select host, sum(case when kind = 'allow' then score else 0 end) as trust, sum(case when kind = 'block' then score else 0 end) as distrust
        from s{ROUNDS} group by 1),
    v as (select b.*, round(coalesce(trust, 0), {DIGITS}) as trust, round(coalesce(distrust, 0), {DIGITS}) as distrust from b left join t using (host))
    select page_id, host, path, rule, coalesce(said, case when round(distrust - trust, {DIGITS}) > 0 then 'block' else 'allow' end) as verdict, trust, distrust from v"""
