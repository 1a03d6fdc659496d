"""Sources mixed to target shares of tokens within capped repeats, by minimum-cost flow over membership patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.flows import cheapest_flow
from docketry.operators.ranking import running, seeded_key

#: Different sets of sources that documents belong to; the flow is solved on the driver over their sums.
MOST_PATTERNS = 20_000


def routed(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each membership pattern gives to each source.

    patterns: tokens of the documents that belong to exactly those sources. A pattern's tokens can be used again; the
    second use costs 1 a token, the third 2 and so on, and a source takes a pattern at most its number of repeats. Quotas
    are filled as far as possible, and of all ways to do so one of the least cost is returned.
    """
    arcs: list[tuple[object, object, int, int]] = []
    links: dict[int, tuple[tuple[str, ...], str]] = {}
    for p, tokens in sorted(patterns.items()):
        mine = [s for s in p if s in quotas]
        if not mine or not tokens:
            continue
        for use in range(max(repeats[s] for s in mine)):
            arcs.append(("S", ("p", p), tokens, use))
        for s in mine:
            links[len(arcs)] = (p, s)
            arcs.append((("p", p), ("q", s), tokens * repeats[s], 0))
    arcs += [(("q", s), "T", q, 0) for s, q in sorted(quotas.items())]
    flows = cheapest_flow(arcs, "S", "T")
    return {x: flows[i] for i, x in links.items() if flows[i]}


#: Quotas and routed amounts are whole numbers of 1/SCALE tokens, so that shares of the mix are exact.
SCALE = 10_000


def _plan(documents: DataFrame, targets: DataFrame, numerator: int, denominator: int) -> tuple[int, list, dict, dict, dict]:
    rows = targets.where("_name IS NOT NULL").collect()
    total = documents.agg(F.coalesce(F.sum("_tokens"), F.lit(0))).first()[0]
    size = total * numerator // denominator
    sums = documents.where(F.size("_pattern") > 0).groupBy("_pattern").agg(F.sum("_tokens").alias("t")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of membership")
    patterns = {tuple(r["_pattern"]): r["t"] for r in sums}
    quotas = {r["_name"]: size * r["target_bp"] * SCALE // 10_000 for r in rows}
    flows = routed({p: t * SCALE for p, t in patterns.items()}, quotas, {r["_name"]: r["max_repeats"] for r in rows})
    return size, rows, patterns, quotas, flows


def _prepared(documents: DataFrame, targets: DataFrame, members: str, key: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    named = targets.select("source", F.coalesce("target_bp", F.lit(0)).alias("target_bp"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.lower(F.trim("source")).alias("_name"))
    sought = F.array(*[F.lit(r[0]) for r in named.where("_name IS NOT NULL").select("_name").distinct().collect()]).cast("array<string>")
    pattern = F.array_sort(F.array_intersect(F.coalesce(F.col(members), F.array().cast("array<string>")), sought))  # other sources route nothing
    own = documents.select(F.col(key).alias("_key"), pattern.alias("_pattern"), F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)).alias("_tokens"))
    return own, named


def _drawn(own: DataFrame, rows: list, patterns: dict, flows: dict, key: str, seed: int) -> DataFrame:
    spelled = {r["_name"]: r["source"] for r in rows}
    at: dict[tuple[str, ...], int] = {}
    parts = []
    whole = lambda x: (x + SCALE // 2) // SCALE  # noqa: E731; places in tokens
    for (p, s), amount in sorted(flows.items()):
        begin = at.get(p, 0)
        parts.append((list(p), patterns[p], spelled[s], whole(begin), whole(begin + amount)))
        at[p] = begin + amount
    plan = own.sparkSession.createDataFrame(parts, "_pattern array<string>, _all bigint, source string, _from bigint, _to bigint")
    placed = running(own.where(F.size("_pattern") > 0).withColumn("_order", seeded_key(seed, "_key")), ["_pattern"], "_order", "_key", F.col("_tokens"))
    # The number of rounds in which the middle of the document comes before end.
    rounds = lambda end: F.expr(f"greatest(0, (2 * ({end} - before) - _tokens + 2 * _all - 1) div (2 * _all))")
    used = placed.join(F.broadcast(plan), "_pattern").withColumn("uses", rounds("_to") - rounds("_from"))
    return used.where("uses > 0").select("source", F.col("_key").alias(key), "uses", (F.col("uses") * F.col("_tokens")).alias("tokens"))


def mix(documents: DataFrame, targets: DataFrame, members: str, key: str = "doc_id", tokens: str = "n_tokens", numerator: int = 3, denominator: int = 5, seed: int = 0) -> DataFrame:
    """(source, key, uses, tokens): the documents of the mix, each with how often a source uses it.

    members is an array of the sources that a document belongs to, in lower case without blanks at the ends; null and
    empty arrays belong to no source and are in no mix. targets has source, target_bp and max_repeats (nulls count as
    0), each source once. The mix has numerator / denominator of all tokens. A source's part of a pattern of membership
    is an interval of the endless repetition of its documents in seeded order, as long as the flow gives it tokens; a
    document is used as often as its middle lies in it, so the last one only where that comes nearer to the share. Each
    end of a part is off by at most half a document, and a source that takes all of a pattern by none. Positions are
    running totals that no single task sums over a source.
    """
    own, named = _prepared(documents, targets, members, key, tokens)
    _, rows, patterns, _, flows = _plan(own, named, numerator, denominator)
    return _drawn(own, rows, patterns, flows, key, seed)


def mix_report(documents: DataFrame, targets: DataFrame, members: str, key: str = "doc_id", tokens: str = "n_tokens", numerator: int = 3, denominator: int = 5, seed: int = 0) -> DataFrame:
    """Per source of targets: own_tokens, quota, routed (by the flow, both in tokens), reachable, mixed (by the documents
    drawn), actual_bp (of the size asked for), off_bp (actual less target) and share_bp (of what all sources reach).

    reachable says whether the flow fills the source's exact share of the mix. Shares that can't be filled aren't handed
    on to other sources; the mix is then smaller by them.
    """
    own, named = _prepared(documents, targets, members, key, tokens)
    size, rows, patterns, quotas, flows = _plan(own, named, numerator, denominator)
    have = {r["_name"]: sum(t for p, t in patterns.items() if r["_name"] in p) for r in rows}
    sent = {r["_name"]: sum(v for (_, s), v in flows.items() if s == r["_name"]) for r in rows}
    plan = [(r["source"], r["target_bp"], r["max_repeats"], have[r["_name"]], quotas[r["_name"]] / SCALE, sent[r["_name"]] / SCALE, sent[r["_name"]] == quotas[r["_name"]]) for r in rows]
    table = own.sparkSession.createDataFrame(plan, "source string, target_bp int, max_repeats int, own_tokens bigint, quota double, routed double, reachable boolean")
    chosen = _drawn(own, rows, patterns, flows, key, seed).groupBy("source").agg(F.sum("tokens").alias("mixed"))
    out = table.join(chosen, "source", "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
    reached = out.withColumn("actual_bp", F.round(F.col("mixed") * 10_000 / F.greatest(F.lit(size), F.lit(1)), 2)).withColumn("off_bp", F.round(F.col("actual_bp") - F.col("target_bp"), 2))
    whole = F.greatest(F.sum("mixed").over(Window.partitionBy(F.lit(0))), F.lit(1))  # one row per source
    return reached.withColumn("share_bp", F.round(F.col("mixed") * 10_000 / whole, 2))


def short_sources(report: DataFrame) -> DataFrame:
    """The sources of a mix_report to which the flow routes less than their share, so that what is drawn falls short too."""
    return report.where("routed < quota AND mixed < quota").select("source")
