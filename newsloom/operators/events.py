"""Articles clustered into events, and later articles assigned to them in time order."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.graph import connected_components
from newsloom.operators.ranking import Ordered, global_row_number
from newsloom.runtime import Scratch


def entity_idf(sets: DataFrame, n_articles: int, high_ratio: float) -> DataFrame:
    """``entity, document_frequency, document_frequency_ratio, idf, is_high_df`` over distinct (article, entity)."""
    df = sets.groupBy("entity").agg(F.count("*").alias("document_frequency"))
    return df.select(
        "entity",
        "document_frequency",
        (F.col("document_frequency") / F.lit(max(n_articles, 1))).alias("document_frequency_ratio"),
        (F.log(F.lit(n_articles + 1) / (F.col("document_frequency") + 1)) + 1).alias("idf"),
        (F.col("document_frequency") / F.lit(max(n_articles, 1)) >= high_ratio).alias("is_high_df"),
    )


def clustering_sets(sets: DataFrame, idf: DataFrame) -> DataFrame:
    """``article_id, entity, idf`` of the entities that tie articles together."""
    return sets.join(idf.where("not is_high_df").select("entity", "idf"), "entity").select("article_id", "entity", "idf")


def micros(c: str) -> F.Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def similarity_pairs(csets: DataFrame, times: DataFrame, hours: int = 72) -> DataFrame:
    """``a, b, inter, sim``: pairs of articles within ``hours`` that share an entity, the earlier one first.

    The pairs meet on (entity, time slice): a slice is as long as the window, so
    a partner stands in the same or the next one and a frequent entity's posting
    list is cut by time before it is joined with itself.
    """
    width = hours * 3600 * 1_000_000
    total = csets.groupBy("article_id").agg(F.sum("idf").alias("w"))
    base = csets.join(times.select("article_id", micros("published_time").alias("t")), "article_id").withColumn("s", F.floor(F.col("t") / width))
    left = base.select("entity", "idf", F.col("article_id").alias("a"), F.col("t").alias("ta"), F.explode(F.array("s", F.col("s") + 1)).alias("s"))
    right = base.select("entity", F.col("article_id").alias("b"), F.col("t").alias("tb"), "s")
    met = left.join(right, ["entity", "s"]).where("(ta < tb or (ta = tb and a < b))").where(F.col("tb") - F.col("ta") <= width)
    inter = met.groupBy("a", "b").agg(F.sum("idf").alias("inter"))
    wa, wb = total.select(F.col("article_id").alias("a"), F.col("w").alias("wa")), total.select(F.col("article_id").alias("b"), F.col("w").alias("wb"))
    return inter.join(wa, "a").join(wb, "b").select("a", "b", "inter", F.round(F.col("inter") / (F.col("wa") + F.col("wb") - F.col("inter")), 9).alias("sim"))


def pairs_in_window(times: DataFrame, hours: int = 72) -> DataFrame:
    """How many pairs of articles lie within the window, without forming them.

    Counts by distinct time are pre-aggregated; each time counts the articles at
    most a window later through a range window over time slices, so no task sees
    all times.
    """
    width = hours * 3600 * 1_000_000
    at = times.select(micros("published_time").alias("t")).groupBy("t").agg(F.count("*").alias("n")).withColumn("s", F.floor(F.col("t") / width))
    # every time is seen by its own slice and, as a partner only, by the slice before
    seen = at.select("t", "n", F.lit(True).alias("own"), "s").unionByName(at.select("t", "n", F.lit(False).alias("own"), (F.col("s") - 1).alias("s")))
    w = Window.partitionBy("s").orderBy("t").rangeBetween(0, width)
    ahead = seen.withColumn("ahead", F.sum("n").over(w) - F.col("n")).where("own")
    return ahead.agg(F.coalesce(F.sum(F.col("n") * F.col("ahead") + F.expr("n * (n - 1) div 2")), F.lit(0)).cast("bigint").alias("n_pairs"))


def similarity_edges(articles: DataFrame, sets: DataFrame, scratch: Scratch, theta: float = 0.3, hours: int = 72, high_ratio: float = 0.01) -> dict[str, DataFrame]:
    """``base`` articles, ``idf``, clustering sets ``csets`` and ``edges``, the pairs similar enough."""
    if not (0 < theta <= 1 and hours > 0 and 0 < high_ratio <= 1):
        raise ValueError("theta and high_ratio lie in (0, 1], hours is positive")
    base = scratch.keep(articles.select("article_id", "published_time"))
    own = scratch.keep(sets.join(base.select("article_id"), "article_id", "left_semi"))
    idf = scratch.keep(entity_idf(own, base.count(), high_ratio))
    csets = scratch.keep(clustering_sets(own, idf))
    return {"base": base, "idf": idf, "csets": csets, "edges": similarity_pairs(csets, base, hours).where(F.col("sim") >= theta)}


def cluster_events(articles: DataFrame, sets: DataFrame, scratch: Scratch, theta: float = 0.3, hours: int = 72, high_ratio: float = 0.01) -> dict[str, DataFrame]:
    """Train events.

    ``articles``: ``article_id, published_time``; ``sets``: distinct ``article_id,
    entity``.  Gives ``idf``, ``edges``, ``article_events`` and ``event_master``.
    Events are numbered from 0 by (first time, first article).
    """
    found = similarity_edges(articles, sets, scratch, theta, hours, high_ratio)
    base, idf, csets, edges = found["base"], found["idf"], found["csets"], scratch.keep(found["edges"])
    comps = connected_components(edges.select("a", "b"), scratch)
    members = base.join(comps.select(F.col("v").alias("article_id"), "component"), "article_id", "left").withColumn("component", F.coalesce("component", "article_id"))
    heads = members.groupBy("component").agg(F.min(F.struct("published_time", "article_id")).alias("first"), F.max("published_time").alias("last"), F.count("*").alias("n"))
    flat = heads.select("component", F.col("first.published_time").alias("event_start_time"), F.col("first.article_id").alias("first_article_id"), F.col("last").alias("event_last_added_time"), F.col("n").alias("event_article_count"))
    numbered = scratch.keep(global_row_number(flat, ["event_start_time", "first_article_id"], "event_id", scratch))
    article_events = scratch.keep(members.join(numbered.select("component", "event_id"), "component").select("article_id", "event_id", F.lit("train").alias("assignment_split"), "published_time"))
    names = csets.join(article_events.select("article_id", "event_id"), "article_id").groupBy("event_id").agg(F.sort_array(F.collect_set("entity")).alias("event_entities"))
    master = scratch.keep(numbered.join(names, "event_id", "left").select(
        "event_id",
        F.lit("train").alias("event_origin_split"),
        "event_start_time",
        "event_last_added_time",
        "event_article_count",
        F.col("event_article_count").alias("train_article_count"),
        F.coalesce("event_entities", F.array().cast("array<string>")).alias("event_entities"),
        F.coalesce(F.size("event_entities"), F.lit(0)).cast("bigint").alias("event_entity_count"),
        "first_article_id",
    ))
    return {"idf": idf, "csets": csets, "edges": edges, "article_events": article_events, "event_master": master}


def fold(events: list[tuple], arrivals: list[tuple], idf: dict[str, float], unseen: float, theta: float, width: int) -> list[tuple]:
    """Ordered assignment: for each arrival its event.

    ``events``: (event_id, last time, set of entities).  ``arrivals``: (time, article,
    set), in order.  Returns (article, event_id or None, creating article or None,
    number of events at least ``theta`` similar then).  A new event sorts after all
    train events, in the order of creation.  Events a window past are forgotten.
    """
    state: dict[tuple[int, int], list] = {(0, i): [last, set(s)] for i, last, s in events}
    by_entity: dict[str, set] = {}
    for key, (_, s) in state.items():
        for e in s:
            by_entity.setdefault(e, set()).add(key)
    weight = lambda s: sum(idf.get(x, unseen) for x in s)
    out, created = [], {}
    for t, article, s in arrivals:
        best, chosen, alike = theta, None, 0
        for key in sorted(set().union(*(by_entity.get(e, ()) for e in s)) if s else ()):
            last, own = state[key]
            if t - last > width:  # no later article can join it either
                for e in own:
                    by_entity[e].discard(key)
                del state[key]
                continue
            if t < last:
                continue
            inter = weight(sorted(s & own))
            sim = round(inter / (weight(sorted(s)) + weight(sorted(own)) - inter), 9)
            alike += sim >= theta
            if sim > best or (sim == best and chosen is None):
                best, chosen = sim, key
        if chosen is None:
            chosen = (1, len(created))
            created[chosen] = article
            state[chosen] = [t, set(s)]
        else:
            state[chosen][0] = t
            state[chosen][1] |= s
        for e in s:
            by_entity.setdefault(e, set()).add(chosen)
        out.append((article, chosen[1] if chosen[0] == 0 else None, created.get(chosen), alike))
    return out


def independent_groups(rows: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """``rows`` (``v`` the node, ``t``, ``entity``) with ``component``: nodes of different components never meet in the fold.

    An article and an event can only match through an entity they share; so
    connected components of nodes and entities are independent.  Where a
    component's times leave a gap of more than ``width``, nothing before it can
    be joined after it: it is cut there and its parts fall into components anew,
    until no gap is left.
    """
    nodes = scratch.keep(rows.select("v", "t", "entity", F.lit(0).cast("bigint").alias("part")))
    while True:
        # an entity is its least node, within the part
        tied = nodes.where("entity is not null")
        least = tied.groupBy("part", "entity").agg(F.min("v").alias("a"))
        comps = connected_components(tied.join(least, ["part", "entity"]).select("a", F.col("v").alias("b")), scratch)
        placed = scratch.keep(nodes.join(comps, "v", "left").select("v", "t", "entity", F.coalesce("component", "v").alias("component")))
        # a gap lies between slices, each as long as the width: one row a (component, slice) is looked at
        per = placed.groupBy("component", F.floor(F.col("t") / width).alias("slice")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
        w = Window.partitionBy("component").orderBy("slice")
        cut = (F.coalesce(F.col("t0") - F.lag("t1").over(w), F.lit(0)) > width).cast("bigint")
        parts = scratch.keep(per.withColumn("cut", cut).withColumn("nth", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("component", "slice", "cut", "nth"))
        if parts.where("cut = 1").isEmpty():
            return placed.select("v", "t", "entity", "component")
        cuts = placed.withColumn("slice", F.floor(F.col("t") / width)).join(parts, ["component", "slice"])
        nodes = scratch.keep(cuts.select("v", "t", "entity", F.xxhash64("component", "nth").alias("part")))


def assign_events(articles: DataFrame, sets: DataFrame, idf: DataFrame, master: DataFrame, n_train: int, scratch: Scratch, theta: float = 0.3, hours: int = 72) -> DataFrame:
    """``article_id, event_id, origin, published_time, created, alike, component`` for articles that arrive after clustering.

    Train events that no article with an entity of theirs follows within the
    window are never joined and left out; ``independent_groups`` are folded each
    by itself.  New events get ids after the train ones, in the order of (time,
    article) of the article that created them.  Entities unseen in train weigh
    ln(N + 1) + 1; the frequent ones stay left out.  ``alike`` is the number of
    events that were similar enough, ``component`` the group that was folded.
    """
    width, unseen = hours * 3600 * 1_000_000, math.log(n_train + 1) + 1
    known = idf.select("entity", "idf", "is_high_df")
    own = sets.join(articles.select("article_id"), "article_id", "left_semi").join(known, "entity", "left").where(~F.coalesce("is_high_df", F.lit(False)))
    arrivals = scratch.keep(
        articles.select(F.lit(1).alias("kind"), F.col("article_id").alias("id"), micros("published_time").alias("t")).join(
            own.select(F.col("article_id").alias("id"), "entity", F.coalesce("idf", F.lit(unseen)).alias("idf")), "id", "left"
        ).select("kind", "id", "t", "entity", "idf")
    )
    events = master.select(F.lit(0).alias("kind"), F.col("event_id").alias("id"), micros("event_last_added_time").alias("t"), F.explode("event_entities").alias("entity")).join(known.select("entity", "idf"), "entity", "left")
    slice_ = F.floor(F.col("t") / width)
    due = events.select("id", "entity", F.col("t").alias("last"), F.explode(F.array(slice_, slice_ + 1)).alias("slice"))
    followed = due.join(arrivals.where("entity is not null").select("entity", "t", slice_.alias("slice")), ["entity", "slice"]).where(F.col("t").between(F.col("last"), F.col("last") + width)).select("id").distinct()
    live = events.join(followed, "id", "left_semi")
    rows = scratch.keep(arrivals.unionByName(live.select("kind", "id", "t", "entity", "idf")).withColumn("v", F.col("id") * 2 + (1 - F.col("kind"))))  # articles even, events odd
    groups = independent_groups(rows, width, scratch)
    of = groups.select("v", "component").distinct()
    placed = rows.join(of, "v")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        weights = {e: w for e, w in zip(pdf["entity"], pdf["idf"], strict=True) if e is not None}
        packed: dict[tuple, set] = {}
        for k, i, t, e in zip(pdf["kind"], pdf["id"], pdf["t"], pdf["entity"], strict=True):
            s = packed.setdefault((int(k), int(i), int(t)), set())
            if e is not None:
                s.add(e)
        ev = [(i, t, s) for (k, i, t), s in packed.items() if k == 0]
        ar = sorted((t, i, s) for (k, i, t), s in packed.items() if k == 1)
        done = fold(ev, ar, weights, unseen, theta, width)
        out = pd.DataFrame(done, columns=["article_id", "event_id", "creator", "alike"])
        return out.assign(component=key[0]).astype({"article_id": "int64", "event_id": "Int64", "creator": "Int64", "alike": "int64", "component": "int64"})

    folded = scratch.keep(placed.groupBy("component").applyInPandas(run, "article_id bigint, event_id bigint, creator bigint, alike bigint, component bigint"))
    top = (master.agg(F.max("event_id")).first()[0] or 0) + 1 if not master.isEmpty() else 0
    creators = folded.where("creator is not null").select(F.col("creator").alias("article_id")).distinct().join(articles.select("article_id", "published_time"), "article_id")
    new_ids = global_row_number(creators, ["published_time", "article_id"], "new_id", scratch, start=top).select(F.col("article_id").alias("creator"), "new_id")
    return (
        folded.join(new_ids, "creator", "left")
        .join(articles.select("article_id", "published_time"), "article_id")
        .select("article_id", F.coalesce("event_id", "new_id").alias("event_id"), F.when(F.col("event_id").isNotNull(), "train").otherwise("validation").alias("origin"), "published_time", F.coalesce(F.col("creator") == F.col("article_id"), F.lit(False)).alias("created"), "alike", "component")
    )


def pairs_looked_at(master: DataFrame, assigned: DataFrame, scratch: Scratch, hours: int = 72) -> DataFrame:
    """How many (article, event) pairs lie within the window when the article arrives, without forming them.

    An event's last time is constant from one article that joins it to the next.
    Each such span counts the arrivals after the first and up to the second whose
    time is at most a window later; arrivals up to a time are a running count.
    """
    width = hours * 3600 * 1_000_000
    numbered = global_row_number(assigned.select("article_id", "event_id", micros("published_time").alias("t")), ["t", "article_id"], "n", scratch, start=1)
    numbered = scratch.keep(numbered)
    begun = master.select("event_id", micros("event_last_added_time").alias("t"), F.lit(0).cast("bigint").alias("n")).unionByName(numbered.select("event_id", "t", "n"))
    spans = begun.select("event_id", "t", "n", F.lead("n").over(Window.partitionBy("event_id").orderBy("n")).alias("until"))
    # arrivals before a train event's last time, and those at most a window after the last time
    points = spans.select(F.monotonically_increasing_id().alias("span"), "t", "n", "until")
    points = scratch.keep(points)
    asked = points.select((F.col("t") - 1).alias("t"), F.lit(1).alias("late"), "span", F.lit(0).alias("a")).unionByName(points.select((F.col("t") + width).alias("t"), F.lit(1).alias("late"), "span", F.lit(0).alias("a")).withColumn("late", F.lit(2)))
    line = asked.unionByName(numbered.select("t", F.lit(0).alias("late"), F.lit(None).cast("bigint").alias("span"), F.lit(1).alias("a")))
    counted = Ordered(line.withColumn("all", F.lit(0)), ["all"], ["t", "late", "span"], scratch).running("a", "upto").rows.where("late > 0")
    sides = counted.groupBy("span").agg(F.max(F.when(F.col("late") == 1, F.col("upto"))).alias("before"), F.max(F.when(F.col("late") == 2, F.col("upto"))).alias("within"))
    last = F.least(F.coalesce("until", "within"), F.col("within"))
    return points.join(sides, "span").agg(F.coalesce(F.sum(F.greatest(last - F.greatest("n", "before"), F.lit(0))), F.lit(0)).cast("bigint").alias("time_pairs"))


def extended_master(master: DataFrame, assigned: DataFrame) -> DataFrame:
    """Train events and new ones, with the articles each split brought."""
    v = assigned.groupBy("event_id").agg(F.count("*").alias("validation_article_count"), F.max("published_time").alias("vl"), F.min("published_time").alias("vs"), F.min_by("article_id", F.struct("published_time", "article_id")).alias("vf"))
    return master.join(v, "event_id", "full_outer").select(
        "event_id",
        F.coalesce("event_origin_split", F.lit("validation")).alias("event_origin_split"),
        F.coalesce("event_start_time", "vs").alias("event_start_time"),
        F.greatest(F.coalesce("event_last_added_time", "vl"), F.coalesce("vl", "event_last_added_time")).alias("event_last_added_time"),
        (F.coalesce("event_article_count", F.lit(0)) + F.coalesce("validation_article_count", F.lit(0))).alias("event_article_count"),
        F.coalesce("train_article_count", F.lit(0)).alias("train_article_count"),
        F.coalesce("validation_article_count", F.lit(0)).alias("validation_article_count"),
        F.coalesce("first_article_id", "vf").alias("first_article_id"),
    )
