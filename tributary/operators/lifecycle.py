"""Contributor lifecycles: core sets, windows of joining and leaving, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.hotjoin import join_hot
from tributary.functions.prefix import prefix_sum
from tributary.session import materialise

DAY = 86_400


def core_contributors(counts: DataFrame, project: str, contributor: str, commits: str, is_bot: Column, share: float = 0.8, least: float = 0.05) -> DataFrame:
    """The contributors that, in descending order of commits, make up ``share`` of a project's commits.

    Those below ``least`` of the commits are left out, bots neither counted nor kept. Ties go to the smaller name.
    ``counts`` has one row per project and contributor. The running sums come from a range sort over project and rank, so a
    project with most contributors spreads over many tasks.
    """
    c = counts.withColumn("__neg", -F.col(commits)).withColumn("__own", F.when(is_bot, 0).otherwise(F.col(commits)))
    run = prefix_sum(c, [project], ["__neg", contributor], "__own", "__upto")
    total = materialise(counts.groupBy(project).agg(F.sum(commits).alias("__total"), F.count("*").alias("__n")), "totals", all=F.sum("__n"), top=F.max("__n"))
    ranked = join_hot(run, total, project, "__n", total.measured["all"] or 0, total.measured["top"] or 0)
    keep = ~is_bot & (F.col("__upto") - F.col("__own") < share * F.col("__total")) & (F.col(commits) >= least * F.col("__total"))
    return ranked.where(keep).select(counts.columns)


def join_leave_by_month(active: DataFrame, project: str, author: str, month: str, width: int = 3) -> DataFrame:
    """(project, avg_join_rate, avg_leave_rate) over windows of ``width`` months sliding by one.

    ``active`` has a row per project, author and month number with activity. A(w) are the authors active in the window that
    ends with month w, P(w) those of the window before it without overlap (empty for the first windows).
    Join rate |A - P| / |A|, leave rate |P - A| / |P|, averaged over windows where defined. Rows with nulls are ignored.
    """
    a = active.select(F.col(project).alias("p"), F.col(author).alias("a"), F.col(month).cast("int").alias("m")).dropna().distinct()
    span = a.groupBy("p").agg((F.min("m") + width - 1).alias("lo"), F.max("m").alias("hi"))
    # a month belongs to the windows that end up to width - 1 months later, and is the past of those after them
    near = F.transform(F.sequence(F.lit(0), F.lit(2 * width - 1)), lambda o: F.struct((F.col("m") + o).alias("w"), (o < width).cast("int").alias("cur"), (o >= width).cast("int").alias("old")))
    inside = lambda x: (x["w"] <= F.col("hi")) & (x["w"] - x["old"] * width >= F.col("lo"))
    seen = a.join(span, "p").select("p", "a", F.explode(F.filter(near, inside)).alias("x"))
    per = seen.groupBy("p", "x.w", "a").agg(F.max("x.cur").alias("cur"), F.max("x.old").alias("old"))
    win = per.groupBy("p", "w").agg(
        F.sum("cur").alias("na"), F.sum("old").alias("np"), F.sum(F.col("cur") * (1 - F.col("old"))).alias("joined"), F.sum(F.col("old") * (1 - F.col("cur"))).alias("left")
    )
    return win.groupBy(F.col("p").alias(project)).agg(
        F.avg(F.when(F.col("na") > 0, F.col("joined") / F.nullif("na", F.lit(0)))).alias("avg_join_rate"), F.avg(F.when(F.col("np") > 0, F.col("left") / F.nullif("np", F.lit(0)))).alias("avg_leave_rate")
    )


def stages(commits: DataFrame, project: str, ts: str, years: tuple[int, int, int] = (7, 10, 13), days_per_year: float = 365.0) -> DataFrame:
    """Commits with ``stage``: early, middle or late by calendar years from the project's first commit.

    A project takes part in a stage only when it lived to the stage's end (whole days over ``days_per_year``); projects
    shorter than the first stage and commits beyond the last are dropped. Month ends are clamped, 29 February becomes the 28th.
    """
    life = commits.groupBy(F.col(project).alias("__p")).agg(F.min(ts).alias("__start"), F.max(ts).alias("__end"))
    secs = F.unix_timestamp(F.col("__end").cast("timestamp")) - F.unix_timestamp(F.col("__start").cast("timestamp"))
    life = life.withColumn("__years", F.floor(secs / 86400) / days_per_year).where(F.col("__years") >= years[0])
    c = commits.join(life, commits[project] == life["__p"])
    cut = [F.col("__start") + F.make_ym_interval(F.lit(y)) for y in years]
    stage = (
        F.when(F.col(ts) < cut[0], "early")
        .when((F.col("__years") >= years[1]) & (F.col(ts) < cut[1]), "middle")
        .when((F.col("__years") >= years[2]) & (F.col(ts) >= cut[1]) & (F.col(ts) < cut[2]), "late")
    )
    return c.withColumn("stage", stage).where("stage IS NOT NULL").drop("__p", "__start", "__end", "__years")


def lifespan_bounds(life: DataFrame, project: str, days: str) -> DataFrame:
    """(grp, n, lo, hi, bound): four groups of projects by whole days of life, the remainder in the last.

    ``bound`` is the midpoint, in years of 365 days with three digits, between a group's longest and the next one's shortest life.
    The ranks come from a range sort of the projects.
    """
    one = life.select(project, days).withColumns({"__one": F.lit(1), "__all": F.lit(0)})
    r = prefix_sum(one, ["__all"], [days, project], "__one", "__upto").withColumn("__n", one.agg(F.count("*")).scalar())
    grp = (F.least(F.floor((F.col("__upto") - 1) / F.greatest(F.floor(F.col("__n") / 4), F.lit(1))), F.lit(3)) + 1).cast("long")
    q = r.groupBy(grp.alias("grp")).agg(F.count("*").alias("n"), F.min(days).alias("lo"), F.max(days).alias("hi"))
    nxt = F.coalesce(F.lead("lo").over(Window.orderBy("grp")), F.col("hi"))  # four rows
    return q.select("grp", "n", "lo", "hi", F.round((F.col("hi") / 365 + nxt / 365) / 2, 3).alias("bound"))


def stage_spans(life: DataFrame, stages: list[tuple[str, float, float]], width: float, start: str = "start", end: str = "end") -> DataFrame:
    """``life`` with a row for each stage (name, from, to in years after ``start``) that the project lived to see the end of.

    ``origin`` is the second the stage begins, ``windows`` how many whole windows of ``width`` years it has.
    """
    s = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(float(a)).alias("a"), F.lit(float(z)).alias("z")) for n, a, z in stages])
    x = life.select("*", F.explode(s).alias("__s"))
    x = x.where(F.col(start) + F.col("__s.z") * 365 * DAY <= F.col(end))
    k = F.floor((F.col("__s.z") - F.col("__s.a")) * 365 / F.lit(width * 365)).cast("int")
    return x.withColumns({"stage": F.col("__s.stage"), "origin": F.col(start) + F.col("__s.a") * 365 * DAY, "windows": k}).drop("__s")


def stage_windows(people: DataFrame, spans: DataFrame, project: str, first: str, last: str, width: float, as_of: float, buffer_days: int = 150) -> DataFrame:
    """The columns of ``spans`` with w, joins, leaves, active, join_rate, leave_rate, ratio and difference of every window of every stage.

    ``people`` has a row per project and person with the seconds of first and last contribution. Joins and leaves lie strictly inside a window;
    who contributed within ``buffer_days`` of ``as_of`` has not left and counts as active up to it. Without anyone active the rates are
    the counts, without leaves the ratio is the joins. Activity comes from starts and ends of stretches of windows, not from a join of windows and people.
    """
    size = F.lit(width * 365 * DAY)
    near = F.lit(float(as_of - buffer_days * DAY))
    s = spans.select(F.col(project).alias("__p"), "stage", "origin", "windows")
    x = people.join(s, people[project] == F.col("__p")).select("__p", "stage", "windows", ((F.col(first) - F.col("origin")) / size).alias("f"), ((F.col(last) - F.col("origin")) / size).alias("l"),
        ((F.when(F.col(last) > near, F.lit(float(as_of))).otherwise(F.col(last)) - F.col("origin")) / size).alias("until"), (F.col(last) < near).alias("gone"))
    inside = lambda c: (F.col(c) != F.floor(c)) & (F.col(c) > 0) & (F.col(c) < F.col("windows"))
    a = F.greatest(F.floor("f"), F.lit(0)).cast("int")
    z = F.least(F.ceil("until") - 1, F.col("windows") - 1).cast("int")
    mark = lambda w, on, **n: F.when(on, F.struct(w.cast("int").alias("w"), *[F.lit(n.get(c, 0)).alias(c) for c in ("j", "l", "d")]))
    ev = x.select("__p", "stage", F.explode(F.filter(F.array(mark(F.floor("f"), inside("f"), j=1), mark(F.floor("l"), inside("l") & F.col("gone"), l=1), mark(a, a <= z, d=1), mark(z + 1, a <= z, d=-1)), lambda m: m.isNotNull())).alias("m"))
    per = ev.groupBy("__p", "stage", "m.w").agg(F.sum("m.j").alias("joins"), F.sum("m.l").alias("leaves"), F.sum("m.d").alias("d"))
    axis = spans.where("windows > 0").withColumn("w", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    per = per.withColumnsRenamed({"stage": "__stage", "w": "__w"})
    g = axis.join(per, (axis[project] == per["__p"]) & (axis["stage"] == per["__stage"]) & (axis["w"] == per["__w"]), "left").drop("__p", "__stage", "__w").na.fill(0, ["joins", "leaves", "d"])
    upto = Window.partitionBy(project, "stage").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as windows
    g = g.withColumn("active", F.sum("d").over(upto)).drop("d")
    some = F.greatest(F.col("active"), F.lit(1))
    return g.withColumns({
        "join_rate": F.col("joins") / some, "leave_rate": F.col("leaves") / some, "ratio": F.col("joins") / F.greatest(F.col("leaves"), F.lit(1)), "difference": F.col("joins") - F.col("leaves"),
    })


def shifted(windows: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """``windows`` laid end to end: ``place`` is the window's number after those of all earlier stages, within ``by``; a group that
    misses a stage is left out."""
    size = windows.groupBy(*by, "stage").agg((F.max("w") + 1).alias("k"))
    wide = size.groupBy(*by).pivot("stage", stages).agg(F.max("k")).dropna(subset=stages)
    before = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), sum((F.col(t) for t in stages[:i]), F.lit(0)))])
    return windows.join(wide, by).withColumn("place", F.col("w") + before[F.col("stage")]).drop(*stages)


def quadrant(join: Column, leave: Column, join_median: Column, leave_median: Column) -> Column:
    """Attractive, Stable, Unstable or Unattractive by the medians of join and leave rate."""
    low = leave < leave_median
    return F.when(low & (join >= join_median), "Attractive").when(low, "Stable").when(join >= join_median, "Unstable").otherwise("Unattractive")
