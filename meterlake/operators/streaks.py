"""Activity runs: calendar streaks, gap-tolerant streaks, and growth points, all as windows over a member's days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import add_business_days, rest_day, week
from ..functions.semantics import half_up

# Ladders of daily tokens and requests, bonus by step, multipliers by streak, stages.
TOKEN_STEPS = (50_000, 200_000, 1_000_000, 4_000_000, 15_000_000)
REQUEST_STEPS = (10, 50, 250, 850, 2000)
STEP_BONUS = (0, 0, 1, 2, 3, 4)
MULTIPLIERS = ((60, 2.5), (30, 2.0), (14, 1.8), (7, 1.5), (3, 1.2))
STAGES = (0, 100, 400, 1000, 2200, 4500)
DAY_CAP = 5
ACHIEVED = (3, 7, 14, 30)


def calendar_streaks(days: DataFrame, as_of: str) -> DataFrame:
    """``member_id, date`` of active days to ``best, current, last_date`` and which lengths were ever reached."""
    island = Window.partitionBy("member_id").orderBy("date")
    d = days.select("member_id", F.to_date("date").alias("date")).distinct()
    runs = d.withColumn("island", F.date_sub("date", F.row_number().over(island))).groupBy("member_id", "island").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last"))
    alive = F.col("last") >= F.date_sub(F.lit(as_of).cast("date"), 1)
    out = runs.groupBy("member_id").agg(F.max("n").alias("best"), F.coalesce(F.max(F.when(alive, F.col("n"))), F.lit(0)).alias("current"), F.date_format(F.max("last"), "yyyy-MM-dd").alias("last_date"))
    return out.withColumn("achievements", F.array_join(F.transform(F.filter(F.array(*map(F.lit, ACHIEVED)), lambda a: a <= F.col("best")), lambda a: a.cast("string")), ","))


def tolerant_streaks(days: DataFrame, last: str, skipped: Column | None = None) -> DataFrame:
    """Streak at every day from a member's first active one to ``last``: a missed day within any seven is forgiven.

    Two misses less than seven days apart end the run between them: the later one
    sets a barrier just behind the earlier. A streak is the active days since the
    last barrier.
    """
    d = days.select("member_id", F.to_date("date").alias("date")).distinct()
    first = d.groupBy("member_id").agg(F.min("date").alias("first"))
    spine = first.select("member_id", F.explode(F.sequence("first", F.lit(last).cast("date"))).alias("date"))
    s = spine.join(d.withColumn("active", F.lit(1)), ["member_id", "date"], "left").na.fill(0, ["active"])
    missed = (F.col("active") == 0) & (~skipped if skipped is not None else F.lit(True))
    along = Window.partitionBy("member_id").orderBy("date")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("total", F.sum("active").over(so_far)).withColumn("miss", F.when(missed, F.col("date")))
    prev = F.last("miss", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    near = F.col("miss").isNotNull() & (F.datediff("miss", prev) <= 6)
    at_prev = F.last(F.when(F.col("miss").isNotNull(), F.col("total")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("barrier", F.when(near, at_prev))
    return s.withColumn("streak", F.col("total") - F.coalesce(F.max("barrier").over(so_far), F.lit(0))).select("member_id", "date", "active", "streak")


def ladder(x: Column, steps: tuple[int, ...]) -> Column:
    return sum((F.when(x >= s, 1).otherwise(0) for s in steps), F.lit(0))


def day_bonus(tokens: Column, requests: Column, families: Column) -> Column:
    step = F.greatest(ladder(tokens, TOKEN_STEPS), ladder(requests, REQUEST_STEPS))
    volume = F.element_at(F.array(*map(F.lit, STEP_BONUS)), step + 1)
    return F.least(F.lit(DAY_CAP), volume + F.least(F.lit(2), F.greatest(F.lit(0), families - 1)))


def multiplier(streak: Column) -> Column:
    out = F.lit(1.0)
    for least, m in reversed(MULTIPLIERS):
        out = F.when(streak >= least, m).otherwise(out)
    return out


def day_points(streak: Column, bonus: Column) -> Column:
    return half_up(10 * multiplier(streak)) + bonus


def level(points: Column) -> Column:
    """The level whose threshold 10 (L-1)^2 the points have reached, exact at the thresholds."""
    guess = F.floor(F.sqrt(points / 10.0)) + 1
    return F.when(guess * guess * 10 <= points, guess + 1).when((guess - 1) * (guess - 1) * 10 > points, guess - 1).otherwise(guess)


def stage(points: Column) -> Column:
    return ladder(points, STAGES)


# What milestones and ornaments take, by axis.
MILESTONES = {"streak": (3, 7, 14, 30, 60), "active_days": (10, 30, 100, 200, 365), "efficiency": (7, 30), "tools": (2, 3, 4)}
ORNAMENTS = {"streak": (3, 7, 14, 30, 60, 100), "recent_days": (10, 15, 20, 25, 30), "recent_bonus": (5, 10, 15, 25), "recent_tools": (2, 3, 4, 5, 6)}
RECENT = 30
GRACE, TOKENS_KEPT, TOKEN_DAYS, COMEBACK = 2, 2, 5, 5


def _dates(dates: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, dates)).cast("array<date>")


def _bonus() -> Column:
    return day_bonus(F.col("tokens"), F.col("requests"), F.col("families"))


def _recent_since(last: str, unconfirmed: tuple[str, ...]) -> str:
    """First of the last RECENT days that aren't unconfirmed."""
    at, left = dt.date.fromisoformat(last), RECENT
    while left:
        left -= at.isoformat() not in unconfirmed
        at -= dt.timedelta(bool(left))
    return at.isoformat()


def milestones(counts: dict[str, Column]) -> tuple[Column, Column]:
    """Keys of what is reached, and the axis and distance of what is nearest."""
    reached = [F.when(counts[a] >= n, f"{a}_{n}") for a, steps in MILESTONES.items() for n in steps]
    left = [F.struct(F.lit(a).alias("axis"), (F.when(ladder(counts[a], steps) < len(steps), F.element_at(F.array(*map(F.lit, steps)), F.least(ladder(counts[a], steps) + 1, F.lit(len(steps))))) - counts[a]).cast("long").alias("remaining")) for a, steps in MILESTONES.items()]
    nearer = lambda best, x: F.when(x["remaining"].isNotNull() & (best["remaining"].isNull() | (x["remaining"] < best["remaining"])), x).otherwise(best)
    none = F.struct(F.lit(None).cast("string").alias("axis"), F.lit(None).cast("long").alias("remaining"))
    return F.array_compact(F.array(*reached)), F.aggregate(F.array(*left), none, nearer)


def ornaments(counts: dict[str, Column]) -> Column:
    """Of every axis the highest step reached."""
    top = []
    for axis, steps in ORNAMENTS.items():
        best = F.lit(None).cast("string")
        for n in steps:
            best = F.when(counts[axis] >= n, f"{axis}_{n}").otherwise(best)
        top.append(best)
    return F.array_compact(F.array(*top))


def growth(days: DataFrame, last: str, heal: bool = False, *, unconfirmed: tuple[str, ...] = (), holidays: tuple[str, ...] = ()) -> DataFrame:
    """Days ``member_id, date, tokens, requests, families, tools`` to each member's state on the last day.

    With ``heal``, gaps that a comeback or a token mends count as no break, and a
    gap that can still be mended shows as ``ember``. Days in ``unconfirmed`` may
    yet get data: they are neither active nor missed nor idle. ``tool_names``, an
    array, makes tools of different days count once; without it the largest day counts.
    """
    days = days if "tool_names" in days.columns else days.withColumn("tool_names", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("tools").cast("int"))), lambda i: i.cast("string")))
    active = days.select("member_id", "date")
    gaps = revivals(days, last, unconfirmed=unconfirmed, holidays=holidays) if heal else None
    if heal:
        active = active.unionByName(healed_days(gaps))
    s = tolerant_streaks(active, last, F.array_contains(_dates(unconfirmed), F.col("date")) if unconfirmed else None).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    since, closed = _recent_since(last, unconfirmed), F.col("date").isin(*unconfirmed) if unconfirmed else F.lit(False)
    facts = days.select("member_id", "date", "tool_names", _bonus().alias("bonus"), ((F.col("date") >= since) & ~closed).alias("recent"))
    s = s.join(facts, ["member_id", "date"], "left")
    worked = F.col("bonus").isNotNull()
    points = F.when(worked, day_points(F.col("streak"), F.col("bonus"))).otherwise(0)
    of = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(c, F.col("tool_names"))))))
    out = s.groupBy("member_id").agg(
        F.sum(points).cast("long").alias("gp"),
        F.count("bonus").alias("active_days"),
        F.max(F.when(worked, F.col("streak"))).cast("long").alias("best_streak"),
        F.max_by("streak", "date").cast("long").alias("streak_days"),
        F.max(F.when(worked, F.col("date"))).alias("last_date"),
        F.max_by(F.when(worked, F.col("bonus")), F.when(worked, F.col("date"))).cast("long").alias("bonus_today"),
        F.count_if(F.col("bonus") >= 3).alias("high_days"),
        of(worked).alias("tool_count"),
        F.count_if("recent").alias("recent_days"),
        F.count_if(F.col("recent") & (F.col("bonus") >= 3)).alias("recent_bonus"),
        of(worked & F.col("recent")).alias("recent_tools"),
    )
    none = F.lit(0)
    if heal:
        out = out.join(gaps.groupBy("member_id").agg(F.sum("extra").alias("extra"), F.count_if(F.col("how") == "token").alias("spent")), "member_id", "left")
        out = out.withColumn("gp", F.col("gp") + F.coalesce("extra", none)).join(embers(gaps, s, last, unconfirmed, holidays), "member_id", "left")
    else:
        out = out.withColumn("spent", none).withColumn("ember", F.lit(None).cast(EMBER))
    idle = F.datediff(F.lit(last).cast("date"), F.to_date("last_date")) - F.size(F.filter(_dates(unconfirmed), lambda x: (x > F.to_date("last_date")) & (x <= F.lit(last).cast("date"))))
    lvl, at = level(F.col("gp")), stage(F.col("gp"))
    counts = {"streak": F.col("best_streak"), "active_days": F.col("active_days"), "efficiency": F.col("high_days"), "tools": F.col("tool_count")}
    reached, nearest = milestones(counts)
    shown = ornaments({"streak": F.col("streak_days"), "recent_days": F.col("recent_days"), "recent_bonus": F.col("recent_bonus"), "recent_tools": F.col("recent_tools")})
    return out.select(
        "member_id", "gp", lvl.cast("long").alias("level"), at.cast("long").alias("stage"), (10 * lvl * lvl - F.col("gp")).cast("long").alias("to_next_level"),
        (F.when(at < len(STAGES), F.element_at(F.array(*map(F.lit, STAGES)), F.least(at + 1, F.lit(len(STAGES))))) - F.col("gp")).cast("long").alias("to_next_stage"),
        "active_days", "best_streak", "streak_days", multiplier(F.col("streak_days")).alias("multiplier"), "bonus_today",
        F.greatest(none, idle).cast("long").alias("idle_days"), F.when(idle <= 0, "lively").when(idle >= 3, "dozing").otherwise("neutral").alias("vitality"),
        reached.alias("milestones"), nearest.alias("next_milestone"), shown.alias("ornaments"), "ember",
        F.greatest(none, F.least(F.lit(TOKENS_KEPT), F.floor(F.col("high_days") / TOKEN_DAYS) - F.coalesce("spent", none))).cast("long").alias("restore_tokens"),
    )


REVIVED = "array<struct<since:date,until:date,broken:date,grace:date,needed:int,have:int,how:string,extra:int>>"
EMBER = "struct<length:long,break_date:date,grace_ends:date,kind:string,needed:int,have:int>"


def _grace(day: Column, holidays: tuple[str, ...]) -> Column:
    """The day until which a break can be mended: the second business day after it."""
    return F.to_date(add_business_days(day, GRACE, F.array(*map(F.lit, holidays)).cast("array<string>")))


def _missed(first: Column, last: Column, unconfirmed: tuple[str, ...]) -> Column:
    every = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    return F.filter(every, lambda x: ~F.array_contains(_dates(unconfirmed), x)) if unconfirmed else every


def _needed(missed: Column, holidays: tuple[str, ...]) -> Column:
    days_off = F.array(*map(F.lit, holidays)).cast("array<string>")
    return F.when(F.forall(missed, lambda x: rest_day(F.date_format(x, "yyyy-MM-dd"), days_off)), 1).otherwise(2)


def _gaps(days: DataFrame, unconfirmed: tuple[str, ...], holidays: tuple[str, ...]) -> DataFrame:
    """Per member the gaps of two or more missed days, with what speaks for mending them.

    A gap heals if, from the return to two business days after it, enough days are
    strong (20 requests or step 2): one if it held only rest days, else two. Failing
    that a token is spent, one earned by five days of bonus 3 before, two kept at most.
    """
    step = F.greatest(ladder(F.col("tokens"), TOKEN_STEPS), ladder(F.col("requests"), REQUEST_STEPS))
    high = _bonus() >= 3
    d = days.select("member_id", F.to_date("date").alias("date"), high.alias("high"), ((F.col("requests") >= 20) | (step >= 2)).alias("strong"), (high | (F.col("tools") >= 2)).alias("rich"))
    along = Window.partitionBy("member_id").orderBy("date")
    ahead = F.collect_list(F.struct("date", "strong", "rich")).over(Window.partitionBy("member_id").orderBy(F.unix_date("date")).rangeBetween(0, 13 + len(holidays)))
    d = d.select("*", F.lag("date").over(along).alias("prev"), F.sum(F.col("high").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("high_before"), ahead.alias("ahead"))
    g = d.where(F.datediff("date", "prev") >= 3).withColumn("missed", _missed(F.date_add("prev", 1), F.date_sub("date", 1), unconfirmed)).where(F.size("missed") >= 2)
    g = g.withColumn("broken", F.element_at("missed", -1)).withColumn("grace", _grace(F.date_format("broken", "yyyy-MM-dd"), holidays))
    inside = F.filter("ahead", lambda x: (x["date"] <= F.col("grace")) & x["strong"])
    return g.select("member_id", F.col("prev").alias("since"), F.col("date").alias("until"), "broken", "grace", _needed(F.col("missed"), holidays).alias("needed"), F.size(inside).alias("have"), F.exists(inside, lambda x: x["rich"]).alias("rich"), F.coalesce("high_before", F.lit(0)).alias("high_before"))


def revivals(days: DataFrame, last: str, *, unconfirmed: tuple[str, ...] = (), holidays: tuple[str, ...] = ()) -> DataFrame:
    """``member_id, since, until, broken, grace, needed, have, how, extra`` of every gap: healed, token or lost; extra points of rich comebacks."""
    item = F.struct("since", "until", "broken", "grace", "needed", "have", "rich", "high_before")
    g = _gaps(days, unconfirmed, holidays).groupBy("member_id").agg(F.sort_array(F.collect_list(item)).alias("gaps"))
    zero = F.struct(F.lit(0).alias("used"), F.array().cast(REVIVED).alias("out"))

    def fold(s: Column, x: Column) -> Column:
        balance = F.least(F.lit(TOKENS_KEPT), F.floor(x["high_before"] / TOKEN_DAYS).cast("int") - s["used"])
        earned = x["have"] >= x["needed"]
        how = F.when(earned, "healed").when(balance > 0, "token").otherwise("lost")
        row = F.struct(*[x[c].alias(c) for c in ("since", "until", "broken", "grace", "needed", "have")], how.alias("how"), F.when(earned & x["rich"], COMEBACK).otherwise(0).alias("extra"))
        return F.struct((s["used"] + F.when(how == "token", 1).otherwise(0)).alias("used"), F.concat(s["out"], F.array(row)).alias("out"))

    return g.select("member_id", F.explode(F.aggregate("gaps", zero, fold)["out"]).alias("x")).select("member_id", "x.*")


def healed_days(gaps: DataFrame) -> DataFrame:
    """``member_id, date`` of the missed days of mended gaps."""
    h = gaps.where("how != 'lost'")
    return h.select("member_id", F.explode(F.sequence(F.date_add("since", 1), F.date_sub("until", 1))).alias("d")).select("member_id", F.date_format("d", "yyyy-MM-dd").alias("date"))


def embers(gaps: DataFrame, streaks: DataFrame, last: str, unconfirmed: tuple[str, ...], holidays: tuple[str, ...]) -> DataFrame:
    """``member_id, ember`` of breaks that can still be mended: a lost gap in its grace, or the days since the last active one."""
    today = F.lit(last).cast("date")
    kind = F.when(F.col("needed") == 1, "bridge").otherwise("quest").alias("kind")
    lost = gaps.where((F.col("how") == "lost") & (F.col("grace") >= today))
    own = [F.col("broken").alias("break_date"), F.col("grace").alias("grace_ends"), kind, F.col("needed"), F.col("have")]
    lost = lost.select("member_id", F.date_format("since", "yyyy-MM-dd").alias("date"), *own)
    end = streaks.where("bonus IS NOT NULL").groupBy("member_id").agg(F.max("date").alias("date")).withColumn("missed", _missed(F.date_add(F.to_date("date"), 1), today, unconfirmed)).where(F.size("missed") >= 2)
    end = end.withColumn("grace", _grace(F.date_format(F.element_at("missed", 2), "yyyy-MM-dd"), holidays)).where(F.col("grace") >= today)
    end = end.withColumn("broken", F.element_at("missed", -1)).withColumn("needed", _needed(F.col("missed"), holidays)).withColumn("have", F.lit(0)).select("member_id", "date", *own)
    both = lost.unionByName(end).join(streaks.select("member_id", "date", "streak"), ["member_id", "date"])
    row = F.struct(F.col("streak").cast("long").alias("length"), "break_date", "grace_ends", "kind", "needed", "have")
    return both.groupBy("member_id").agg(F.max_by(row, "date").alias("ember"))


def team_axes(members: DataFrame, days: DataFrame, first: str, today: str, unconfirmed: tuple[str, ...] = ()) -> DataFrame:
    """Weekly medians over ``member_id`` rows: active days, volume step, and families; from the week of ``first`` to that of ``today``.

    ``days`` holds ``member_id, date, tokens, requests, family_names`` of active
    days. Days after today or unconfirmed aren't counted; a week without a counted
    day has no medians. Members without a day count as 0 days, and in nothing else.
    """
    start, end = (dt.date.fromisoformat(x) for x in (first, today))
    monday, counted = start - dt.timedelta(start.weekday()), {}
    while monday <= end:
        own = [(monday + dt.timedelta(i)).isoformat() for i in range(7)]
        counted[monday.isoformat()] = [x for x in own if x <= today and x not in unconfirmed]
        monday += dt.timedelta(7)
    weeks = F.explode(F.array(*[F.struct(F.lit(w).alias("week"), F.lit(len(x)).cast("long").alias("counted_days")) for w, x in counted.items()])).alias("w")
    cells = members.select("member_id", weeks).select("member_id", "w.*")
    step = F.greatest(ladder(F.coalesce("tokens", F.lit(0)), TOKEN_STEPS), ladder(F.coalesce("requests", F.lit(0)), REQUEST_STEPS))
    d = days.where((F.col("date") >= min(counted)) & (F.col("date") <= today) & (~F.col("date").isin(*unconfirmed) if unconfirmed else F.lit(True)))
    per = d.groupBy("member_id", week(F.col("date")).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.percentile(step, F.lit(0.5)).alias("v"), F.size(F.array_distinct(F.flatten(F.collect_list("family_names")))).alias("f"))
    p = cells.join(per, ["member_id", "week"], "left")
    mid = lambda c: F.round(F.when(F.col("counted_days") > 0, F.percentile(c, F.lit(0.5))), 6)
    out = p.groupBy("week", "counted_days").agg(F.count(F.lit(1)).alias("members"), F.count("n").alias("active_members"), mid(F.coalesce("n", F.lit(0))).alias("frequency"), mid("v").alias("volume"), mid("f").alias("diversity"))
    return out.withColumn("complete", F.col("counted_days") == 7)


def latest_complete(weeks: DataFrame) -> DataFrame:
    """Of weekly rows the latest complete one and the complete one before, ``latest`` telling them apart; a row for each week."""
    place = F.row_number().over(Window.orderBy(F.desc("week")))
    return weeks.where("complete").withColumn("place", place).where("place <= 2").withColumn("latest", F.col("place") == 1).drop("place")
