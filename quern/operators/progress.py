"""Scores, schedules, streaks and merges over logs of answers and study runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days to the next revision, days of the mistake ladder, marks.
REVISION_DAYS = (3, 7, 21, 60, 120)
LADDER_DAYS = (1, 3, 7, 21, 60)
MARKS = {"gs1": ("2", "-0.66"), "gs2": ("2.5", "-0.83")}
KEPT_STAMPS, KEPT_RUNS, HISTORY_DAYS, PAPER_MINUTES = 12, 60, 14, 120


def due_in(ticked: Column, subtopics: Column, revised: Column, today: Column) -> Column:
    """Days until a topic is due: null unless all of it is ticked, 0 if it was never revised."""
    n = F.coalesce(F.size(revised), F.lit(0))
    steps = F.array(*[F.lit(d) for d in REVISION_DAYS])
    due = F.date_add(F.array_max(revised).cast("date"), F.try_element_at(steps, F.greatest(F.least(n, F.lit(len(REVISION_DAYS))), F.lit(1))))
    return F.when(F.coalesce(F.size(F.array_distinct(ticked)), F.lit(0)) < subtopics, F.lit(None)).when(n <= 0, F.lit(0)).otherwise(F.datediff(due, today))


def merged_ticks(a: Column, b: Column) -> Column:
    """The union, sorted."""
    empty = F.expr("cast(array() as array<int>)")
    return F.sort_array(F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty))))


def merged_stamps(a: Column, b: Column, keep: int = KEPT_STAMPS) -> Column:
    """The union's last ``keep``, ascending."""
    u = F.sort_array(F.array_distinct(F.concat(a, b)))
    return F.slice(u, F.greatest(F.lit(1), F.size(u) - keep + 1), F.lit(keep))


def merged_picks(local: Column, backup: Column) -> Column:
    """C4: local entries win, the backup fills gaps."""
    return F.map_zip_with(local, backup, lambda _, a, b: F.coalesce(a, b))


def is_right(cell: Column, choice: Column) -> Column:
    """Is the chosen letter among those the cell accepts?"""
    return F.instr(cell, choice) > 0


def scored(answers: DataFrame, *, group: list[str], code: str = "code", cell: str = "cell", choice: str = "choice") -> DataFrame:
    """Right, wrong, blank, dropped and marks (two decimals) for each sheet; ``qualifies`` at a third of what was to be had."""
    right_of = F.create_map(*[F.lit(x) for c, (r, _) in MARKS.items() for x in (c, r)])
    wrong_of = F.create_map(*[F.lit(x) for c, (_, w) in MARKS.items() for x in (c, w)])
    live = F.col(cell) != "X"
    answered = F.col(choice).isNotNull()
    good = live & answered & is_right(F.col(cell), F.col(choice))
    bad = live & answered & ~is_right(F.col(cell), F.col(choice))
    up, down = F.try_element_at(right_of, F.col(code)).cast("decimal(7,2)"), F.try_element_at(wrong_of, F.col(code)).cast("decimal(7,2)")
    zero = F.lit("0").cast("decimal(7,2)")
    out = answers.groupBy(*group).agg(
        F.count_if(good).alias("right"), F.count_if(bad).alias("wrong"), F.count_if(live & ~answered).alias("blank"), F.count_if(~live).alias("dropped"),
        F.sum(F.when(good, up).when(bad, down).otherwise(zero)).alias("marks"), F.sum(F.when(live, up).otherwise(zero)).alias("_most"),
    )
    return out.withColumn("qualifies", F.col("marks") * 3 >= F.col("_most")).drop("_most")


def states(questions: DataFrame, answers: DataFrame, seen: DataFrame, keys: list[str], *, cell: str = "cell") -> DataFrame:
    """Dropped, else answered, else seen, else untouched."""
    j = questions.join(answers.select(*keys, F.lit(True).alias("_a")).distinct(), keys, "left").join(seen.select(*keys, F.lit(True).alias("_s")).distinct(), keys, "left")
    return j.withColumn("state", F.when(F.col(cell) == "X", "dropped").when(F.col("_a"), "answered").when(F.col("_s"), "seen").otherwise("untouched")).drop("_a", "_s")


def sheet(answers: DataFrame, *keys: str) -> DataFrame:
    """An answer sheet by paper and set: number to the last choice."""
    last = answers.groupBy(*keys, "n").agg(F.max_by("choice", "seq").alias("choice")).filter("choice is not null")
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "choice")))).alias("sheet"))


def retaken(answers: DataFrame, how: str, *, cell: str = "cell", choice: str = "choice") -> DataFrame:
    """What a retake starts from: right answers only for "mistakes", none for "all"."""
    return answers.filter(is_right(F.col(cell), F.col(choice)) & (F.col(cell) != "X")) if how == "mistakes" else answers.limit(0)


def dense_days(runs: DataFrame, user: str, first: Column, last: Column, *, day: str = "day", minutes: str = "mins", kind: str = "kind") -> DataFrame:
    """C11: a row for each user and day from ``first`` to ``last``: minutes of runs that were done, and how many were voided."""
    span = runs.select(user).distinct().select(user, F.explode(F.sequence(first, last)).alias(day))
    daily = runs.groupBy(user, day).agg(F.sum(F.when(F.col(kind) == "done", F.col(minutes)).otherwise(0)).alias("minutes"), F.count_if(F.col(kind) != "done").alias("voided"))
    return span.join(daily, [user, day], "left").na.fill(0, ["minutes", "voided"])


def goal_streaks(days: DataFrame, user: str, today: Column, goal: int, *, day: str = "day", minutes: str = "minutes") -> DataFrame:
    """Consecutive days of at least ``goal`` minutes that end yesterday, and today if it is met too."""
    met = days.filter(F.col(minutes) >= goal).select(user, day).distinct()
    past = met.filter(F.col(day) < today)
    run = F.date_add(F.col(day), F.row_number().over(Window.partitionBy(user).orderBy(F.col(day).desc())).cast("int"))
    streak = past.filter(F.col(day).isNotNull()).withColumn("_end", run).filter(F.col("_end") == today).groupBy(user).agg(F.count("*").alias("_past"))
    now = met.filter(F.col(day) == today).select(user, F.lit(1).alias("_now"))
    users = days.select(user).distinct()
    return users.join(streak, user, "left").join(now, user, "left").select(user, (F.coalesce("_past", F.lit(0)) + F.coalesce("_now", F.lit(0))).alias("streak"))


def recent_runs(runs: DataFrame, user: str, *order: Column, keep: int = KEPT_RUNS) -> DataFrame:
    """The last ``keep`` runs of each user; daily totals are kept elsewhere and outlive them."""
    return runs.withColumn("_place", F.row_number().over(Window.partitionBy(user).orderBy(*order))).filter(F.col("_place") <= keep).drop("_place")


def dial(x: Column) -> Column:
    """C14: whole minutes from 1 to 60."""
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor(x + 0.5).cast("int")))


def dial_point(minutes: Column, *, centre: float = 100, radius: float = 84) -> Column:
    """Where a minute stands on the dial: 60 at the top, 15 at the right."""
    angle = minutes / 60 * 2 * F.pi()
    return F.struct((centre + radius * F.sin(angle)).alias("x"), (centre - radius * F.cos(angle)).alias("y"))


def searched(topics: DataFrame, column: str, query: str) -> DataFrame:
    """Rows that hold the query in any case, its places marked; an empty query keeps every row unmarked."""
    query = query.strip()
    if not query:
        return topics.withColumn("marked", F.col(column))
    quoted = "(?i)(\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E)"
    return topics.filter(F.contains(F.lower(column), F.lit(query.lower()))).withColumn("marked", F.regexp_replace(column, quoted, "<mark>$1</mark>"))


def in_several_papers(topics: DataFrame, papers: str = "papers") -> DataFrame:
    """C17: topics of more than one paper."""
    return topics.filter(F.size(papers) > 1)


def offered_series(questions: DataFrame, paper: list[str], series: str = "set") -> DataFrame:
    """The series of a paper that have questions; all four for a paper with none."""
    return questions.groupBy(*paper).agg(F.array_sort(F.collect_set(series)).alias("_s")).select(*paper, F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.array(*[F.lit(s) for s in "ABCD"])).alias("series"))


def papers_with_questions(papers: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """Papers of which at least one question is at hand."""
    return papers.join(questions.select(*keys), keys, "left_semi")


def prompt(passage: Column, stem: Column, options: Column, right: Column, chosen: Column) -> Column:
    """C20: a question as text, with its passage, options, key and what was chosen."""
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("("), F.substring(F.lit("abcd"), i + 1, F.lit(1)), F.lit(") "), o)), "\n")
    said = F.concat(F.lit("Key: "), right, F.coalesce(F.concat(F.lit("; chosen: "), chosen), F.lit("")))
    return F.concat_ws("\n\n", passage, stem, lines, said)


def facet(copies: DataFrame, **chosen) -> DataFrame:
    """Copies filtered by any columns' values; None doesn't filter."""
    for column, value in chosen.items():
        copies = copies if value is None else copies.filter(F.col(column) == value)
    return copies


def ladder(attempts: DataFrame, keys: list[str], *, seq: str = "seq", right: str = "right", on: str = "on") -> DataFrame:
    """W3 in one fold: each item's step, due day and whether it is cleared, over its attempts in order.

    A wrong answer enters or resets the ladder, a right one climbs it; after the last step
    the next right one clears the item. Right the first time: the item never enters (no row).
    Attempts of one item are few; each item is one row of the fold.
    """
    days = F.array(*[F.lit(d) for d in LADDER_DAYS])
    log = attempts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(seq, right, F.col(on).cast("date").alias("day")))).alias("log"))
    start = F.expr("named_struct('step', cast(null as int), 'due', cast(null as date), 'done', false)")

    def move(s: Column, a: Column) -> Column:
        inside = s["step"].isNotNull() & ~s["done"]
        top = inside & (s["step"] >= len(LADDER_DAYS) - 1)
        step = F.when(~a[right], F.lit(0)).when(inside & ~top, s["step"] + 1).otherwise(s["step"])
        due = F.when(~a[right], F.date_add(a["day"], LADDER_DAYS[0])).when(top, F.lit(None).cast("date")).when(inside, F.date_add(a["day"], F.try_element_at(days, s["step"] + 2))).otherwise(s["due"])
        done = F.when(~a[right], F.lit(False)).when(top, F.lit(True)).otherwise(s["done"])
        return F.struct(step.alias("step"), due.alias("due"), done.alias("done"))

    folded = log.withColumn("s", F.aggregate("log", start, move)).filter("s.step is not null")
    return folded.select(*keys, "s.step", "s.due", "s.done")


def from_submitted(attempts: DataFrame, submissions: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts of sheets that were submitted; answers of an open sheet never reach the ladder."""
    return attempts.join(submissions.select(*keys), keys, "left_semi")


def due_queue(items: DataFrame, now: Column, user: str) -> DataFrame:
    """For each user how many items are due, and the first of them."""
    return items.filter((F.col("due") <= now) & ~F.col("done")).groupBy(user).agg(F.count("*").alias("n_due"), F.min_by("item", F.struct("due", "item")).alias("first_item"))


def run_streaks(runs: DataFrame, user: str, seq: str, *, kind: str = "kind") -> DataFrame:
    """The streak after each run: done adds one, anything else voids it."""
    w = Window.partitionBy(user).orderBy(seq)
    broken = runs.withColumn("_segment", F.sum(F.when(F.col(kind) == "done", 0).otherwise(1)).over(w))
    inner = Window.partitionBy(user, "_segment").orderBy(seq)
    return broken.withColumn("streak", F.sum(F.when(F.col(kind) == "done", 1).otherwise(0)).over(inner)).drop("_segment")


def sittings(events: DataFrame, user: str, ts: str, start: Column, submit: Column, *, minutes: int = PAPER_MINUTES) -> DataFrame:
    """W1/W2 in batch: each sitting's start and when it was submitted: by hand, or ``minutes`` after the start however late that is noticed.

    Events between a start and its end belong to it; later ones, up to the next start, are ignored.
    """
    w = Window.partitionBy(user).orderBy(ts, start.cast("int").desc())
    numbered = events.withColumn("sitting", F.sum(start.cast("int")).over(w)).filter("sitting > 0")
    own = Window.partitionBy(user, "sitting")
    begun = numbered.withColumn("start", F.min(F.when(start, F.col(ts))).over(own))
    limit = F.col("start") + F.expr(f"INTERVAL {minutes} MINUTES")
    ended = begun.withColumn("submitted", F.least(F.coalesce(F.min(F.when(submit & (F.col(ts) <= limit), F.col(ts))).over(own), limit), limit))
    return ended.groupBy(user, "start").agg(F.first("submitted").alias("submitted"), F.count_if((F.col(ts) <= F.col("submitted")) & ~start & ~submit).alias("answers"), F.count_if(F.col(ts) > F.col("submitted")).alias("ignored"))
