"""Rules over state rows: budgets, revisions, recovery, review of plans, read-through caches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import is_bounded, names_label
from millrace.operators.graph import resolve_all
from millrace.operators.ordering import spread
from millrace.operators.packing import streamed
from millrace.operators.repair import located
from millrace.operators.state import TERMINAL

#: States from which a run goes on at once.
STOPPED = ("failed", "cancelled", "interrupted", "awaiting_source", "awaiting_outline")
CACHED_BYTES = 4 << 20


def reservations(requests: DataFrame, run: str, order: str, amount: str, limit: int) -> DataFrame:
    """Adds ``accepted`` and ``reserved`` (what is taken after the row): a request that would pass the limit takes nothing."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        taken = 0
        for place, size in rows:
            fits = taken + size <= limit
            taken += size if fits else 0
            yield place, size, fits, taken

    kind = lambda c: f"`{c}` {requests.schema[c].dataType.simpleString()}"
    return streamed(requests, [run], [order], [order, amount], fold, f"{kind(run)}, {kind(order)}, {kind(amount)}, accepted boolean, reserved bigint")


def budget_reservations(requests: DataFrame, run: str, order: str, tokens: str, cost: str, max_tokens: int, max_cost: float) -> DataFrame:
    """``run, order, outcome, tokens_taken, cost_taken``: requests that pass neither limit are taken, in order; costs in millionths, rounded up.

    The limit on tokens is asked first; a limit on costs of 0 is none. What is refused takes nothing.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        taken, spent = 0, 0
        for place, size, price in rows:
            micro = math.ceil(price * 1_000_000)
            if taken + size > max_tokens:
                outcome = "token budget"
            elif max_cost > 0 and (spent + micro) / 1_000_000 > max_cost:
                outcome = "cost budget"
            else:
                outcome, taken, spent = "accepted", taken + size, spent + micro
            yield place, outcome, taken, spent

    kind = lambda c: f"`{c}` {requests.schema[c].dataType.simpleString()}"
    return streamed(requests, [run], [order], [order, tokens, cost], fold, f"{kind(run)}, {kind(order)}, outcome string, tokens_taken bigint, cost_taken bigint")


def revisions(requests: DataFrame, run: str, order: str, request: str, base: str) -> DataFrame:
    """``run, order, outcome, revision``: a request seen before is repeated, one on another base is stale, any other makes the next revision."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, receipts = 0, {}
        for place, name, on in rows:
            if name in receipts:
                yield place, "repeated", receipts[name]
            elif on != now:
                yield place, "stale", now
            else:
                now += 1
                receipts[name] = now
                yield place, "applied", now

    kind = lambda c: f"`{c}` {requests.schema[c].dataType.simpleString()}"
    return streamed(requests, [run], [order], [order, request, base], fold, f"{kind(run)}, {kind(order)}, outcome string, revision int")


def past_deadline(elapsed: Column, most: Column, finalizing: Column) -> Column:
    return (elapsed >= most) & ~finalizing


def expired_with_children(runs: DataFrame, at: str, before: str, children: dict[str, DataFrame], a_pass: int = 100) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Runs (run, status, at) and child tables (run, …) without the next ``a_pass`` ended runs from before a time, oldest first."""
    gone = runs.filter(F.col("status").isin(*TERMINAL) & (F.col(at) < F.to_timestamp(F.lit(before)))).orderBy(at, "run").limit(a_pass).select("run")
    return runs.join(F.broadcast(gone), "run", "left_anti"), {name: rows.join(F.broadcast(gone), "run", "left_anti") for name, rows in children.items()}


def recovery_steps(runs: DataFrame) -> DataFrame:
    """``step, run``: what a start does with runs (run, journalled, cancel_requested, publishing, status, created_at), in order."""
    active = F.col("status").isin("queued", "running", "interrupted")
    steps = F.array(
        F.when(F.col("journalled") & F.col("status").isin(*TERMINAL), F.lit("1 replay terminal")),
        F.when(F.col("journalled") & ~F.col("status").isin(*TERMINAL), F.lit("2 replay journal")),
        F.when(F.col("cancel_requested") & active, F.lit("3 cancel")),
        F.when(F.col("publishing"), F.lit("4 publication")),
        F.when(active & ~F.col("cancel_requested") & ~F.col("publishing"), F.lit("5 enqueue")),
    )
    return runs.select("run", "created_at", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("step"))


def may_resume(status: Column, fully_reviewed: Column, limit: Column, asked: Column) -> Column:
    """Whether a run may go on: from a stopped state, or with warnings; a fully reviewed one needs a higher review limit."""
    return status.isin(*STOPPED) | ((status == "completed_with_warnings") & (~fully_reviewed | (asked > limit)))


def shown_status(runs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Runs (run, status) as shown: queued and running ones with a cancel token (run) are cancelling."""
    marked = runs.join(cancelled.select("run").distinct().withColumn("_token", F.lit(True)), "run", "left")
    return marked.select("run", F.when(F.col("_token") & F.col("status").isin("queued", "running"), "cancelling").otherwise(F.col("status")).alias("status"))


def may_approve(revision: Column, asked: Column, major: Column, status: Column, active: Column) -> Column:
    """Whether an outline may be approved: same revision, no major issue, the run waits for it and is not active."""
    return (revision == asked) & (major == 0) & (status == "awaiting_outline") & ~active


def replans(runs: DataFrame, markers: DataFrame, most: int) -> DataFrame:
    """Runs (run, iteration) that may plan anew once: no marker (run) yet, another iteration left; with the iteration that it takes."""
    return runs.join(markers.select("run").distinct(), "run", "left_anti").filter(F.col("iteration") + 1 < most).select("run", (F.col("iteration") + 1).alias("iteration"))


def read_through(requests: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], most: int = CACHED_BYTES) -> tuple[DataFrame, DataFrame]:
    """``requests`` with their ``value`` and whether it was a ``hit``, and the rows to add to the cache.

    ``cache`` has (key, value); ``compute`` gives these for the requests that it
    lacks, each key once. Values over ``most`` bytes are not kept.
    """
    wanted = requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    fresh = compute(wanted).select(key, "value")
    both = cache.select(key, "value", F.lit(True).alias("hit")).unionAll(fresh.select(key, "value", F.lit(False)))
    return requests.join(both, key), fresh.filter(F.octet_length("value") <= most)


def publication_name(stem: Column, run: Column, at_start: Column, now: Column) -> Column:
    """Where a document goes: its own file, or one beside it if the file has changed since the run began."""
    return F.when(at_start.eqNullSafe(now), F.concat(stem, F.lit(".md"))).otherwise(F.concat(stem, F.lit(".conflict-"), run, F.lit(".md")))


def chapters(groups: DataFrame, explicit: DataFrame, excluded: DataFrame, branches: DataFrame) -> DataFrame:
    """``outline, branch, chapter, fault``: every branch in one chapter or excluded.

    A branch named itself (outline, branch, chapter) goes before its group
    (same columns); faults are two chapters of one rank, a branch both covered
    and excluded, and one in neither.
    """
    keys = ["outline", "branch"]
    named = explicit.groupBy(*keys).agg(F.min("chapter").alias("own"), F.countDistinct("chapter").alias("owns"))
    grouped = groups.groupBy(*keys).agg(F.min("chapter").alias("group"), F.countDistinct("chapter").alias("in_groups"))
    met = branches.join(named, keys, "left").join(grouped, keys, "left").join(excluded.select(*keys).distinct().withColumn("out", F.lit(True)), keys, "left")
    chapter = F.coalesce("own", "group")
    fault = F.when(F.coalesce(F.when(F.col("own").isNotNull(), F.col("owns")), F.col("in_groups"), F.lit(0)) > 1, "conflict").when(F.col("out") & F.col("own").isNotNull(), "covered and excluded").when(chapter.isNull() & F.col("out").isNull(), "missing")
    return met.select(*keys, F.when(F.col("out") & F.col("own").isNull(), None).otherwise(chapter).alias("chapter"), fault.alias("fault"))


def unassigned(branches: DataFrame, reported: DataFrame) -> DataFrame:
    """Uncovered branches (outline, label) that no reported message (outline, message) names, one issue each."""
    # Each message is read once for all labels of its outline; those found in it are then looked at for what stands around them.
    found = located(reported.select("outline", F.col("message").alias("part"), F.col("message").alias("text")).distinct(), branches.select("outline", F.col("label").alias("phrase")), "outline", "part")
    alone = F.expr(r"part rlike concat('(?<![\\p{L}\\p{N}])\\Q', phrase, '\\E(?![0-9.])')")
    named = found.filter(alone).select("outline", F.col("phrase").alias("label")).distinct()
    return branches.join(named, ["outline", "label"], "left_anti").select("outline", "label", F.lit("major").alias("severity"), F.lit("unassigned_branch").alias("code"))


def capped_issues(issues: DataFrame, scope: str, order: str, most: int) -> DataFrame:
    """The first ``most`` issues of a scope that are major or minor."""
    place = F.row_number().over(Window.partitionBy(scope).orderBy(order))
    return issues.filter(F.col("severity").isin("major", "minor")).withColumn("place", place).filter(F.col("place") <= most)


def outline_reviews(issues: DataFrame, named: DataFrame, ids: DataFrame, scope: str, issue: str, most: int = 8) -> DataFrame:
    """``scope, issues, resolved, valid, accepted``: whether a review is taken as a whole.

    ``issues``: scope, issue, severity, message, code, query; ``named``: scope,
    issue, pos, prefix, the sections that an issue names; ``ids``: scope, id. A
    review of over ``most`` issues is refused, as is one with a severity that there
    is not, a message or code that is blank or too long, a query that is too
    long, or a prefix that does not name one section alone.
    """
    found = resolve_all(named, ids, scope, issue).select(scope, issue, F.col("ids").isNotNull().alias("_resolved"))
    text = lambda c, n: is_bounded(F.coalesce(c, F.lit("")), n)
    fine = F.col("severity").isin("major", "minor") & text("message", 4000) & text("code", 100) & (F.coalesce(F.octet_length("query"), F.lit(0)) <= 2000)
    met = issues.join(found.hint("merge"), [scope, issue], "left").withColumn("_resolved", F.coalesce("_resolved", F.lit(True)))
    sums = met.groupBy(scope).agg(F.count("*").alias("issues"), F.min("_resolved").alias("resolved"), F.min(F.coalesce(fine, F.lit(False))).alias("valid"))
    return sums.withColumn("accepted", F.col("resolved") & F.col("valid") & (F.col("issues") <= most))


def partly_published(planned: DataFrame, written: DataFrame, run: str) -> DataFrame:
    """Planned titles (run, title) without a written section of that title."""
    return planned.join(written.select(run, "title").distinct(), [run, "title"], "left_anti")


def coverage_note(indexed: Column, cited: Column, excluded: Column, skipped: Column) -> Column:
    return F.format_string("%d files indexed, %d cited, %d excluded, %d skipped", indexed, cited, excluded, skipped)


def brief_faults(findings: DataFrame, evidence: DataFrame, scope: str, most: int = 24, longest: int = 2000) -> DataFrame:
    """``scope, finding, code``: faults of findings (scope, finding, topic, observation, runtime, evidence_ids).

    More than ``most`` of a scope, a text that is blank or too long, ids that
    ``evidence`` (id, runtime_allowed) lacks, and claims of what runs without an
    implementation among what they cite. A scope's findings are counted, not gathered.
    """
    findings = spread(findings, scope)
    place = F.row_number().over(Window.partitionBy(scope).orderBy("finding"))
    texts = findings.select(scope, "finding", F.when((F.trim("topic") == "") | (F.trim("observation") == "") | (F.octet_length("observation") > longest), "text").alias("code")).unionAll(
        findings.select(scope, "finding", F.when(place > most, "too many"))
    )
    cited = findings.select(scope, "finding", "runtime", F.explode_outer("evidence_ids").alias("id")).join(evidence.select("id", "runtime_allowed"), "id", "left")
    judged = cited.groupBy(scope, "finding", "runtime").agg(F.count_if(F.col("runtime_allowed").isNull()).alias("unknown"), F.count_if("runtime_allowed").alias("proofs"))
    by_ids = judged.select(scope, "finding", F.when(F.col("unknown") > 0, "unknown id").alias("code")).unionAll(judged.select(scope, "finding", F.when(F.col("runtime") & (F.col("proofs") == 0), "no implementation")))
    return texts.unionAll(by_ids).filter("code is not null")


def names_any(message: Column, labels: list[str]) -> Column:
    """Whether a message names one of a few labels."""
    return F.array_max(F.array(F.lit(False), *(names_label(message, label) for label in labels)))
