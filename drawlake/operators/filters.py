"""Predicates of the reporting queries (B1-B18) and row-level security."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles from least to most powerful.
ROLES = ("SALES", "MANAGER", "ADMIN", "SUPER_ADMIN")


def all_of(conditions: list[Column | None]) -> Column:
    """Conjunction of the conditions that are given; true without any (B1)."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def one_of(column: str, values: list | None, allowed: list | None = None) -> Column | None:
    """IN over the values that are allowed; no filter when none is left."""
    kept = [v for v in values or [] if allowed is None or v in allowed]
    return F.col(column).isin(kept) if kept else None


def time_range(column: str, start: str | None = None, end: str | None = None) -> Column | None:
    """start <= column <= end + 1 day; a bound that is no date is ignored."""
    at = F.col(column).cast("timestamp_ntz")
    low = F.to_timestamp_ntz(F.lit(start)) if _date(start) else None
    high = F.to_timestamp_ntz(F.lit(end)) + F.expr("INTERVAL 1 DAY") if _date(end) else None
    if low is None and high is None:
        return None
    return all_of([None if low is None else at >= low, None if high is None else at <= high])


def _date(text: str | None) -> bool:
    from datetime import datetime

    try:
        datetime.fromisoformat(text or "")
    except ValueError:
        return False
    return True


def containing(column: str, needle: str | None, any_case: bool = False) -> Column | None:
    """LIKE or ILIKE with the needle anywhere; its own wildcards stay wildcards."""
    if not needle:
        return None
    return F.col(column).ilike(f"%{needle}%") if any_case else F.col(column).like(f"%{needle}%")


def not_null_safe_equal(column: str, value) -> Column:
    """``<>`` that leaves null rows out, as SQL does (B2)."""
    return F.col(column) != F.lit(value)


def visible(hidden: Column, method: Column, paired: Column) -> Column:
    """Not hidden, and its method is unknown, or another than ``image``, or it is not paired."""
    return ~F.coalesce(hidden, F.lit(False)) & (method.isNull() | (method != "image") | paired.isNull())


def noisy(column: Column, least: int = 17) -> Column:
    """Opens with a bracket, closes one, and is long."""
    return column.startswith("(") & column.contains(")") & (F.length(column) > least)


def any_substring(column: Column, needles: list[str]) -> Column:
    """One of the needles occurs, in any case."""
    low = F.lower(column)
    return reduce(lambda a, b: a | b, [low.contains(n.lower()) for n in needles], F.lit(False))


def any_word(column: Column, needles: list[str]) -> Column:
    """One of the needles occurs as a whole word, in any case."""
    quoted = "|".join("\\Q" + n + "\\E" for n in needles)
    return column.rlike(rf"(?i)\b(?:{quoted})\b")


def code_only(location: Column) -> Column:
    """No part of the location is a word: digits, a letter with digits and up to four capitals without a vowel are codes."""
    parts = F.filter(F.split(F.coalesce(location, F.lit("")), r"[\s,/|_-]+"), lambda t: F.length(t) > 0)
    word = lambda t: (F.length(t) >= 3) & t.rlike("(?i)[aeiou]") & t.rlike(r"^[A-Za-z'.]+$")
    return ~F.exists(parts, word)


def without_pages(rows: DataFrame, rejected: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose page is not on the list of rejected ones."""
    return rows.join(rejected.select(*on).distinct(), on, "left_anti")


def page_type(explicit: Column, floor_plan: Column, schedule: Column) -> Column:
    """Explicit type, else both, floor_plan, sign_schedule or other."""
    return F.coalesce(
        explicit,
        F.when(floor_plan & schedule, "both").when(floor_plan, "floor_plan").when(schedule, "sign_schedule").otherwise("other"),
    )


def page_request(limit: object = None, offset: object = None, most: int = 200, usual: int = 50) -> tuple[int, int]:
    """Limit within 1..most and offset of at least 0; a request that breaks a range is refused."""
    n, o = int(usual if limit is None else limit), int(offset or 0)  # type: ignore[call-overload]
    if not 1 <= n <= most or o < 0:
        raise ValueError(f"limit must be 1..{most} and offset at least 0")
    return n, o


@dataclass(frozen=True)
class Principal:
    """Who asks: an organisation, a role and a user."""

    user_id: int | None = None
    org_id: int | None = None
    role: str = "SALES"

    def at_least(self, role: str) -> bool:
        return ROLES.index(self.role) >= ROLES.index(role)

    def org_scope(self, column: str) -> Column:
        """Everything for a super admin, one's own organisation else; none is an error."""
        if self.role == "SUPER_ADMIN":
            return F.lit(True)
        if self.org_id is None:
            raise PermissionError("no organisation")
        return F.col(column) == self.org_id

    def activity_scope(self, org: str | None, user: str, asked: int | None = None) -> Column:
        """Standard users see their own activity, admins their organisation's, of one user if asked."""
        own = self.org_scope(org) if org else F.lit(True)
        if not self.at_least("ADMIN"):
            return own & (F.col(user) == self.user_id)
        return own if asked is None else own & (F.col(user) == asked)


def calls_of_jobs(calls: DataFrame, jobs: DataFrame, who: Principal, org: str, job: str, asked: int | None = None) -> DataFrame:
    """Calls of the jobs that an admin may see; a foreign job is an error of the caller, so it is simply empty here."""
    if not who.at_least("ADMIN"):
        raise PermissionError("admins only")
    own = jobs.where(who.org_scope(org)).select(F.col(job))
    if asked is not None:
        own = own.where(F.col(job) == asked)
    return calls.join(own.distinct(), job, "left_semi")


def memberships(users: DataFrame, members: DataFrame, orgs: DataFrame) -> DataFrame:
    """Each user with organisation and role; without a membership the lowest role and no organisation."""
    d = users.join(members.select("user_id", "org_id", "role"), "user_id", "left").join(orgs.select("org_id", F.col("name").alias("org_name")), "org_id", "left")
    return d.withColumn("role", F.coalesce("role", F.lit(ROLES[0])))


def organisations(orgs: DataFrame, members: DataFrame, jobs: DataFrame) -> DataFrame:
    """Organisations with their numbers of members and jobs and their latest job; those without stay."""
    m = members.groupBy("org_id").agg(F.count("*").alias("members"))
    j = jobs.groupBy("org_id").agg(F.count("*").alias("jobs"), F.max("created_at").alias("last_job"))
    d = orgs.join(m, "org_id", "left").join(j, "org_id", "left")
    return d.withColumns({"members": F.coalesce("members", F.lit(0)), "jobs": F.coalesce("jobs", F.lit(0))})
