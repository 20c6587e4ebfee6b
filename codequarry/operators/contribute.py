"""Contribution candidates: gathered, cleared of work in progress, scored and ranked."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of a score's parts; the last three count against it.
WEIGHTS = {"skill_fit": 1.0, "difficulty_fit": 1.0, "impact": 1.0, "evidence": 1.0, "activity": 1.0, "complexity": -1.0, "conflict_risk": -1.0, "uncertainty": -1.0}


@dataclass(frozen=True)
class Profile:
    """A developer: kinds of symbols and languages they work with, domains (prefixes of paths, none for any), hours at hand, and the lines they are sure of changing."""

    skills: tuple[str, ...] = ("function", "method")
    languages: tuple[str, ...] = ("javascript", "typescript")
    domains: tuple[str, ...] = ()
    level: str = "intermediate"
    hours: float = 4.0
    most_lines: int = 200


#: What is checked of a candidate, in order; the fourth and fifth speak against it, the third is no condition.
CHECKS = ("exists", "has_evidence", "has_issue", "has_active_pull", "recently_changed", "bounded", "fits_skills", "fits_time")
LINES_AN_HOUR = 25


def validate(found: DataFrame, targets: DataFrame, issues: DataFrame, pulls: DataFrame, changed: DataFrame, profile: Profile = Profile()) -> DataFrame:  # noqa: B008
    """found with file_path, name, kind, lines, effort_hours, one column for each of CHECKS, and valid: whether none speaks against the candidate.

    found: target_id, sources, n_evidence. targets: id, name, kind, file_path, language, start_line, end_line. issues, pulls, changed: file_path. A target that isn't
    there exists not, and its other checks are false.
    """
    flag = lambda rows, name: rows.select("file_path", F.lit(True).alias(name)).where("file_path IS NOT NULL").distinct()
    own = targets.select(F.col("id").alias("target_id"), "name", "kind", "file_path", "language", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    rows = found.join(own, "target_id", "left")
    for table, name in ((issues, "has_issue"), (pulls, "has_active_pull"), (changed, "recently_changed")):
        rows = rows.join(flag(table, name), "file_path", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    effort = F.round(1 + F.col("lines") / LINES_AN_HOUR, 2)
    known = F.col("kind").isin(*profile.skills) & F.col("language").isin(*profile.languages)
    if profile.domains:
        known &= reduce(lambda a, b: a | b, [F.col("file_path").startswith(d) for d in profile.domains])
    checked = {"exists": F.col("name").isNotNull(), "has_evidence": F.col("n_evidence") > 0, "bounded": F.col("lines") <= profile.most_lines, "fits_skills": known, "fits_time": effort <= profile.hours}
    rows = rows.withColumn("effort_hours", effort).withColumns({name: F.coalesce(c, F.lit(False)) for name, c in checked.items()})
    valid = reduce(lambda a, b: a & b, [F.col(c) for c in ("exists", "has_evidence", "bounded", "fits_skills", "fits_time")]) & ~F.col("has_active_pull") & ~F.col("recently_changed")
    return rows.withColumn("valid", valid)


def described(checked: DataFrame) -> DataFrame:
    """What is shown of each candidate that validate has checked: target_id, title, contribution_type, problem, difficulty, effort_hours, required_skills, relevant, evidence, confidence, related, valid."""
    kind = F.when(F.col("sources").contains("gap"), "test").when(F.col("sources").contains("undocumented"), "documentation").otherwise("code")
    difficulty = F.when(F.col("lines") <= 10, "easy").when(F.col("lines") <= 50, "medium").otherwise("hard")
    verb = F.when(kind == "test", "Test ").when(kind == "documentation", "Document ").otherwise("Mend ")
    confidence = F.when(~F.col("exists"), "low").when(F.col("n_evidence") >= 2, "high").otherwise("medium")
    related = F.array_join(F.array_compact(F.array(F.when(F.col("has_issue"), "issue"), F.when(F.col("has_active_pull"), "pull request"))), ",")
    return checked.select(
        "target_id", F.concat(verb, "name").alias("title"), kind.alias("contribution_type"), F.concat(F.col("kind"), F.lit(" "), F.col("name"), F.lit(" is named by: "), F.col("sources")).alias("problem"),
        difficulty.alias("difficulty"), "effort_hours", F.concat_ws(",", "language", "kind").alias("required_skills"), F.concat_ws(",", "file_path", "target_id").alias("relevant"),
        F.col("sources").alias("evidence"), confidence.alias("confidence"), related.alias("related"), "valid",
    )


def candidates(sources: dict[str, DataFrame]) -> DataFrame:
    """target_id, sources, n_evidence: what several sources (column id) propose, once each."""
    tagged = [df.select(F.col("id").alias("target_id"), F.lit(name).alias("source")) for name, df in sources.items()]
    grouped = reduce(DataFrame.union, tagged).distinct().groupBy("target_id")
    return grouped.agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n_evidence"))


def conflicts(issues: DataFrame, pulls: DataFrame) -> DataFrame:
    """issue_id, linked, overlapping: whether an open pull request names the issue or touches one of its files. issues: issue_id, file; pulls: issue_id (of the link), file."""
    linked = pulls.where("issue_id IS NOT NULL").select("issue_id", F.lit(True).alias("linked")).distinct()
    touched = pulls.where("file IS NOT NULL").select("file", F.lit(True).alias("touched")).distinct()
    per_issue = issues.join(touched, "file", "left").groupBy("issue_id").agg(F.max(F.coalesce("touched", F.lit(False))).alias("overlapping"))
    return per_issue.join(linked, "issue_id", "left").select("issue_id", F.coalesce("linked", F.lit(False)).alias("linked"), "overlapping")


def rank(found: DataFrame, parts: DataFrame, busy: DataFrame, n: int = 100, least_evidence: int = 1, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """rank, target_id, sources, score, confidence of the n best candidates with enough evidence whose file nobody works on; ties by id.

    parts: target_id, file_path and any of the weights' columns; busy: file_path.
    """
    known = {k: w for k, w in weights.items() if k in parts.columns}
    score = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in known.items()), F.lit(0.0))
    open_ = found.where(F.col("n_evidence") >= least_evidence).join(parts, "target_id").join(busy.select("file_path").distinct(), "file_path", "left_anti")
    scored = open_.select("target_id", "sources", F.round(score + F.col("n_evidence") * weights["evidence"] * (0 if "evidence" in known else 1), 6).alias("score"), F.when(F.col("n_evidence") >= 2, "high").otherwise("medium").alias("confidence"))
    top = scored.orderBy(F.desc("score"), "target_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "target_id")))
