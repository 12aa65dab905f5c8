"""Fixture-based evaluation: cases against results, as row-local checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Fields every case must have.
REQUIRED_FIELDS = (
    "id", "suite", "semantic_version", "graph_version", "question", "expected_route", "max_executions", "max_repairs",
)
CASE_SCHEMA = (
    "id string, suite string, semantic_version string, graph_version string, question string, expected_route string, "
    "max_executions int, max_repairs int, conversation_id string, expected_specialist_path array<string>, "
    "approved_suggested_questions array<string>, expected_result_digest string, expected_grounding string, "
    "expected_citations array<map<string,string>>, forbidden_citation_metadata array<string>"
)
RESULT_SCHEMA = (
    "id string, route string, executions int, repairs int, sql string, specialist_path array<string>, "
    "suggested_questions array<string>, result_digest string, grounding string, citations array<map<string,string>>"
)


def case_rows(spark: SparkSession, path: str, *, whole_files: bool = False) -> DataFrame:
    """The cases of files that hold JSON lists, one per line or (``whole_files``) one per file, unchecked."""
    lists = spark.read.text(path, wholetext=whole_files).where(F.trim("value") != "")
    parsed = F.from_json("value", f"array<struct<{_as_struct(CASE_SCHEMA)}>>")
    stop = F.raise_error(F.concat(F.lit("Not a list of cases: "), F.col("_metadata.file_name"))).cast(f"array<struct<{_as_struct(CASE_SCHEMA)}>>")
    is_list = F.ltrim(F.regexp_replace("value", "^\ufeff", "")).startswith("[")
    return lists.select(F.inline(F.when(is_list & parsed.isNotNull(), parsed).otherwise(stop)))


def _as_struct(schema: str) -> str:
    return T.StructType.fromDDL(schema).simpleString()[len("struct<"):-1]


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case files (one JSON list each); a case that lacks a required field stops the run."""
    cases = case_rows(spark, path, whole_files=True)
    bad = missing_fields(cases).take(1)
    if bad:
        raise ValueError(f"{bad[0].id or 'unknown'} missing {', '.join(bad[0].missing)}")
    return cases


def missing_fields(cases: DataFrame) -> DataFrame:
    """``(id, missing)`` for cases without all required fields."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED_FIELDS]))
    return cases.select("id", missing.alias("missing")).where(F.size("missing") > 0)


def _differs(actual: str, expected: str) -> Column:
    return F.col(expected).isNotNull() & ~F.col(actual).eqNullSafe(F.col(expected))


def _citations_differ() -> Column:
    """Some citation lacks or contradicts an approved entry; compared in order, extra entries allowed."""
    pairs = F.zip_with("_citations", "expected_citations", lambda actual, expected: F.forall(
        F.map_entries(expected), lambda e: F.try_element_at(actual, e["key"]).eqNullSafe(e["value"])))
    return F.exists(pairs, lambda ok: ~F.coalesce(ok, F.lit(False)))


def checks() -> dict[str, Column]:
    """Name of the failure -> condition, over a case joined with its result.

    Fixed values: the names are results, and must read as they do.
    """
    executions = F.coalesce("executions", F.when(F.col("sql").isNotNull(), 1).otherwise(0))
    suggested = F.coalesce("suggested_questions", F.array().cast("array<string>"))
    approved = F.col("approved_suggested_questions")
    wanted = F.col("expected_citations")
    path = F.col("expected_specialist_path")
    return {
        "unexpected route": ~F.col("route").eqNullSafe(F.col("expected_route")),
        "execution budget exceeded": executions > F.col("max_executions"),
        "blocked route returned SQL": (F.col("max_executions") == 0) & F.col("sql").isNotNull(),
        "repair budget exceeded": F.coalesce("repairs", F.lit(0)) > F.col("max_repairs"),
        "specialist path was not exposed": path.isNotNull() & F.col("specialist_path").isNull(),
        "unexpected specialist path": path.isNotNull() & (F.col("specialist_path") != path),
        "unapproved suggested questions": approved.isNotNull() & (F.size(F.array_except(suggested, approved)) > 0),
        "more than three suggested questions": approved.isNotNull() & (F.size(suggested) > 3),
        "result digest did not match": _differs("result_digest", "expected_result_digest"),
        "grounding did not match": _differs("grounding", "expected_grounding"),
        "unexpected number of citations": wanted.isNotNull() & (F.size("_citations") != F.size(wanted)),
        "citation metadata did not match": wanted.isNotNull() & (F.size("_citations") == F.size(wanted)) & _citations_differ(),
    }


def failures(cases: DataFrame, results: DataFrame) -> DataFrame:
    """``(id, failure)``, one row per failed check and per citation that shows forbidden metadata.

    A case without a result is judged as an empty one.
    """
    judged = cases.join(results, "id", "left").withColumn(
        "_citations", F.coalesce("citations", F.array().cast("array<map<string,string>>")))
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks().items()]))
    forbidden = F.coalesce("forbidden_citation_metadata", F.array().cast("array<string>"))
    leaking = F.filter("_citations", lambda c: F.size(F.array_intersect(F.map_keys(c), forbidden)) > 0)
    leaks = F.transform(leaking, lambda _: F.lit("citation exposed forbidden metadata"))
    return judged.select("id", F.explode(F.concat(found, leaks)).alias("failure"))


def report(cases: DataFrame, results: DataFrame) -> DataFrame:
    """``(total, passed, failed, failures)``; a case fails once however many checks it fails."""
    per_case = cases.select("id").join(
        failures(cases, results).groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left")
    return per_case.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("n").isNull()).alias("passed"),
        F.count("n").alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("failures"))


def answer_tallies(answers: DataFrame) -> DataFrame:
    """Routed, fully cited and correct among answerable questions; clean among the rest.

    ``answers`` has ``expected`` and ``cited`` (arrays of ids), ``specialist_path`` and ``correct``.
    An answer that was not routed to the documents counts as not correct.
    """
    expected = F.coalesce("expected", F.array().cast("array<string>"))
    cited = F.coalesce("cited", F.array().cast("array<string>"))
    answerable = F.size(expected) > 0
    routed = F.coalesce(F.array_contains("specialist_path", "document_retrieval"), F.lit(False))
    return answers.agg(
        F.count_if(answerable).alias("answerable"),
        F.count_if(answerable & routed).alias("routed"),
        F.count_if(answerable & (F.size(F.array_except(expected, cited)) == 0)).alias("all_sources_cited"),
        F.count_if(answerable & routed & F.col("correct")).alias("judged_correct"),
        F.count_if(~answerable).alias("unanswerable"),
        F.count_if(~answerable & (F.size(cited) == 0)).alias("cited_nothing"),
    )
