"""Golden files: JSON evaluation sets as case rows, with every malformed part reported as a row."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as tx

# What is wrong, by the check that found it.
BAD_HEADER = "repo and branch are required strings"
BAD_COMMIT = "commit is not a full 40-character sha"
BAD_CASE = "needs an integer id and a question"
BAD_QUESTION = "every question must be a non-empty string"
BAD_EXPECT = "expect is null or {path, qualname}"
BAD_IDS = "case ids must be unique"


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, violations) of the golden JSON files under a path."""
    files = spark.read.text(path, wholetext=True)
    return golden_cases(files.select(F.input_file_name().alias("file"), F.col("value").alias("json")))


def _get(data: str, member: str) -> Column:
    return F.try_variant_get(F.col(data), f"$.{member}", "variant")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def golden_cases(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, violations) of golden documents (file, json).

    A document lists `entries` (one `question` each) and `conversations` (`turns`), pinned to a
    `repo`, `branch` and `commit`. Cases: file, case_id, turns, expect_path, expect_qualname,
    proves. A file with anything malformed is rejected: it has no cases, and each problem is reported as
    (file, case_id, problem).
    """
    parsed = files.select("file", F.try_parse_json("json").alias("data"))
    listed = "array<variant>"
    none = F.array().cast(listed)

    def members(name: str, turns: Column) -> DataFrame:
        items = F.coalesce(F.try_variant_get(F.col("data"), f"$.{name}", listed), none)
        return parsed.select("file", F.explode(items).alias("item")).withColumn("turns", turns)

    question = F.array(_get("item", "question"))
    turns = F.coalesce(F.try_variant_get(F.col("item"), "$.turns", listed), none)
    rows = members("entries", question).unionByName(members("conversations", turns))
    expect = _get("item", "expect")
    has_expect = expect.isNotNull() & ~_is(expect, "VOID")
    path_ok = _is(F.try_variant_get(expect, "$.path", "variant"), "STRING")
    integer = _is(_get("item", "id"), "BIGINT")
    texts_ok = F.forall(
        "turns", lambda t: _is(t, "STRING") & ~F.coalesce(tx.is_blank(_text(t)), F.lit(True))
    )
    checked = rows.select(
        "file",
        F.try_variant_get(F.col("item"), "$.id", "bigint").alias("case_id"),
        F.transform("turns", _text).alias("turns"),
        F.when(has_expect, F.try_variant_get(expect, "$.path", "string")).alias("expect_path"),
        F.when(has_expect, F.try_variant_get(expect, "$.qualname", "string"))
        .alias("expect_qualname"),
        F.coalesce(F.try_variant_get(F.col("item"), "$.proves", "string"), F.lit(""))
        .alias("proves"),
        F.when(~integer | (F.size("turns") == 0), BAD_CASE)
        .when(~texts_ok, BAD_QUESTION)
        .when(has_expect & ~path_ok, BAD_EXPECT)
        .alias("problem"),
    )
    repeated = checked.filter("case_id IS NOT NULL").groupBy("file", "case_id").agg(
        F.count("*").alias("n")
    )
    header = parsed.select(
        "file",
        F.lit(None).cast("bigint").alias("case_id"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        ~(
                            _is(_get("data", "repo"), "STRING")
                            & _is(_get("data", "branch"), "STRING")
                            & (F.coalesce(_text(_get("data", "branch")), F.lit("")) != "")
                        ),
                        BAD_HEADER,
                    ),
                    F.when(
                        ~(
                            _is(_get("data", "commit"), "STRING")
                            & F.coalesce(
                                _text(_get("data", "commit")).rlike(r"\A[0-9a-f]{40}\z"),
                                F.lit(False),
                            )
                        ),
                        BAD_COMMIT,
                    ),
                )
            )
        ).alias("problem"),
    )
    violations = (
        checked.filter("problem IS NOT NULL")
        .select("file", "case_id", "problem")
        .unionByName(header)
        .unionByName(
            repeated.filter("n > 1").select("file", "case_id", F.lit(BAD_IDS).alias("problem"))
        )
    )
    sound = checked.drop("problem").join(violations.select("file").distinct(), "file", "left_anti")
    return sound, violations
