"""Statements over the caller's own relations, as registered queries: sources with foreign names and text columns, some
of whose values don't fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladder.plans import queries as q
from ladder.sources import views
from ladder.sources.relations import OwnRelations, own_relations
from ladder.sources.run import run_of

#: Source names of the columns that the sources rename.
PANEL_NAMES = {"household_id": "가구 ID", "h_total_income": "소득(만원)", "h_incomeq": "h.incomeq", "year": "조사`연도",
               "p_monthly_wage": "wage"}
CHILD_NAMES = {"student_id": "학생ID", "parent_quintile": "부모소득5분위", "child_edu": "자녀최종학력", "is_grad": "대졸이상여부"}
RATE_NAMES = {"rate_text": "rate(%)", "city": "City"}


def _source(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def foreign_relations(spark: SparkSession, sf_dir: str) -> OwnRelations:
    """The derived views as a stranger's files would have them: numbers as text, other names, every hundredth household's
    income and every fiftieth student's quintile no number, no marker column."""
    run = run_of(sf_dir)
    panel = views.panel(spark, run).drop("household_row")
    income = F.when(F.col("household_id") % 100 == 7, F.lit("n/a")).otherwise(F.col("h_total_income").cast("string"))
    panel = panel.withColumn("h_total_income", income).withColumn("h_incomeq", F.concat(F.lit(" "), F.col("h_incomeq").cast("string")))
    panel = panel.withColumn("year", F.col("year").cast("string")).withColumn("household_id", F.col("household_id").cast("string"))
    child = views.parent_child(spark, run)
    quintile = F.when(F.col("student_id") % 50 == 3, F.lit("?")).otherwise(F.col("parent_quintile").cast("string"))
    child = child.withColumn("parent_quintile", quintile).withColumn("is_grad", F.col("is_grad").cast("double"))
    spend = views.edu_spend(spark, run).withColumn("city", F.col("city").cast("string"))
    rates = views.institution(spark, run).withColumn("city", F.col("city").cast("string"))
    return own_relations(
        spark, {"panel": _source(panel, PANEL_NAMES), "parent_child": _source(child, CHILD_NAMES), "edu_spend": spend,
                "institution": _source(rates, RATE_NAMES)},
        columns={"panel": PANEL_NAMES, "parent_child": CHILD_NAMES, "institution": RATE_NAMES}, city=q.CITY)


#: Statements registered over the foreign relations, one or more per relation.
STATEMENTS = ("income_by_decile", "wage_by_education", "graduate_rate_by_cohort", "expected_rate_by_income_band",
              "income_transition_matrix", "escape_and_retention_trend", "dashboard_document")


def _over_own(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.QUERIES[name](spark, foreign_relations(spark, sf_dir))

    run.__name__ = f"own_{name}"
    return run


def own_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the foreign relations that didn't fit, by relation and misfit."""
    bad = foreign_relations(spark, sf_dir).quarantine
    return bad.select("relation", F.explode("misfits").alias("misfit")).groupBy("relation", "misfit").agg(
        F.count("*").alias("n_rows"))


QUERIES = {f"own_{name}": _over_own(name) for name in STATEMENTS} | {"own_quarantine": own_quarantine}
