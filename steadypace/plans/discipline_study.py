"""The discipline study from source tables to stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadypace import schemas
from steadypace.functions.scalars import mask_id
from steadypace.operators.aliased import SLOPE_FIRST
from steadypace.operators.daily import POST_DISCIPLINE, build_discipline_panel, date_columns
from steadypace.operators.effects import effect_table, rank_effects
from steadypace.operators.ols import LEVEL, StepModel, discontinuity_by, fit_step_cells
from steadypace.operators.profiles import day_cells, profile_of_cells
from steadypace.operators.quality import discipline_summary
from steadypace.session import materialise
from steadypace.sources.publish import never, publish
from steadypace.sources.tables import (
    data_dictionary,
    save_coefficients,
    save_step_model,
    table_dictionary,
    write_csv,
    write_table,
)

OUTCOMES = (("early_rate", "down"), ("mean_secs", "up"))


def is_post(period: str = "period") -> Column:
    return F.col(period) == POST_DISCIPLINE


def stored_cells(panel: DataFrame) -> DataFrame:
    """``day_cells`` on reliable storage: one pass over the panel serves the models, the profile and the
    fitted days."""
    return materialise(day_cells(panel))


def fit_cells(cells: DataFrame) -> dict[str, StepModel]:
    """Cubic trend and step for both daily outcomes from stored cells."""
    ys = [y for y, _ in OUTCOMES]
    models = fit_step_cells(cells, ys, F.col("date_relative_1"), is_post())
    return dict(zip(ys, models))


def fit_step_models(panel: DataFrame) -> dict[str, StepModel]:
    """Cubic trend and step for both daily outcomes, in one pass over the panel."""
    return fit_cells(stored_cells(panel))


def _predictions(models: dict[str, StepModel]) -> dict[str, Column]:
    day = F.col("date_relative_1")
    return {
        "mean_prediction": models["early_rate"].predict(day, is_post()),
        "mean_prediction_secs": models["mean_secs"].predict(day, is_post()),
    }


def predicted_profile(panel: DataFrame, models: dict[str, StepModel],
                      span: int | None = 365) -> DataFrame:
    """Day profile with the mean prediction of both models."""
    return predicted_cells(day_cells(panel), models, span)


def predicted_cells(cells: DataFrame, models: dict[str, StepModel], span: int | None = 365) -> DataFrame:
    """Day profile with the mean prediction of both models, from stored cells."""
    return profile_of_cells(cells, _predictions(models), span)


def predicted_day(cells: DataFrame, models: dict[str, StepModel], day: int = 1) -> DataFrame:
    """Fitted outcomes on one relative day (one row; none if the day is lacking), from the panel or its
    cells."""
    own = cells.where(F.col("date_relative_1") == day).select("date_relative_1", "period").distinct()
    fitted = _predictions(models)
    return own.select(
        fitted["mean_prediction"].alias("predicted"), fitted["mean_prediction_secs"].alias("predicted_secs"),
    ).limit(1)


def operator_effects(panel: DataFrame, outcome: str, better: str, terms=(LEVEL,),
                     contrast: str = "absolute", entity: str = "operator_id",
                     aliased: str = "null") -> DataFrame:
    """Effect of the first discipline per operator on daily rows. ``aliased="drop"`` also reports what operators
    with few days identify, the slope before the change where rows cannot tell them apart."""
    fitted = discontinuity_by(panel, outcome, "date_relative_1", is_post(), [entity], contrast,
                              aliased=aliased, order=SLOPE_FIRST)
    return effect_table(fitted, better, terms)


def published_discipline_panel(panel: DataFrame, salt: str) -> DataFrame:
    masked = mask_id(panel, "operator_id", salt)
    return masked.select(*schemas.discipline_data(date_columns(panel)))


REPEATED = "_repeated"


def once_per_day(panel: DataFrame) -> DataFrame:
    """Marks rows of an operator that repeat the day of the row before, along the panel's own window, which
    costs no exchange."""
    along = Window.partitionBy("operator_id").orderBy("date")
    return panel.withColumn(REPEATED, F.lag("date").over(along).eqNullSafe(F.col("date")))


def save_discipline_study(days: DataFrame, folder: str, salt: str) -> None:
    """Published tables, dictionary and models from ``read_discipline_daily`` rows. Raises
    ``ContractError`` if an operator has several rows on one day, before anything is published."""
    spark = days.sparkSession
    built = build_discipline_panel(days)
    described = schemas.discipline_data(date_columns(built))
    publish(
        mask_id(once_per_day(built), "operator_id", salt), f"{folder}/discipline_data",
        [never("one row per operator and date", F.col(REPEATED))], columns=list(described),
    )
    panel = spark.read.parquet(f"{folder}/discipline_data")
    write_table(discipline_summary(panel, "operator_id_hash"),
                f"{folder}/discipline_summary_stats")
    write_csv(data_dictionary(panel, "discipline_data", described),
              f"{folder}/discipline_data_fields")
    write_csv(
        table_dictionary(spark, "discipline_data", "Daily averages of disciplined operators",
                         "One operator on one day"),
        f"{folder}/discipline_data_table",
    )
    write_table(day_cells(panel), f"{folder}/day_cells")
    cells = spark.read.parquet(f"{folder}/day_cells")
    models = fit_cells(cells)
    write_table(predicted_cells(cells, models), f"{folder}/day_profile")
    for outcome, better in OUTCOMES:
        save_step_model(spark, models[outcome], f"{folder}/step_{outcome}")
        effects = operator_effects(panel, outcome, better, entity="operator_id_hash")
        ranked = rank_effects(effects, ["operator_id_hash"])
        save_coefficients(ranked, f"{folder}/effects_{outcome}")
