"""Instrumental variables (E-21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .effects import add_t_pvalue
from .gram import gram, two_stage


def iv_estimate(df: DataFrame, instrument: str, treatment: str, outcome: str,
                controls: Sequence[str] = ()) -> DataFrame:
    """E-21: two-stage least squares effect of ``treatment`` on ``outcome``, with its standard
    error and t test.

    Without controls 2SLS reduces to the Wald ratio cov(z, y) / cov(z, x), whose ``reduced_form`` and
    ``first_stage`` are the two covariances; with controls ``first_stage`` is the instrument's slope in stage 1. All of it
    comes from one cross-product matrix of the columns (:mod:`.gram`). An instrument that is constant, or says nothing
    about the treatment, gives nulls."""
    g = gram(df, [instrument, treatment, outcome, *controls])
    found = two_stage(g, 0, 1, 2, range(3, 3 + len(controls)))
    estimate, se, first, dof = (found["iv_estimate"], found["standard_error"], found["first_stage"], found["df"]) if found else (None, None, None, None)
    row = {"iv_estimate": estimate, "standard_error": se, "t_stat": estimate / se if found and se and se > 0 else None, "df": dof, "n": g.n}
    fields = "iv_estimate double, standard_error double, t_stat double, df long, n long"
    if not controls:
        cov = g.products / (g.n - 1) if g.n > 1 else None
        row |= {"reduced_form": float(cov[0, 2]) if g.n > 1 else None, "first_stage": float(cov[0, 1]) if g.n > 1 else None}
        fields += ", reduced_form double, first_stage double"
    else:
        row["first_stage"] = first
        fields += ", first_stage double"
    return add_t_pvalue(df.sparkSession.createDataFrame([tuple(row.values())], fields))
