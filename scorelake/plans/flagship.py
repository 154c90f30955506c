"""The flagship job: score a submission against its cases and report per tag."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scorelake.operators.reports import complete_with_zero, stats_by_tag
from scorelake.operators.scoring import score_by_type
from scorelake.plans.fixtures import Tables


def score_submission(t: Tables) -> DataFrame:
    answered = t.submitted.join(t.cases.drop("user_id"), "id")
    scored = score_by_type(answered).select("id", "result", "score")
    return stats_by_tag(complete_with_zero(scored, t.tagged_cases))
