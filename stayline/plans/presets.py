"""The study's six models as data: rows, columns, label, base cases, significance level."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.labels import AUDIENCE, NEVER_USED, TESTED_ONLY, USED
from stayline.operators.frames import complete_cases, drop_where
from stayline.operators.joins import without_ids
from stayline.operators.prep import pick_split, quantile_strata, stratified_split, upsample
from stayline.operators.reshape import label_last
from stayline.session import checkpointed

# The columns of the model table the models choose from.
PREDICTORS = (
    "total_presentations",
    "responses_per_student",
    "share_testing",
    "share_low",
    "share_low_medium",
    "share_medium",
    "share_high",
    "usage_label_initial",
    "slide_diversity",
    "special_app_use",
    "audience_label",
    "used_initial",
    "participated_before",
    "teacher_event_prop",
    "student_event_prop",
    "before_session_prop",
    "during_session_prop",
    "after_session_prop",
)
OUTCOMES = (
    "presentations_later",
    "used_later",
    "free_later",
    "premium_later",
    "premiumtrial_later",
)
CATEGORICAL_LEVELS = {
    "usage_label_initial": (NEVER_USED, TESTED_ONLY, USED),
    "audience_label": tuple(b.name for b in AUDIENCE),
}
BINARY = ("special_app_use", "used_initial", "participated_before")


@dataclass(frozen=True)
class Preset:
    """One model. ``label`` is None for clustering.

    ``drop_initial`` and ``drop_later`` name usage labels whose users are left out;
    ``collinear`` are predictors known to depend on others.
    """

    name: str
    label: str | None
    family: str = "binomial"
    level: float = 0.15
    drop_initial: Sequence[str] = (NEVER_USED, TESTED_ONLY)
    drop_later: Sequence[str] = ()
    drop_columns: Sequence[str] = ("usage_label_initial", "used_initial")
    base_cases: Sequence[str] = ("audience_label_Light",)
    collinear: Sequence[str] = ()
    balance: bool = True
    keep_premium_trial: bool = False
    with_dummies: bool = True

    def keeping_collinear(self) -> Preset:
        return replace(self, collinear=())


# Significance levels, base cases and collinear predictors per model.
PRESETS = {
    p.name: p
    for p in (
        Preset(
            "used_later",
            "used_later",
            level=0.16,
            collinear=(
                "share_high",
                "after_session_prop",
                "teacher_event_prop",
                "student_event_prop",
            ),
        ),
        Preset(
            "presentations_later",
            "presentations_later",
            family="gaussian",
            level=0.05,
            drop_initial=(NEVER_USED,),
            drop_later=(TESTED_ONLY,),
            drop_columns=(),
            base_cases=(f"usage_label_initial_{TESTED_ONLY}", "audience_label_None"),
            collinear=("share_high", "after_session_prop", f"usage_label_initial_{USED}"),
            balance=False,
        ),
        Preset(
            "free_later",
            "free_later",
            collinear=(
                "share_high",
                "after_session_prop",
                "teacher_event_prop",
                "student_event_prop",
                "share_testing",
            ),
        ),
        Preset(
            "premium_later",
            "premium_later",
            collinear=(
                "share_high",
                "after_session_prop",
                "student_event_prop",
                "teacher_event_prop",
                "share_testing",
            ),
        ),
        Preset("premiumtrial_later", "premiumtrial_later", keep_premium_trial=True),
        Preset(
            "clusters",
            None,
            drop_initial=(NEVER_USED,),
            drop_columns=(),
            base_cases=(),
            balance=False,
        ),
    )
}


def model_rows(table: DataFrame, preset: Preset, excluded: DataFrame) -> DataFrame:
    """The rows a model sees: its usage labels, no listed users, nothing missing.

    Premium-trial users are left out unless they are what the model predicts.
    """
    rows = table
    if not preset.keep_premium_trial:
        rows = drop_where(rows, F.col("premiumtrial_later") == 1)
    rows = drop_where(rows, F.col("usage_label_initial").isin(*preset.drop_initial))
    if preset.drop_later:
        rows = drop_where(rows, F.col("usage_label_later").isin(*preset.drop_later))
    rows = without_ids(rows, "teacher", excluded, "hashed_coach_id")
    return complete_cases(rows.select("teacher", *PREDICTORS, *OUTCOMES))


def model_frame(
    table: DataFrame, preset: Preset, excluded: DataFrame
) -> tuple[DataFrame, list[str]]:
    """A model's rows reduced to key, predictors and label, and the predictor names."""
    rows = model_rows(table, preset, excluded)
    drop = [*preset.drop_columns, *preset.collinear]
    if preset.label:
        drop += [o for o in OUTCOMES if o != preset.label]
    label = preset.label or "presentations_later"
    levels = {c: v for c, v in CATEGORICAL_LEVELS.items() if c not in preset.drop_columns}
    if not preset.with_dummies:
        drop += BINARY
    frame = label_last(
        rows, label, drop, levels, [*preset.base_cases, *preset.collinear], preset.with_dummies
    )
    if preset.label is None:
        frame = frame.withColumnRenamed("label", label)
        return frame, [c for c in frame.columns if c != "teacher"]
    return frame, [c for c in frame.columns if c not in ("teacher", "label")]


def split_frame(
    frame: DataFrame, preset: Preset, validate: bool = True, seed: int = 1234
) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows; the training rows are balanced where the preset says."""
    stratum = "label"
    if preset.family == "gaussian":
        frame, stratum = quantile_strata(frame, "label"), "stratum"
    # the split is read by the up-sampling and for scoring, the training rows by every fit;
    # a checkpoint also settles them in as many partitions as their size needs
    split = checkpointed(stratified_split(frame, stratum, "teacher", seed))
    train, held_out = pick_split(split, validate)
    if preset.balance:
        train = checkpointed(upsample(train, "label", "teacher", seed))
    return train, held_out


def screening_frame(
    table: DataFrame, excluded: DataFrame, by_later_usage: bool = False
) -> tuple[DataFrame, list[str]]:
    """Complete rows of the numeric predictors, for looking at their correlations.

    Users who only tested are left out by their initial usage, or by their later usage.
    """
    preset = Preset(
        "screening",
        None,
        drop_initial=(NEVER_USED,) if by_later_usage else (NEVER_USED, TESTED_ONLY),
        drop_later=(TESTED_ONLY,) if by_later_usage else (),
    )
    numeric = [p for p in PREDICTORS if p not in BINARY and p not in CATEGORICAL_LEVELS]
    return model_rows(table, preset, excluded).select("teacher", *numeric), numeric
