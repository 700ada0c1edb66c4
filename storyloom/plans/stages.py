"""The item stages as plug-ins: each is a named DataFrame -> DataFrame step with a stage number.

Model calls are injected: the caller supplies a function from a pandas batch to a list of answers. Without one, the
model steps fall back to what the rules alone can say.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import clip
from storyloom.functions import scores as S
from storyloom.functions import text as X
from storyloom.functions.urls import normalize_url
from storyloom.operators import scoring
from storyloom.session import materialize


@dataclass(frozen=True)
class Stage:
    """`apply` takes the items, and where `per_batch` is set also the number of the micro-batch, for stages that keep state."""

    name: str
    number: int
    apply: Callable[..., DataFrame]
    per_batch: bool = False


def ordered(stages: list[Stage]) -> list[Stage]:
    """By stage number; equal numbers keep the order of registration."""
    return sorted(stages, key=lambda s: s.number)


def run_stages(items: DataFrame, stages: list[Stage], batch_id: int = 0) -> DataFrame:
    for s in ordered(stages):
        items = items.transform(s.apply, batch_id) if s.per_batch else items.transform(s.apply)
    return items


def _unskipped(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`step` for the items that no stage has skipped; the others get NULL in the columns it adds."""
    done = step(df.filter("skip_reason is null"))
    rest = df.filter("skip_reason is not null")
    added = [f for f in done.schema.fields if f.name not in rest.columns]
    return done.unionByName(rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added]))


def infer(
    rows: DataFrame, inputs: list[str], call: Callable[[pd.DataFrame], list], name: str, out_type: str = "string",
    required: bool = False, todo: Column | None = None,
) -> DataFrame:
    """`rows` plus the answers of a model, one call per Arrow batch with the rows that fit `todo`; the others get NULL. Only `inputs`
    travel to the model. A failing batch gives NULL answers, unless the answer is `required`."""

    def run(wanted: pd.Series, *columns: pd.Series) -> pd.Series:
        mine = wanted.to_numpy(dtype=bool)
        asked = pd.DataFrame(dict(zip(inputs, columns)))[mine].reset_index(drop=True)
        answers = []
        if len(asked):
            try:
                answers = list(call(asked))
            except Exception:
                if required:
                    raise
                answers = [None] * len(asked)
        if len(answers) != len(asked):
            raise ValueError(f"{len(answers)} answers for {len(asked)} rows")
        given = iter(answers)
        return pd.Series([next(given) if m else None for m in mine])

    wanted = F.lit(True) if todo is None else F.coalesce(todo, F.lit(False))
    answer = F.pandas_udf(run, out_type).asNondeterministic()  # a model is asked once, wherever its answer is used
    return rows.withColumn(name, answer(wanted, *inputs))


def url_stage() -> Stage:
    return Stage("canonical url", 1, lambda df: df.withColumn("url_normalized", normalize_url(F.col("url"))))


def watch_stage(topics) -> Stage:
    from storyloom.operators.watch import match_topics

    return Stage("watch topics", 2, lambda df: df.withColumn("watch_topics", match_topics(F.col("title"), F.col("text"), topics)))


def gate_stage(profiles: DataFrame, min_sim: float) -> Stage:
    def apply(df: DataFrame) -> DataFrame:
        g = scoring.gated(df, profiles, min_sim)
        return g.withColumn("skip_reason", F.coalesce("skip_reason", "gate_reason")).drop(
            "gate", "gate_reason", "best_vertical", "best_sim"
        )

    return Stage("relevance gate", 3, apply)


def story_stage(clusters) -> Stage:
    """Stories by URL (and vector), kept by `clusters` across batches: adds `cluster_id` and `cluster_size` as they are now."""

    def apply(df: DataFrame, batch_id: int) -> DataFrame:
        clusters.each(df.select("id", *[x for x in (clusters.key, "vec") if x in df.columns]), batch_id)
        return clusters.of(df)

    return Stage("stories", 3, apply, per_batch=True)


TAGGER_ANSWER = "tags array<string>, vertical string, insight double"


def tagger_stage(call) -> Stage:
    """Tags, area and insight from a model's answer for items with any text; a broken answer leaves them as they are. Tags are lower
    case, five at most; an area that is not one of the known ones counts as none."""

    def apply(df: DataFrame) -> DataFrame:
        has_text = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("text", F.lit("")) != "")
        asked = model_stage("", 0, ["title", "text", "feed_name"], call, "_answer", has_text).apply(df)
        a = F.from_json(X.json_block(F.col("_answer")), TAGGER_ANSWER)
        tags = F.slice(F.filter(F.transform("_a.tags", lambda t: F.trim(F.lower(t))), lambda t: t != ""), 1, 5)
        area = F.trim(F.lower("_a.vertical"))
        known = F.col("_a").isNotNull()
        return (
            asked.withColumn("_a", a)
            .withColumn("tags", F.coalesce(tags, F.col("tags")))
            .withColumn("vertical", F.when(known, F.when(area.isin(*K.VERTICALS), area)).otherwise(F.col("vertical")))
            .withColumn("insight_score", F.when(F.col("_a.insight").isNotNull(), clip(F.col("_a.insight"), 0.0, 1.0)))
            .drop("_answer", "_a")
        )

    return Stage("tagger", 4, apply)


def base_score_stage(as_of: Column) -> Stage:
    def apply(df: DataFrame) -> DataFrame:
        score = S.base_score(F.col("published_at"), F.col("raw_score"), F.col("cluster_size"), as_of)
        return df.withColumn("base_score", F.when(F.col("skip_reason").isNull(), score))

    return Stage("base score", 6, apply)


def judge_stage(active: DataFrame, inputs: list[str], call) -> Stage:
    """Relevance from a model's answer `{"score": ...}`, clipped to 0..1, for items in an area that has a profile and has not judged
    them yet; remembers the profile's version."""

    def apply(df: DataFrame) -> DataFrame:
        version = F.try_element_at(F.col("_active"), F.col("vertical"))["version"]
        known = df.withColumn("_active", scoring.by_area(active, "version")).withColumn("_version", version).drop("_active")
        stale = F.col("llm_relevance").isNull() | ~F.col("scored_profile_version").eqNullSafe(F.col("_version"))
        asked = model_stage("", 0, inputs, call, "_answer", F.col("_version").isNotNull() & stale).apply(known)
        score = F.get_json_object(X.json_block(F.col("_answer")), "$.score").try_cast("double")
        return (
            asked.withColumn("llm_relevance", F.when(score.isNotNull(), clip(score, 0.0, 1.0)).otherwise(F.col("llm_relevance")))
            .withColumn("scored_profile_version", F.when(score.isNotNull(), F.col("_version")).otherwise(F.col("scored_profile_version")))
            .drop("_answer", "_version")
        )

    return Stage("judge", 7, apply)


def personal_stage(tags: DataFrame, sources: DataFrame, taste: DataFrame, muted: DataFrame, as_of: Column, no_boost=()) -> Stage:
    """Mutes and the personal score, from what has been learned so far."""

    def apply(df: DataFrame) -> DataFrame:
        def step(x: DataFrame) -> DataFrame:
            return scoring.scored(x, tags, sources, taste, muted, as_of, no_boost).select(*x.columns, "personal_score")

        # the score reads its items several times; what the stages before it did is done once
        return _unskipped(materialize(df, "unscored"), step)

    return Stage("personal score", 8, apply)


def title_stage() -> Stage:
    return Stage(
        "title", 3,
        lambda df: df.withColumn("title", X.title_or_fallback(F.col("title"), F.col("text"), F.col("feed_name"))),
    )


def model_stage(name: str, number: int, inputs: list[str], call, column: str, todo: Column | None = None) -> Stage:
    """A model step for rows that were not skipped (and fit `todo`); the others get no answer. Rows are passed on in one piece, so that
    stages before a model are not computed once per side of a union."""

    def apply(df: DataFrame) -> DataFrame:
        wanted = F.col("skip_reason").isNull() if todo is None else F.col("skip_reason").isNull() & todo
        return infer(df, inputs, call, column, todo=wanted)

    return Stage(name, number, apply)


def summary_stage() -> Stage:
    def apply(df: DataFrame) -> DataFrame:
        rule = X.passthrough_summary(F.col("title"), F.col("text"), F.col("feed_name"))
        return df.withColumn("_s", rule).withColumn("summary", F.coalesce("summary", "_s.summary")).drop("_s")

    return Stage("summary", 5, apply)
