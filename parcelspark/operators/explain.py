"""Explanation jobs: trajectory flags, payloads, prompts, replies, validated results."""

from __future__ import annotations

import json
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.replies import (
    CONFIDENCES, CONSISTENCIES, MAX_ACTION, MAX_CAUSES, MAX_EVIDENCE, MAX_SUMMARY, STATUSES,
    expected_status, explanation, fallback, with_validated,
)
from parcelspark.functions.expressions import let
from parcelspark.functions.rounding import SCALE, deviation_of, mean_of, ticks
from parcelspark.functions.season import Season
from parcelspark.operators.incremental import split_unchanged
from parcelspark.session import stage

FEW_OBSERVATIONS = 3


def parse_trajectory(text: Column) -> Column:
    """Distances from their JSON text; unreadable text gives an empty list."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def trajectory_flags(distances: Column, green: Column) -> Column:
    n = F.size(distances)
    early = F.array_max(F.slice(distances, F.lit(1), F.greatest(F.lit(1), F.floor(n / 3).cast("int")))) > green
    late = F.forall(F.slice(distances, -3, 3), lambda d: d > green)
    steps = F.zip_with(F.slice(distances, F.lit(2), n - 1), F.slice(distances, F.lit(1), n - 1), lambda b, a: b - a)
    rising = F.size(F.filter(steps, lambda d: d > 0)) > (n - 1) * 0.6
    return F.array_compact(
        F.array(
            F.when((n >= 2) & early, "early_deviation"),
            F.when((n >= 3) & late, "persistent_deviation"),
            F.when(F.when(n >= 3, rising), "worsening_trend"),
        )
    )


def quality_flags(distances: Column, status: Column, min_observations: int = 1) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.size(distances) < max(FEW_OBSERVATIONS, min_observations), "few_observations"),
            F.when(status == "GRAY", "insufficient_data"),
        )
    )


def distance_summary(distances: Column) -> Column:
    """Mean, extremes, population deviation (4 dp) and length; null for an empty trajectory."""

    def summary(values: Column) -> Column:
        zero = F.lit(0).cast("long")
        total = F.aggregate(values, zero, lambda acc, v: acc + v)
        squares = F.aggregate(values, zero, lambda acc, v: acc + v * v)
        return F.struct(
            (F.array_max(values) / SCALE).alias("max"),
            mean_of(total, F.size(values)).alias("mean"),
            (F.array_min(values) / SCALE).alias("min"),
            F.size(values).alias("n_points"),
            deviation_of(total, squares, F.size(values)).alias("std"),
        )

    return F.when(F.size(distances) > 0, let(F.transform(distances, ticks), summary))


def build_payloads(
    scores: DataFrame,
    thresholds: DataFrame,
    season: Season = Season(),
    min_observations: int = 1,
    cadence_days: int = 16,
) -> DataFrame:
    """(parcel_id, status, payload, payload_hash). The limits come from a one-row table as a scalar subquery."""
    scores = scores.withColumn("_limits", thresholds.select(F.struct("method", "green", "red")).scalar())
    limits = F.col("_limits")
    d = F.col("distance_trajectory")
    payload = F.struct(  # fields in alphabetical order, so that the hash does not depend on their order here
        F.struct(
            F.lit(cadence_days).alias("cadence_days"), limits["green"].alias("green_threshold"),
            limits["red"].alias("red_threshold"), limits["method"].alias("scoring_method"),
            F.lit(season.end).alias("season_end"), F.lit(season.start).alias("season_start"),
        ).alias("context"),
        "crop_name",
        quality_flags(d, F.col("status"), min_observations).alias("data_quality_flags"),
        distance_summary(d).alias("distance_summary"),
        "health_score",
        "max_deviation_date",
        F.coalesce("n_observations", F.lit(0)).alias("n_observations"),
        F.col("parcel_id").cast("string").alias("parcel_id"),
        "status",
        trajectory_flags(d, limits["green"]).alias("trajectory_flags"),
    )
    return scores.select("parcel_id", F.coalesce("status", F.lit("GRAY")).alias("status"), payload.alias("payload")).withColumn(
        "payload_hash", payload_hash(F.col("payload"))
    )


def payload_hash(payload: Column) -> Column:
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


RULES = f"""You explain crop-monitoring results to agronomists. Each request holds the measurements of one field parcel.

How to answer:
- Return one JSON object and nothing else. Its keys are status, summary, possible_causes, confidence,
  recommended_action, evidence_used and consistency_check.
- status is one of {", ".join(STATUSES)}. It follows the traffic light: GREEN is normal, YELLOW is warning,
  RED is critical, GRAY is insufficient_data. With the quality flag few_observations or insufficient_data it is
  insufficient_data, and the summary says so.
- summary has one to three sentences, at most {MAX_SUMMARY} characters.
- possible_causes lists up to {MAX_CAUSES} hypotheses in cautious wording. Causes are never certain.
- confidence is one of {", ".join(CONFIDENCES)}.
- recommended_action is short and practical, at most {MAX_ACTION} characters.
- evidence_used names up to {MAX_EVIDENCE} values of the request. Use no value that the request does not contain.
- consistency_check is one of {", ".join(CONSISTENCIES)}."""

CONTEXT_RULES = """When retrieved context is present:
- The status and all metrics come from parcel_analytics alone.
- Similar parcels, nearby parcels and the reference summary only support the discussion; they never change the status.
- Mention no parcel or distance that is not listed."""

EXAMPLE_REPLY = {
    "status": "warning",
    "summary": "The parcel drifts away from its crop's usual course since early summer.",
    "possible_causes": ["Delayed emergence may explain the early gap", "Residual cloud could disturb single dates"],
    "confidence": "medium",
    "recommended_action": "Inspect stand density in the field within two weeks.",
    "evidence_used": ["health_score", "trajectory_flags: worsening_trend"],
    "consistency_check": "consistent",
}


def system_prompt(with_example: bool = True, with_context: bool = False) -> str:
    parts = [RULES]
    if with_context:
        parts.append(CONTEXT_RULES)
    if with_example:
        parts.append("Example of an answer:\n" + json.dumps(EXAMPLE_REPLY, indent=2))
    return "\n\n".join(parts)


def has_content(bundle: str = "bundle") -> Column:
    """Whether a retrieval bundle holds anything worth showing."""
    b = F.col(bundle)
    return F.coalesce(
        (F.size(b["similar_parcels"]) > 0) | (F.size(b["spatial_neighbors"]) > 0) | b["reference_context"].isNotNull(),
        F.lit(False),
    )


def user_message(payload: Column, bundle: str | None = None) -> Column:
    """The request text: the payload alone, or with its retrieved context where there is any."""
    pretty = lambda value: F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})
    plain = F.concat(F.lit("Explain this parcel as JSON:\n\n"), pretty(payload))
    if bundle is None:
        return plain
    b = F.col(bundle)
    notes = F.when(F.size(b["retrieval_notes"]) > 0, b["retrieval_notes"])
    context = F.to_json(
        F.struct(
            b["similar_parcels"].alias("similar_parcels"), b["spatial_neighbors"].alias("spatial_neighbors"),
            b["reference_context"].alias("reference_context"), notes.alias("retrieval_notes"),
        ),
        {"pretty": "true"},
    )
    enriched = F.concat(
        F.lit("Scores and status in parcel_analytics are authoritative:\n\n"),
        pretty(F.struct(payload.alias("parcel_analytics"))),
        F.lit("\n\nRetrieved context, for support only:\n\n"),
        context,
    )
    return F.when(has_content(bundle), enriched).otherwise(plain)


def mock_reply(payload: Column) -> Column:
    """A deterministic reply that follows the contract."""
    flags = payload["data_quality_flags"]
    thin = F.size(flags) > 0
    status = F.when(thin, F.lit("insufficient_data")).otherwise(
        F.coalesce(expected_status(payload["status"]), F.lit("insufficient_data"))
    )
    summary = F.when(status == "insufficient_data", F.lit("Mock reply: too few data for an assessment.")).otherwise(
        F.lit("Mock reply: restates the scores of the payload only.")
    )
    reply = explanation(
        status, summary, F.array(F.lit("Mock hypothesis")), F.lit("low"), F.lit("Review the parcel's metrics by hand."),
        F.array(
            F.concat(F.lit("parcel_id="), payload["parcel_id"]),
            F.concat(F.lit("status="), F.coalesce(payload["status"], F.lit("GRAY"))),
        ),
        F.lit("consistent"),
    )
    return F.to_json(reply)


Generator = Callable[[Iterator[tuple[str, str]], float], Iterator[str]]


def generate_replies(requests: DataFrame, make_generator: Callable[[], Generator], system: str, temperature: float) -> DataFrame:
    """Add `reply` to rows with `parcel_id` and `user`.

    `make_generator` runs once per Python worker and returns `generate(messages, temperature)`, which
    takes (system, user) pairs and yields one text per pair.
    """

    def run(batches):
        generate = make_generator()
        for batch in batches:
            texts = list(generate(((system, u) for u in batch["user"]), temperature))
            yield pd.DataFrame({"parcel_id": batch["parcel_id"], "reply": texts})

    types = dict(requests.dtypes)
    return requests.select("parcel_id", "user").mapInPandas(run, f"parcel_id {types['parcel_id']}, reply string")


def explain_parcels(
    payloads: DataFrame,
    make_generator: Callable[[], Generator] | None = None,
    bundles: DataFrame | None = None,
    stored: DataFrame | None = None,
    model: str = "mock",
    profile: str = "mock",
    temperature: float = 0.1,
    retry_temperature: float = 0.35,
    generated_at: str | None = None,
) -> DataFrame:
    """Explanation rows for all payloads.

    Without a generator the mock reply is used. Invalid replies are asked once more at the retry
    temperature, then replaced by the fallback. Rows of `stored` with an unchanged payload are kept.
    Replies are staged: a generator is costly and need not repeat itself, so nothing may run it twice.
    """
    reused = None
    if stored is not None:
        reused, payloads = split_unchanged(payloads, stored)
    if bundles is not None and make_generator is not None:
        whole = bundles.select("parcel_id", F.struct(*[c for c in bundles.columns if c != "parcel_id"]).alias("bundle"))
        payloads = payloads.join(whole, "parcel_id", "left")
    asked = stage(payloads, "explain-payloads")
    with_bundle = "bundle" in asked.columns
    if make_generator is None:
        answered = with_validated(asked.withColumn("reply", mock_reply(F.col("payload"))), "reply", "status", "_e")
    else:
        system = system_prompt(with_context=with_bundle)
        user = user_message(F.col("payload"), "bundle" if with_bundle else None)
        requests = asked.select("parcel_id", "status", user.alias("user"))
        first = stage(generate_replies(requests, make_generator, system, temperature), "explain-replies")
        judged = with_validated(asked.join(first, "parcel_id"), "reply", "status", "_e")
        failed = requests.join(judged.where(F.col("_e").isNull()).select("parcel_id"), "parcel_id", "left_semi")
        second = stage(generate_replies(failed, make_generator, system, retry_temperature), "explain-retries")
        retried = judged.join(second.withColumnRenamed("reply", "_second"), "parcel_id", "left")
        answered = with_validated(retried, "_second", "status", "_e2").withColumn("_e", F.coalesce("_e", "_e2"))
    final = F.coalesce("_e", fallback(F.col("status"), "no valid reply after retry"))
    used = F.col("bundle").isNotNull() if with_bundle else F.lit(False)
    now = F.current_timestamp() if generated_at is None else F.lit(generated_at).cast("timestamp")
    rows = answered.withColumn("_final", final).select(
        "parcel_id",
        F.to_json("_final").alias("explanation_json"),
        F.col("_final.status").alias("llm_status"),
        F.col("_final.confidence").alias("llm_confidence"),
        F.lit(model).alias("llm_model"),
        F.lit(profile).alias("profile"),
        now.alias("generated_at"),
        "payload_hash",
        used.alias("geo_rag_used"),
        (F.to_json("bundle") if with_bundle else F.lit(None).cast("string")).alias("retrieval_json"),
    )
    return rows if reused is None else reused.unionByName(rows)


def explanation_outcomes(explanations: DataFrame) -> DataFrame:
    """Rows per final status and whether the check held."""
    check = F.get_json_object("explanation_json", "$.consistency_check")
    return explanations.groupBy("llm_status", check.alias("consistency_check")).agg(F.count(F.lit(1)).alias("n"))


def with_explanations(scores: DataFrame, explanations: DataFrame) -> DataFrame:
    """Scores with their explanation where there is one."""
    return scores.join(explanations.select("parcel_id", "explanation_json", "llm_status", "llm_confidence"), "parcel_id", "left")
