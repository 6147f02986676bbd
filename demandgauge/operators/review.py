"""Review of open findings: questions, answers as JSON text, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.text import json_object_text
from .pressure import cp_reference
from .quality import OPEN
from .spatial import centroid_join

_FALSE = ["", "false", "0", "0.0", "[]", "{}"]


def json_field(details: Column, name: str) -> Column:
    return F.get_json_object(details, f"$.{name}")


def pending_review(register: DataFrame, connectors: DataFrame, check: str = K.POSTCODE_CHECK) -> DataFrame:
    """Open findings nobody has reviewed yet, with the coordinates of their charge point."""
    waiting = register.where(
        (F.col("check_name") == check) & (F.col("status") == OPEN)
        & json_field(F.col("details"), "ai_reviewed").isNull()
    ).select(F.col("entity_id").alias("cp_id"), "details")
    return waiting.join(cp_reference(connectors, ["latitude", "longitude"]), "cp_id", "left")


def with_question(pending: DataFrame) -> DataFrame:
    """The question to ask about each finding, and a short key of it.

    Charge points of one site give the same text and thereby the same ``question_id``.
    """
    def shown(c: Column, missing: str = "None") -> Column:
        return F.coalesce(c.cast("string"), F.lit(missing))

    d = F.col("details")
    text = F.concat(
        F.lit("Verdict: "), shown(json_field(d, "verdict")),
        F.lit("\nSite: "), shown(json_field(d, "site_name")),
        F.lit("\nRecorded postcode: "), shown(json_field(d, "feed_postcode")),
        F.lit("\nPostcode at the coordinates: "), shown(json_field(d, "coord_postcode")),
        F.lit("\nCoordinates: "), shown(F.col("latitude"), "nan"), F.lit(", "), shown(F.col("longitude"), "nan"),
    )
    return pending.withColumn("question", text).withColumn("question_id", F.sha2("question", 256))


def distinct_questions(asked: DataFrame) -> DataFrame:
    """Each question once."""
    return asked.select("question_id", "question").distinct()


def extract_json(answers: DataFrame, text: str = "text") -> DataFrame:
    """``answer``, the JSON object inside free text; NULL when absent or not valid JSON."""
    found = json_object_text(F.col(text))
    return answers.withColumn("answer", F.when(F.try_parse_json(found).isNotNull(), found))


def merge_suggestions(asked: DataFrame, answers: DataFrame, centroids: DataFrame, model: str) -> DataFrame:
    """(cp_id, details) of the findings that got an answer, details extended by it.

    ``asked`` from :func:`with_question`; ``answers``: question_id, answer (a JSON object as
    text), request_id; ``centroids``: postcode, latitude, longitude.  A postcode is suggested
    only when the answer calls the recorded one wrong; coordinates only when it calls them
    wrong and the given postcode has a centroid.
    """
    a = F.col("answer")

    def truthy(name: str) -> Column:
        return ~F.lower(F.coalesce(json_field(a, name), F.lit(""))).isin(_FALSE)

    usable = answers.where(a.isNotNull() & (F.regexp_replace(a, r"\s", "") != "{}")).select(
        "question_id", "request_id",
        json_field(a, "issue").alias("issue"), json_field(a, "description").alias("description"),
        json_field(a, "correct_postcode").alias("correct_postcode"),
        truthy("postcode_wrong").alias("postcode_wrong"), truthy("coords_wrong").alias("coords_wrong"),
    )
    located = centroid_join(usable, centroids, "correct_postcode")
    given = F.coalesce(F.col("correct_postcode") != "", F.lit(False))
    move = F.col("coords_wrong") & given & F.col("centroid_latitude").isNotNull()
    always = F.to_json(F.struct(
        "issue", "description", "correct_postcode", "postcode_wrong", "coords_wrong",
        F.lit(model).alias("ai_model"), "request_id", F.lit(True).alias("ai_reviewed"),
    ), {"ignoreNullFields": "false"})
    optional = F.to_json(F.struct(
        F.when(F.col("postcode_wrong") & given, F.col("correct_postcode")).alias("suggested_postcode"),
        F.when(move, F.col("centroid_latitude")).alias("suggested_latitude"),
        F.when(move, F.col("centroid_longitude")).alias("suggested_longitude"),
    ))
    extension = located.select("question_id", always.alias("always"), optional.alias("optional"))
    return asked.join(extension, "question_id").select(
        "cp_id", json_merge(F.col("details"), F.col("always"), F.col("optional")).alias("details"))


def json_merge(*objects: Column) -> Column:
    """Top-level union of JSON objects given as text; keys of later objects win."""
    parts = [F.from_json(o, "map<string, variant>") for o in objects]
    merged = parts[0]
    for nxt in parts[1:]:
        keys = F.map_keys(nxt)
        merged = F.map_concat(F.map_filter(merged, lambda k, _: ~F.array_contains(keys, k)), nxt)
    return F.to_json(merged, {"ignoreNullFields": "false"})


def apply_suggestions(register: DataFrame, suggestions: DataFrame, check: str = K.POSTCODE_CHECK) -> DataFrame:
    """The register with the details of the suggested findings replaced."""
    new = suggestions.select(F.col("cp_id").alias("entity_id"), F.col("details").alias("new_details"))
    mine = F.col("check_name") == check
    return register.join(new, "entity_id", "left").withColumn(
        "details", F.when(mine, F.coalesce("new_details", "details")).otherwise(F.col("details"))
    ).select(*register.columns)


def review_queue(register: DataFrame, check: str = K.POSTCODE_CHECK) -> DataFrame:
    """Open findings with the fields a reviewer needs, by verdict."""
    fields = ["verdict", "coord_postcode", "suggested_postcode", "suggested_address", "description"]
    return register.where((F.col("check_name") == check) & (F.col("status") == OPEN)).select(
        F.col("entity_id").alias("cp_id"), "message",
        *[json_field(F.col("details"), f).alias(f) for f in fields],
    ).orderBy("verdict")
