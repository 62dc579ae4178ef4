"""Entities of questions: dictionaries first, intents where they find nothing, then a model for names that no list has."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import spans
from tidemark.operators.scoring import Model, model_entities


def _or_meant(found: str, intents: Mapping[str, Sequence[str]]) -> Column:
    """The terms found; where there are none, those of all intents whose pattern the text holds, each once in any case."""
    if not intents:
        return F.col(found)
    terms = F.array_compact(F.flatten(F.array(*[F.when(F.rlike("text", F.lit("(?iu)" + p)), F.array(*map(F.lit, ts))).otherwise(F.array().cast("array<string>")) for p, ts in intents.items()])))
    low = F.transform(terms, lambda x: F.lower(x))
    once = F.filter(terms, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return F.when(F.size(found) > 0, F.col(found)).otherwise(once)


def question_entities(
    questions: DataFrame, techs: Sequence[str], roles: Sequence[str], companies: Sequence[str], tech_intents: Mapping[str, Sequence[str]], role_intents: Mapping[str, Sequence[str]],
    load: Callable[[], Model], name: str, id_col: str = "id", text_col: str = "text",
) -> DataFrame:
    """(id, technologies, job_titles, companies, locations) of questions with different ids.

    Technologies and titles are those of their dictionaries, in the order of their place, each once in any case; where there
    is none, those of the intents whose pattern the question holds. Companies are those of the dictionary, then the model's
    ORG that are not among them; locations are the model's LOC. A question that the model fails on keeps the rest. Null and
    blank questions have none.
    """
    asked = questions.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = asked.withColumns({"t": spans.phrases("text", techs), "r": spans.phrases("text", roles), "c": spans.phrases("text", companies)})
    found = found.withColumns({"technologies": _or_meant("t", tech_intents), "job_titles": _or_meant("r", role_intents)})
    model = model_entities(asked, load, name).select(F.col("id").alias("i"), "entities")
    both = found.join(model, found.id.eqNullSafe(F.col("i")), "left")
    of = lambda label: F.transform(F.filter(F.coalesce("entities", F.array().cast(model.schema["entities"].dataType)), lambda e: e.label == label), lambda e: e.entity)
    listed = F.transform("c", lambda x: F.lower(x))
    more = F.filter(of("ORG"), lambda x: ~F.array_contains(listed, F.lower(x)))
    return both.select("id", "technologies", "job_titles", F.concat("c", more).alias("companies"), of("LOC").alias("locations"))
