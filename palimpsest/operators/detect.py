"""Personal data in free text: recognisers by pattern, and a plug for named-entity models.

Entities are arrays of (type, score, text). Patterns are JVM expressions; a model is a function from texts
to entities that runs on Arrow batches. A detector that isn't there leaves columns "unmeasured" (-1).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.6
#: Kinds of entity that don't make a text sensitive.
IGNORED = ("DATE_TIME", "ORGANIZATION", "NRP", "URL")
#: What a context word near a match adds to its score.
CONTEXT_BONUS = 0.35
#: How many words before a match are its context.
CONTEXT_WORDS = 5
ENTITIES = "array<struct<type:string,score:double,text:string>>"


@dataclass
class Recogniser:
    """A pattern for one kind of entity; words that begin like one of ``context`` shortly before it raise the score."""

    entity: str
    pattern: str
    score: float
    context: list[str] = field(default_factory=list)


# Patterns, scores and context words of the entities looked for.
RECOGNISERS = [
    Recogniser("EMAIL_ADDRESS", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", 1.0),
    Recogniser("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", 0.6),
    Recogniser("URL", r"\bhttps?://[^\s<>\"]+", 0.6),
    Recogniser("CREDIT_CARD", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", 0.3, ["card", "visa", "карта", "карты"]),
    Recogniser("PHONE_NUMBER", r"\+7\d{10}", 0.85, ["телефон", "тел", "звонить", "перезвонить", "моб"]),
    Recogniser("PHONE_NUMBER", r"\b8\d{10}\b", 0.6, ["телефон", "тел", "звонить", "перезвонить", "моб"]),
    Recogniser("RU_INN", r"\b\d{12}\b", 0.5, ["инн", "налогоплательщик"]),
    Recogniser("RU_INN", r"\b\d{10}\b", 0.35, ["инн", "налогоплательщик"]),
    Recogniser("RU_SNILS", r"\b\d{3}-\d{3}-\d{3}\s\d{2}\b", 0.9, ["снилс", "пенсионн"]),
    Recogniser("RU_PASSPORT", r"\b\d{4}\s\d{6}\b", 0.6, ["паспорт", "серия", "номер"]),
]

#: What stands in every match of these recognisers, by kind: texts without it are not searched.
LITERALS = {"EMAIL_ADDRESS": "@", "URL": "://", "RU_SNILS": "-"}


def entities(c: Column, recognisers: list[Recogniser] | None = None) -> Column:
    """Entities that patterns find in a text; none in a null one.

    Context counts for all matches of a pattern in a text once it stands before one of them; ``entities.spans``
    tells matches apart and gives their places.
    """
    found = []
    for r in RECOGNISERS if recognisers is None else recognisers:
        score = F.lit(r.score)
        if r.context:
            # a context word among the few words before a match
            near = F.lower(c).rlike(rf"(?U:(?:{'|'.join(r.context)})\w*\W+(?:\w+\W+){{0,{CONTEXT_WORDS - 1}}})(?:{r.pattern})")
            score = F.when(near, F.lit(min(1.0, r.score + CONTEXT_BONUS))).otherwise(score)
        texts = F.regexp_extract_all(c, F.lit(f"({r.pattern})"), F.lit(1))
        if r.entity in LITERALS and r in RECOGNISERS:
            texts = F.when(c.contains(LITERALS[r.entity]), texts)
        found.append(F.coalesce(_entities_of(texts, r.entity, score), F.array().cast(ENTITIES)))
    return F.coalesce(F.concat(*found), F.array().cast(ENTITIES))


def _entities_of(texts: Column, kind: str, score: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("type"), score.alias("score"), t.alias("text")))


def relevant(found: Column) -> Column:
    """Entities that count: score of 0.6 or more, and of a kind that names a person."""
    return F.filter(found, lambda e: (e["score"] >= MIN_SCORE) & ~e["type"].isin(*IGNORED))


def hit_share(df: DataFrame, column: str, detector: Callable[[Column], Column] = entities, sample: int = 40) -> float:
    """Share of a column's first ``sample`` different values in which an entity counts; -1 without detector.

    Blank values count as values without entities.
    """
    if detector is None:
        return -1.0
    from .profile import distinct_sample

    values = distinct_sample(df, column, sample)
    hits, n = values.agg(F.count_if(F.size(relevant(detector(F.col("value")))) > 0), F.count("*")).first()
    return hits / n if n else 0.0


def model_detector(find: Callable[[list[str]], list[list[tuple[str, float, str]]]]) -> Callable[[Column], Column]:
    """A detector from a function that finds (type, score, text) in texts, e.g. a named-entity model."""

    @F.pandas_udf(ENTITIES)
    def run(texts: pd.Series) -> pd.Series:
        got = find([t or "" for t in texts])
        return pd.Series([[{"type": k, "score": s, "text": t} for k, s, t in row] for row in got], index=texts.index)

    return run
