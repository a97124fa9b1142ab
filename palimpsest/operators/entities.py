"""Personal data in texts as spans with offsets: patterns and a tagger together.

A pattern's score rises if one of its context words stands among the ``CONTEXT_WORDS`` words before the match. Of
spans that overlap the one with the higher score stays (then the longer, the earlier, the type that sorts
first).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import CONTEXT_BONUS, CONTEXT_WORDS, ENTITIES, LITERALS, RECOGNISERS, Recogniser
from .tagger import SPANS, Tagger

WORDS = re.compile(r"\w+")
#: Characters before a match in which its ``CONTEXT_WORDS`` words are looked for.
NEAR = 200


def _context(text: str, start: int, words: list[str], window: int) -> bool:
    near = WORDS.findall(text[max(0, start - NEAR) : start].lower())[-window:]
    return any(w in t for t in near for w in words)


def patterns(text: str, recognisers: list[Recogniser], window: int = CONTEXT_WORDS) -> list[tuple[str, float, int, int]]:
    """(type, score, start, stop) of every match."""
    out = []
    for r in recognisers:
        if r.entity in LITERALS and r in RECOGNISERS and LITERALS[r.entity] not in text:
            continue
        for m in re.finditer(r.pattern, text, re.ASCII):
            boost = r.context and _context(text, m.start(), r.context, window)
            out.append((r.entity, min(1.0, r.score + CONTEXT_BONUS) if boost else r.score, *m.span()))
    return out


def settled(spans: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """Spans without overlaps, in order. Runs of spans that touch each other are settled one by one."""
    out: list[tuple[str, float, int, int]] = []
    run: list[tuple[str, float, int, int]] = []
    reach = -1
    for span in [*sorted(spans, key=lambda s: (s[2], s[3])), ("", 0.0, 1 << 62, 1 << 62)]:
        if span[2] >= reach:
            kept: list[tuple[str, float, int, int]] = []
            for one in sorted(run, key=lambda s: (-s[1], s[2] - s[3], s[2], s[0])):
                if all(one[3] <= k[2] or k[3] <= one[2] for k in kept):
                    kept.append(one)
            out += sorted(kept, key=lambda s: s[2])
            run = []
        run.append(span)
        reach = max(reach, span[3])
    return out


def find(texts: list[str | None], recognisers: list[Recogniser], tagger: Tagger | None, window: int = CONTEXT_WORDS, overlaps: bool = False) -> list[list[tuple[str, float, int, int]]]:
    """The settled spans of each text, or with ``overlaps`` all; a null one has none."""
    whole = [t or "" for t in texts]
    tagged = tagger.find(whole) if tagger else [[]] * len(whole)
    settle = sorted if overlaps else settled
    return [settle(patterns(t, recognisers, window) + more) for t, more in zip(whole, tagged, strict=True)]


def spans(df: DataFrame, column: str, tagger: Tagger | None = None, recognisers: list[Recogniser] | None = None, name: str = "entities", window: int = CONTEXT_WORDS, overlaps: bool = False) -> DataFrame:
    """``df`` with ``name``: type, score, start, stop (code points, end excluded) and text of what a text holds.

    The tagger's size is bounded by its training. Row by row: repeated rows stay, a null text has none.
    """
    chosen = RECOGNISERS if recognisers is None else recognisers
    sent = df.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        for texts in batches:
            found = find(texts.tolist(), chosen, model, window, overlaps)
            yield pd.Series([[{"type": k, "score": s, "start": a, "stop": b, "text": t[a:b]} for k, s, a, b in row] for t, row in zip(texts, found, strict=True)], index=texts.index)

    return df.withColumn(name, run(F.col(f"`{column}`").cast("string")))


def detector(tagger: Tagger, recognisers: list[Recogniser] | None = None):
    """A detector for profiles that knows names, too."""
    chosen = RECOGNISERS if recognisers is None else recognisers

    @F.pandas_udf(ENTITIES)
    def run(texts: pd.Series) -> pd.Series:
        found = find(texts.tolist(), chosen, tagger)
        return pd.Series([[{"type": k, "score": s, "text": t[a:b]} for k, s, a, b in row] for t, row in zip(texts, found, strict=True)], index=texts.index)

    def detect(c: Column) -> Column:
        return run(c)

    return detect
