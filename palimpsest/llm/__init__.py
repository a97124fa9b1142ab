"""Operations for training-data pipelines (deduplication, tokenising, scoring, mixing, archives).

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
