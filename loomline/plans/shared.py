"""The registry of the core's queries."""

from __future__ import annotations

from loomline.plans.registry import Registry

REGISTRY = Registry()


#: DuckDB for ``strip`` of a column.
STRIP = r"regexp_replace({}, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g')"


def topic_sql(c: str = "topic") -> str:
    """DuckDB for ``topic_key`` of a column."""
    key = f"lower(translate({STRIP.format(f"coalesce({c}, '')")}, '- ', '__'))"
    return f"CASE WHEN contains({key}, 'distill') THEN 'knowledge_distillation' WHEN contains({key}, 'agent') THEN 'ai_agent' WHEN contains({key}, 'rag') THEN 'rag' ELSE {key} END"
