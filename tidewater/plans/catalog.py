"""All queries of the engine's own operators, by name, each beside the SQL that states its result."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Events as a behaviour log, in the SQL dialect of the statements.
LOG = "WITH e AS (SELECT event_id, ts, user_id, event_type AS behavior, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS category_id FROM events)"


def query(sql: str | None):
    """Registers a function of (spark, sf_dir); ``sql`` follows LOG if it starts with a comma or SELECT."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            ORACLE[f.__name__] = f"{LOG}{text}" if text.startswith(",") else f"{LOG} {text}"
        return f

    return add


def _load() -> None:
    from . import batch, more  # noqa: F401  register their queries


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
