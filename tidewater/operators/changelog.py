"""Change logs: decode, upsert payload, latest state, batches, load encoding, target tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE = "db string, table string, operator_type string, pos bigint, before map<string,string>, after map<string,string>"


def decode(df: DataFrame, json: str) -> DataFrame:
    """Change records from JSON; records that are no change (schema history, garbage) go."""
    return df.withColumn("c_", F.from_json(json, CHANGE)).where("c_.operator_type is not null").select("*", "c_.*").drop("c_")


def route(df: DataFrame, json: str) -> tuple[DataFrame, DataFrame]:
    """(change records decoded, schema history as ``history`` text): one source, two outputs."""
    history = F.get_json_object(json, "$.historyRecord")
    return decode(df.where(history.isNull()), json), df.withColumn("history", history).where("history is not null")


STARTUP = ("initial", "earliest", "latest", "timestamp", "specific-offset")


def started(df: DataFrame, mode: str, position: Column, op: Column, at: Column | None = None, start: int | None = None, now: int | None = None) -> DataFrame:
    """The records of a change log that a reader gets which starts in ``mode``.

    initial: the snapshot (operation r) and all that follows. earliest: changes only, from the first.
    latest: from position ``now`` on. timestamp: ``at`` of ``start`` or later. specific-offset: from
    position ``start`` on."""
    if mode not in STARTUP:
        raise ValueError(f"startup must be one of {', '.join(STARTUP)}")
    if mode == "initial":
        return df
    changes = df.where(op != "r")
    if mode == "earliest":
        return changes
    bound = now if mode == "latest" else start
    if bound is None or (mode == "timestamp" and at is None):
        raise ValueError(f"startup {mode} needs {'now' if mode == 'latest' else 'start'}{' and at' if mode == 'timestamp' else ''}")
    return changes.where((at if mode == "timestamp" else position) >= F.lit(bound))


def time_text(kind: str, value: Column, zone: str = "Asia/Shanghai") -> Column:
    """Text of a database time; null stays null.

    DATE: days since 1970, or a date. TIME: microseconds of the day. DATETIME: a wall-clock time, kept.
    TIMESTAMP: an instant, shown in ``zone``."""
    kind = kind.upper()
    if kind == "DATE":
        return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), value.cast("int")), "yyyy-MM-dd")
    if kind == "TIME":
        return F.date_format(F.timestamp_micros(value.cast("long")).cast("timestamp"), "HH:mm:ss")
    if kind == "DATETIME":
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if kind == "TIMESTAMP":
        return F.date_format(F.from_utc_timestamp(value, zone), "yyyy-MM-dd HH:mm:ss")
    return value.cast("string")


def with_defaults(json: str, fields: dict[str, tuple[str, str]]) -> list[Column]:
    """Columns of a record's ``after`` with defaults: name -> (path, default text)."""
    return [F.coalesce(F.get_json_object(json, path), F.lit(default)).alias(name) for name, (path, default) in fields.items()]


def payload(op: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """(image, delete flag): the row after c, u and r, the row before d; nulls are left out."""
    image = F.when(op == "d", before).when(op.isin("c", "u", "r"), after)
    return F.map_filter(image, lambda _, v: v.isNotNull()), F.when(op == "d", 1).otherwise(0)


def latest_state(df: DataFrame, key: str, op: Column, image: list[str], position: str) -> DataFrame:
    """What a table holds after all changes: the last image of each key unless it was deleted."""
    last = df.groupBy(key).agg(F.max_by(F.struct(op.alias("op"), *image), position).alias("r_"))
    return last.where("r_.op <> 'd'").select(key, *[f"r_.{c}" for c in image])


def load_line(columns: list[Column], separator: str = "\x01", null: str = "\\N") -> Column:
    """One row of a bulk load: text of the columns, nulls marked."""
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit(null)) for c in columns])


def create_table(columns: list[tuple[str, str, str]], name: str, key: str, comment: str = "", buckets: int = 1, replicas: int = 1) -> str:
    """DDL of a target table; ``text`` becomes ``string``, comments are kept, single quotes doubled."""
    quoted = [f"  `{c}` {'string' if t.lower() == 'text' else t}" + (f" COMMENT '{note.replace(chr(39), chr(39) * 2)}'" if note else "") for c, t, note in columns]
    body = ",\n".join(quoted)
    return f"CREATE TABLE IF NOT EXISTS `{name}` (\n{body}\n) PRIMARY KEY (`{key}`)\nCOMMENT '{comment}'\nDISTRIBUTED BY HASH (`{key}`) BUCKETS {buckets}\nPROPERTIES ('replication_num' = '{replicas}')"


def create_tables(columns: DataFrame, table: str, place: str, name: str, kind: str, note: str, key: str, buckets: int = 1, replicas: int = 1) -> DataFrame:
    """(table, ddl) from a catalogue with a row for each column; ``create_table`` says what a statement is."""
    quote = F.lit("'")
    shown = F.when(F.lower(kind) == "text", F.lit("string")).otherwise(F.col(kind))
    comment = F.when(F.coalesce(F.col(note), F.lit("")) != "", F.concat(F.lit(" COMMENT '"), F.replace(F.col(note), quote, F.lit("''")), quote)).otherwise(F.lit(""))
    line = F.concat(F.lit("  `"), F.col(name), F.lit("` "), shown, comment)
    rows = columns.groupBy(table).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), line.alias("l")))), lambda x: x["l"]), ",\n").alias("body"))
    tail = f"\n) PRIMARY KEY (`{key}`)\nCOMMENT ''\nDISTRIBUTED BY HASH (`{key}`) BUCKETS {buckets}\nPROPERTIES ('replication_num' = '{replicas}')"
    return rows.select(table, F.concat(F.lit("CREATE TABLE IF NOT EXISTS `"), F.col(table), F.lit("` (\n"), F.col("body"), F.lit(tail)).alias("ddl"))
