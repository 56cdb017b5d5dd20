"""SQL scripts: statements one after the other, over registered tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import connectors, sinks


def statements(script: str) -> list[str]:
    """The statements of a script; semicolons in quotes and in comments do not end one."""
    out, held, quote, k = [], [], "", 0
    while k < len(script):
        c = script[k]
        if quote:
            held.append(c)
            quote = "" if c == quote else quote
        elif script.startswith("--", k):
            end = script.find("\n", k)
            k = len(script) if end < 0 else end
            continue
        elif c in "'\"`":
            quote = c
            held.append(c)
        elif c == ";":
            out.append("".join(held).strip())
            held = []
        else:
            held.append(c)
        k += 1
    out.append("".join(held).strip())
    return [s for s in out if s]


_CREATE = re.compile(r"(?is)^create\s+table\s+(\w+)\s*\((.*)\)\s*with\s*\((.*)\)\s*$")
_INSERT = re.compile(r"(?is)^insert\s+into\s+(\w+)\s*(?:\(([^()]*)\)\s*)?(select\b.*|with\b.*)$")
_TYPES = {"varchar": "string", "timestamp(3)": "timestamp"}


def table_options(text: str) -> dict[str, str]:
    """``'connector.type' = 'jdbc', …`` as a dictionary; a doubled quote is a quote."""
    found = re.findall(r"'((?:[^']|'')*)'\s*=\s*'((?:[^']|'')*)'", text)
    return {k.replace("''", "'"): v.replace("''", "'") for k, v in found}


def declared(statement: str) -> tuple[str, str, dict[str, str]] | None:
    """(name, columns, options) of ``CREATE TABLE name (columns) WITH (options)``, or None for another statement."""
    m = _CREATE.match(statement)
    if m is None:
        return None
    columns = ", ".join(" ".join([c.split()[0], *[_TYPES.get(t.lower(), t) for t in c.split()[1:]]]) for c in re.split(r",(?![^(]*\))", m[2]) if c.split() and not re.match(r"(?i)\s*(watermark|primary)\b", c))
    return m[1], columns, table_options(m[3])


def _source(spark: SparkSession, columns: str, options: dict[str, str], stream: bool) -> DataFrame:
    kind, fmt = options.get("connector.type"), options.get("format.type", "json")
    if kind == "filesystem":
        reader = spark.readStream if stream else spark.read
        return reader.schema(columns).format(fmt).load(options["connector.path"])
    if kind == "jdbc":
        return connectors.read_jdbc(spark, options["connector.url"], f"SELECT * FROM {options['connector.table']}")
    if kind == "kafka":
        broker = connectors.BrokerOptions(options["connector.properties.bootstrap.servers"], topic=options["connector.topic"], startup=options.get("connector.startup-mode", "").removesuffix("-offset") or None)
        value = connectors.read_broker(spark, broker, bounded=not stream)
        parsed = F.from_json("value", columns) if fmt == "json" else F.from_csv("value", columns)
        return value.select(parsed.alias("r")).select("r.*")
    raise ValueError(f"no source for connector.type {kind!r}")


def lines(df: DataFrame, fmt: str) -> DataFrame:
    """Rows as lines of JSON or CSV."""
    return df.select((F.to_csv if fmt == "csv" else F.to_json)(F.struct(*df.columns)).alias("value"))


def _sink(df: DataFrame, options: dict[str, str]) -> None:
    kind, fmt = options.get("connector.type"), options.get("format.type", "json")
    if kind == "filesystem":
        df.write.mode("append").format(fmt).save(options["connector.path"])
    elif kind == "jdbc":
        sinks.jdbc(options["connector.url"], options["connector.table"], int(options.get("connector.write.flush.max-rows", "100")))(df, 0)
    elif kind == "kafka":
        rows = sinks.broker_rows(lines(df, fmt), options["connector.topic"], value=F.col("value"))
        sinks.broker(options["connector.properties.bootstrap.servers"])(rows, 0)
    else:
        raise ValueError(f"no sink for connector.type {kind!r}")


def run_script(spark: SparkSession, script: str, tables: dict[str, DataFrame] | None = None, stream: bool = False, **values: str) -> DataFrame | None:
    """Runs a script with ``tables`` as views and ``values`` as named parameters of its statements
    (``:name``); the result of the last statement.

    ``CREATE TABLE … WITH (…)`` declares a source or sink by its options (filesystem, jdbc, kafka) and
    ``INSERT INTO`` it writes there, with or without a list of columns; columns left out are null."""
    known: dict[str, tuple[str, dict[str, str]]] = {}
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    result = None
    for s in statements(script):
        if found := declared(s):
            name, columns, options = found
            known[name.lower()] = (columns, options)
            continue
        args = {k: v for k, v in values.items() if f":{k}" in s} or None
        m = _INSERT.match(s)
        body = m[3] if m else s
        for name, (columns, options) in known.items():
            if re.search(rf"(?i)\b{name}\b", body):
                _source(spark, columns, options, stream).createOrReplaceTempView(name)
        if m and m[1].lower() in known:
            columns, options = known[m[1].lower()]
            target = StructType.fromDDL(columns)
            rows = spark.sql(body, args=args)
            given = [c.strip().lower() for c in m[2].split(",")] if m[2] else [f.name.lower() for f in target]
            if len(given) != len(rows.columns):
                raise ValueError(f"{len(rows.columns)} columns for {len(given)} of {m[1]}")
            rows = rows.toDF(*given)
            result = rows.select(*[(F.col(f.name.lower()) if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])
            _sink(result, options)
        else:
            result = spark.sql(s, args=args)
    return result
