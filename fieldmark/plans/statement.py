"""Prepared read-only SQL over a snapshot: ``Catalog(...).prepare(sql).bind(...).all()``."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re
import threading
import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from fieldmark.functions.dialect import grouped_by_too, to_spark
from fieldmark.functions.guard import assert_read_only
from fieldmark.functions.shaping import LIMIT, bounded

#: Bytes of rows after which a reply stops reading.
REPLY_BYTES = 4 * 1024 * 1024
#: Columns that may stand beside the keys of a GROUP BY in one statement.
MOST_KEYS = 64


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    if isinstance(value, dt.datetime | dt.date):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float) and value != value:
        return None
    return value


def _missing(e: AnalysisException) -> str | None:
    return (e.getMessageParameters() or {}).get("expression", "").strip('"') if e.getCondition() == "MISSING_AGGREGATION" else None


@dataclass(frozen=True)
class Statement:
    """A statement with its values; binding gives another statement and replaces all earlier values."""

    spark: SparkSession
    sql: str
    values: tuple = ()
    seconds: float | None = 30.0
    now: str | None = None

    def bind(self, *values: object) -> Statement:
        return replace(self, values=values)

    def frame(self) -> DataFrame:
        """The rows as a DataFrame, unread. Raises where the statement does not only read."""
        assert_read_only(self.sql)
        sql = to_spark(self.sql, self.now).strip().rstrip(";")
        for _ in range(MOST_KEYS):
            try:
                return self._run(sql)
            except AnalysisException as e:
                missing = _missing(e)
                if missing is None:
                    raise
                # a column that depends on the keys of its GROUP BY may stand beside them
                wider = next((w for w in grouped_by_too(sql, missing) if self._other_fault(w) != missing), None)
                if wider is None:
                    raise
                sql = wider
        return self._run(sql)

    def _other_fault(self, sql: str) -> str | None:
        """The column that ``sql`` still lacks among its keys, or None."""
        try:
            self._run(sql)
        except AnalysisException as e:
            return _missing(e) or str(e)
        return None

    def _run(self, sql: str) -> DataFrame:
        if re.search(r"(?<![\w:]):p\d+", sql):
            return self.spark.sql(sql, args={f"p{k}": v for k, v in enumerate(self.values, 1) if re.search(rf":p{k}\b", sql)})
        return self.spark.sql(sql, args=list(self.values)) if self.values else self.spark.sql(sql)

    def all(self) -> dict:
        """``results`` (rows as dicts, up to REPLY_BYTES), ``success``, and ``meta`` with the number of
        rows read and whether reading stopped short. Rows arrive partition by partition, so that a
        result of any size needs the memory of one."""
        rows, used, short = [], 0, False
        tag = f"fieldmark-{uuid.uuid4().hex}"
        self.spark.addTag(tag)
        timer = threading.Timer(self.seconds, lambda: self.spark.interruptTag(tag)) if self.seconds else None
        if timer:
            timer.daemon = True
            timer.start()
        try:
            for row in self.frame().toLocalIterator():
                plain = _plain(row.asDict(recursive=True))
                used += len(json.dumps(plain, default=str))
                if used > REPLY_BYTES:
                    short = True
                    break
                rows.append(plain)
        finally:
            if timer:
                timer.cancel()
            self.spark.removeTag(tag)
        return {"results": rows, "success": True, "meta": {"rows_read": len(rows), "stopped_short": short}}

    def first(self) -> dict | None:
        """The first row, or None; the limit reaches the plan."""
        got = self.frame().limit(1).collect()
        return _plain(got[0].asDict(recursive=True)) if got else None

    def text(self, limit: int = LIMIT) -> str:
        """The rows as indented JSON of at most ``limit`` characters."""
        return json.dumps(bounded(self.all()["results"], limit), indent=2, ensure_ascii=False, default=str)


class Catalog:
    """The tables of one immutable snapshot directory, as views under their own names. ``now``: what
    'now' means in its statements."""

    def __init__(self, spark: SparkSession, directory: str, tables: tuple[str, ...], now: str | None = None):
        self.spark, self.now = spark, now
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        for name in tables:
            spark.read.parquet(f"{directory}/{name}.parquet").createOrReplaceTempView(name)

    def prepare(self, sql: str) -> Statement:
        return Statement(self.spark, sql, now=self.now)

    def query(self, sql: str, *values: object) -> dict:
        return self.prepare(sql).bind(*values).all()

    def query_first(self, sql: str, *values: object) -> dict | None:
        return self.prepare(sql).bind(*values).first()

    def batch(self, statements: list[Statement]) -> list[dict]:
        """Several statements on one snapshot: its files never change, so all see the same rows."""
        return [s.all() for s in statements]
