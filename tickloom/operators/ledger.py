"""Hash-chained evidence ledgers: build, continue, verify, summarise."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tickloom.operators.fold import keyed_fold
from tickloom.sources.readers import PROVENANCE

GENESIS = "0" * 64


def canonical_json(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def record_hash(record: dict) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in record.items() if k != "record_hash"}).encode()).hexdigest()


def build_ledger(rows: DataFrame, ledger: str, order: list[str], payload: list[str], session: str = "session-1", heads: DataFrame | None = None) -> DataFrame:
    """Adds ledger_index, previous_record_hash, record_hash and value (the line); ledgers run side by side.

    Records hold the payload, the provenance constants and the session id. `heads` (ledger, ledger_index, record_hash) continues
    existing chains. Payload columns must be strings or whole numbers, with names that the record does not reserve.
    """
    if not session.strip():
        raise ValueError("a session id is required")
    fixed = PROVENANCE | {"recorder_session_id": session, "ledger_version": "1.0", "ledger_algorithm": "sha256"}
    if taken := sorted(set(payload) & {*fixed, "ledger_index", "previous_record_hash", "record_hash"}):
        raise ValueError(f"reserved columns: {taken}")
    if heads is not None:
        rows = rows.join(heads.select(ledger, F.col("ledger_index").alias("_index"), F.col("record_hash").alias("_hash")), ledger, "left")
    else:
        rows = rows.withColumn("_index", F.lit(None).cast("long")).withColumn("_hash", F.lit(None).cast("string"))

    def step(state, row):
        if state is None:
            state = (-1 if row["_index"] is None else int(row["_index"]), row["_hash"] or GENESIS)
        index, previous = state[0] + 1, state[1]
        record = {c: row[c] for c in payload} | fixed | {"ledger_index": index, "previous_record_hash": previous}
        own = record_hash(record)
        return (index, own), (index, previous, own, canonical_json(record | {"record_hash": own}))

    added = {"ledger_index": "long", "previous_record_hash": "string", "record_hash": "string", "value": "string"}
    return keyed_fold(rows, [ledger], order, step, added).drop("_index", "_hash")


def continue_ledger(lines: DataFrame, rows: DataFrame, ledger: str, line: str, order: list[str], payload: list[str], session: str) -> DataFrame:
    """New records after existing lines, whose chains are verified first: a broken one stops the job."""
    known = summary(verify_ledger(lines, ledger, line), ledger, line)
    head = F.when(F.col("verified"), F.col("head_hash")).otherwise(F.raise_error(F.concat(F.lit("broken ledger: "), F.col(ledger).cast("string"))))
    return build_ledger(rows, ledger, order, payload, session, known.select(ledger, (F.col("records") - 1).alias("ledger_index"), head.alias("record_hash")))


_FIELDS = ("ledger_version", "ledger_algorithm", *PROVENANCE, "recorder_session_id", "previous_record_hash", "record_hash")
_PARSED = StructType([StructField("ledger_index", LongType()), *[StructField(c, StringType()) for c in ("own", *_FIELDS)]])


@F.pandas_udf(_PARSED)
def parse_record(values: pd.Series) -> pd.DataFrame:
    """The chain fields of ledger lines and the record's own hash in canonical form; all null where a line is no JSON object."""
    rows = []
    for value in values:
        try:
            record = json.loads(value)
        except (TypeError, ValueError):
            record = None
        if not isinstance(record, dict):
            rows.append([None] * (2 + len(_FIELDS)))
            continue
        index = record.get("ledger_index")
        rows.append([index if type(index) is int else None, record_hash(record), *(x if isinstance(x := record.get(c), str) else None for c in _FIELDS)])
    out = pd.DataFrame(rows, columns=["ledger_index", "own", *_FIELDS])
    return out.assign(ledger_index=out["ledger_index"].astype("Int64"))


def verify_ledger(lines: DataFrame, ledger: str, line: str) -> DataFrame:
    """Each line's first violation, null where sound. Lines are judged side by side; white space and key order do not matter.

    In order: JSON object, version, algorithm, index, provenance, session id, form and value of the previous hash, form and value
    of the own hash.
    """
    w = Window.partitionBy(ledger).orderBy(line)
    rows = lines.select(ledger, line, "value", parse_record("value").alias("r"))
    rows = rows.withColumn("_expected", F.coalesce(F.lag("r.record_hash").over(w), F.lit(GENESIS))).withColumn("_position", F.row_number().over(w) - 1)
    r = lambda name: F.col(f"r.{name}")
    sound = lambda name: F.coalesce(r(name).rlike("^[0-9a-f]{64}$"), F.lit(False))
    reason = (
        F.when(r("own").isNull(), "not a record").when(~r("ledger_version").eqNullSafe("1.0"), "version").when(~r("ledger_algorithm").eqNullSafe("sha256"), "algorithm")
        .when(~r("ledger_index").eqNullSafe(F.col("_position")), "index")
    )
    for name, value in PROVENANCE.items():
        reason = reason.when(~r(name).eqNullSafe(value), name)
    reason = (
        reason.when(F.coalesce(F.trim(r("recorder_session_id")), F.lit("")) == "", "recorder_session_id")
        .when(~sound("previous_record_hash"), "previous_record_hash form").when(r("previous_record_hash") != F.col("_expected"), "previous_record_hash mismatch")
        .when(~sound("record_hash"), "record_hash form").when(r("record_hash") != r("own"), "record_hash mismatch")
    )
    return rows.select(ledger, line, "value", r("record_hash").alias("record_hash"), r("recorder_session_id").alias("session"), reason.alias("violation"))


def first_violation(verified: DataFrame, ledger: str, line: str) -> DataFrame:
    bad = verified.filter("violation IS NOT NULL")
    return bad.groupBy(ledger).agg(F.min(line).alias("line"), F.min_by("violation", line).alias("violation"))


def summary(verified: DataFrame, ledger: str, line: str) -> DataFrame:
    """Records, head hash, sorted session ids and whether every line is sound."""
    return verified.groupBy(ledger).agg(F.count("*").alias("records"), F.max_by("record_hash", line).alias("head_hash"), F.array_sort(F.collect_set("session")).alias("sessions"), (F.count("violation") == 0).alias("verified"))
