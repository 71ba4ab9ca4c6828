"""The two end-to-end flows: scan a table, and repair, validate and score it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from mendframe.operators import compare, detect, repair, score, validate
from mendframe.operators.frequency import quoted
from mendframe.operators.profile import TableProfile
from mendframe.session import materialize, materialize_by


@dataclass(frozen=True)
class Scan:
    """A profiled table with the rules learnt from it and its issue table."""

    table: str
    data: DataFrame
    rules: detect.Rules
    issues: DataFrame

    @property
    def profile(self) -> TableProfile:
        return self.rules.profile


@dataclass(frozen=True)
class Outcome:
    """A repaired table with its checks and its score on one level."""

    cleaned: DataFrame
    checks: DataFrame
    score: DataFrame


def scan(
    data: DataFrame,
    table: str,
    id_col: str = "id",
    level: str = "hard",
    references: Mapping[str, DataFrame] | None = None,
    store: bool = False,
    unique_ids: bool = False,
) -> Scan:
    """Profile and detect; `store` writes the table and its issues to the shared folder, in buckets of the id.

    Storing pays off when the issues feed several joins: they are computed
    once, and repairs, diffs, scores and validations join them with the table, and with its repaired versions,
    bucket by bucket.  Ids are stored as longs.  `unique_ids` says that no id is repeated.
    """
    checks = detect.LEVELS[level]
    if store:
        data = materialize_by(with_long_id(data, id_col), id_col, f"{table}_data")
    rules = detect.learn(data, table, id_col, checks)
    issues = detect.detect(data, table, id_col, checks=checks, references=references, rules=rules, unique_ids=unique_ids)
    return Scan(table, data, rules, materialize_by(issues, "row_id", f"{table}_issues") if store else issues)


def scan_tables(tables: Mapping[str, DataFrame], primary: str | None = None, **options) -> Scan:
    """`scan` of one of several tables, the first unless it is named; the others are what its keys refer to."""
    if not tables:
        raise ValueError("no tables to scan")
    name = next(iter(tables)) if primary is None else primary
    if name not in tables:
        raise ValueError(f"no table {name} among {sorted(tables)}")
    others = {other: df for other, df in tables.items() if other != name}
    return scan(tables[name], name, references=others, **options)


def with_long_id(data: DataFrame, id_col: str) -> DataFrame:
    return data.select(*[quoted(c).cast("long").alias(c) if c == id_col else quoted(c) for c in data.columns])


def store_version(scanned: Scan, version: DataFrame, placed: bool = False) -> DataFrame:
    """A repaired version of a stored table, stored in the same buckets."""
    id_col = scanned.profile.id_col
    return materialize_by(with_long_id(version, id_col), id_col, f"{scanned.table}_version", placed=placed)


def clean(
    scanned: Scan,
    level: str = "hard",
    cleaner: Callable[[Scan], DataFrame] | None = None,
    touched: tuple[str, ...] | None = None,
    decoys: DataFrame | None = None,
    log: DataFrame | None = None,
    removed: DataFrame | None = None,
    validated: bool = True,
) -> Outcome:
    """Repair with `cleaner` (all corrections by default), then validate and score.

    The columns that the repair touched are taken from the diff of both tables
    unless they are named.  `decoys`, the action `log`, reported deletions (`removed`) and
    whether the repair was `validated` enter the score.  The cleaned table is stored once: every check and score reads it.
    """
    if cleaner is None:
        cleaned = repair.apply_corrections(scanned.data, scanned.issues, scanned.profile.id_col)
    else:
        cleaned = cleaner(scanned)
    cleaned = store_version(scanned, cleaned)
    if touched is None:
        # one row per column
        diff = compare.cell_diff(scanned.data, cleaned, scanned.profile.id_col)
        touched = tuple(r["column"] for r in diff.select("column").distinct().collect())
    key = scanned.rules.natural_key
    checks = materialize(validate.validate(cleaned, scanned.issues, scanned.profile, key, touched), "checks")
    parts = score.components(
        scanned.data, cleaned, scanned.issues, scanned.profile, key,
        removed=removed, decoys=decoys, log=log, validated=validated, touched=touched, checks=checks,
    )
    return Outcome(cleaned, checks, score.score(level, parts))
