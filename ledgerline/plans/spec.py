"""A project: pairs of tables with their mappings, filters and options, read from JSON. Keys that nothing here knows are errors, so that none is dropped without a word."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from ledgerline.functions.dates import DATE_TYPES, VINTAGES
from ledgerline.operators.mapping import Rule
from ledgerline.sources.readers import Side

# The keys of a project, of a pair and of a side. Notes are kept as they are, and come back with the outcome.
_PROJECT = {"pairs", "metadata", "date_types", "settings"}
_NOTES = {"description", "comment_map", "time_map", "where_map", "diff_map"}
_PAIR = {"left", "right", "col_map", "col_rules", "col_filter", "vintage", "fromDate", "toDate", "excludeDates", "ignore_rows", "ignore_columns", "col_type_overrides", "skip", "mode"} | _NOTES
_SIDE = {"name", "source", "table", "conn_macro", "date_col", "date_type", "date_transform", "vintage", "vintage_transform", "where", "processed", "columns", "options"}
# Whether buckets that the store has are kept (incremental) or profiled again (full).
_MODES = ("incremental", "full")


@dataclass(frozen=True)
class Pair:
    name: str
    left: Side
    right: Side
    col_map: dict[str, str] = field(default_factory=dict)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    vintage: str = "day"
    first: str | None = None
    last: str | None = None
    exclude_dates: list[str] = field(default_factory=list)
    ignore_rows: list[str] = field(default_factory=list)
    ignore_columns: list[str] = field(default_factory=list)
    overrides: dict[str, str] = field(default_factory=dict)
    skip: bool = False
    rules: tuple[Rule, ...] = ()
    mode: str = "incremental"
    notes: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Project:
    """settings: seed (of samples), exact (whether distinct counts of numbers are exact)."""

    pairs: list[Pair]
    metadata: dict = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> Project:
        """Parse and validate; unknown keys, vintages, modes and date types, and sides without a table, are errors."""
        config = json.loads(text)
        _known("the project", config, _PROJECT)
        if not config.get("pairs"):
            raise ValueError("a project needs at least one pair")
        settings = config.get("settings", {})
        _known("settings", settings, {"seed", "exact"})
        kinds = config.get("date_types", {})
        for kind, own in kinds.items():
            _known(f"date_types[{kind!r}]", own, {"label", "category", "format", "date_transform", "parse_to_date"})
            if own.get("category") not in ("date", "number", "string") or not isinstance(own.get("format"), str) or not isinstance(own.get("label"), str):
                raise ValueError(f"date_types[{kind!r}] needs a label, a format and a category (date, number or string)")
        return cls([_pair(n, p, kinds) for n, p in config["pairs"].items()], config.get("metadata", {}), settings)

    def sides(self) -> list[Side]:
        """All sides once each: what pairs share with the same filters and dates is read once, with the columns of all."""
        seen: dict[str, Side] = {}
        for pair in self.pairs:
            if pair.skip:
                continue
            for side in (pair.left, pair.right):
                old = seen.get(side.rows_key)
                both = sorted({*side.columns, *old.columns}) if old and old.columns and side.columns else []
                seen[side.rows_key] = replace(side, columns=both if old else side.columns)
        return list(seen.values())


def side_name(table: str) -> str:
    return re.sub(r"[^a-z0-9_]+", "_", table.lower()).strip("_")


def _known(what: str, d: dict, keys: set[str]) -> None:
    if unknown := sorted(set(d) - keys):
        raise ValueError(f"{what}: unknown keys {', '.join(unknown)}")


def _side(pair: str, which: str, d: dict, kinds: dict) -> Side:
    _known(f"{pair}: {which}", d, _SIDE)
    if not d.get("table") and not d.get("processed"):
        raise ValueError(f"{pair}: {which} has no table")
    if d.get("vintage"):
        _vintage(f"{pair}: {which}", d["vintage"])
    processed = d.get("processed", "")
    kind, transform = _date_type(f"{pair}: {which}", d.get("date_type", "date"), d.get("date_transform", ""), kinds)
    table = f"{d['conn_macro']}.{d['table']}" if d.get("conn_macro") and d.get("source") == "table" else d.get("table", "")
    return Side(
        d.get("name") or side_name(d.get("table", "")) or pair, d.get("source", "parquet"), table, d.get("date_col"), kind, transform, d.get("vintage_transform", ""), d.get("vintage", ""),
        d.get("where", ""), "\n".join(processed) if isinstance(processed, list) else processed, list(d.get("columns", [])), dict(d.get("options", {})),
    )


def _date_type(where: str, kind: str, transform: str, kinds: dict) -> tuple[str, str]:
    """The date type and transform of a side. A type that the project defines (label, category, format, perhaps date_transform or parse_to_date) is one of the known types with its spelling, or is read by its expression."""
    if kind not in kinds:
        return kind, transform
    own = kinds[kind]
    base = {"date": "date", "number": "num"}.get(own["category"])
    if own["category"] == "string":
        base = next((k for k, spelling in DATE_TYPES.items() if spelling == own["format"] and k.startswith("string")), None)
    expression = transform or own.get("parse_to_date") or own.get("date_transform", "")
    if own["category"] == "number" and own["format"] == "YYYYMM":
        base = "num_yyyymm"
    if base is None and not expression:
        raise ValueError(f"{where}: dates of type {kind!r} can't be read: its format {own['format']!r} is none of {', '.join(sorted(set(DATE_TYPES.values())))}, and it has no parse_to_date")
    return base or "string", expression


def _vintage(where: str, vintage: str) -> None:
    if vintage not in (*VINTAGES, "all") and not re.fullmatch(r"sample@\d+", vintage):
        raise ValueError(f"{where}: unknown vintage {vintage!r}")


def _pair(name: str, d: dict, kinds: dict) -> Pair:
    _known(name, d, _PAIR)
    vintage = d.get("vintage") or "day"
    _vintage(name, vintage)
    if d.get("mode", _MODES[0]) not in _MODES:
        raise ValueError(f"{name}: unknown mode {d['mode']!r}; known are {', '.join(_MODES)}")
    left, right = (_side(name, s, d.get(s, {}), kinds) for s in ("left", "right"))
    if (left.vintage or vintage) != (right.vintage or vintage):
        raise ValueError(f"{name}: buckets by {left.vintage or vintage} and by {right.vintage or vintage} can't be compared")
    chosen = d.get("col_filter", {})
    _known(f"{name}: col_filter", chosen, {"include", "exclude"})
    rules = tuple(Rule(r["left"], r["right"], r.get("kind", "wildcard")) for r in d.get("col_rules", []))
    return Pair(
        name, left, right, d.get("col_map", {}), chosen.get("include", []), chosen.get("exclude", []), left.vintage or vintage, d.get("fromDate") or None, d.get("toDate") or None, d.get("excludeDates", []), d.get("ignore_rows", []),
        d.get("ignore_columns", []), d.get("col_type_overrides", {}), bool(d.get("skip")), rules, d.get("mode", _MODES[0]), {k: v for k, v in d.items() if k in _NOTES},
    )
