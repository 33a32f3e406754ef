"""Which left column is which right column. Schemas are small, so this runs on lists of names; match_frames() is for many tables at once."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Matched:
    mapping: dict[str, str]
    left_only: list[str]
    right_only: list[str]


def match_columns(left: list[str], right: list[str], existing: dict[str, str] | None = None, replace: bool = False) -> Matched:
    """Same names but for case are mapped; an existing mapping wins unless it is to be replaced."""
    by_lower = {r.lower(): r for r in right}
    found = {c: by_lower[c.lower()] for c in left if c.lower() in by_lower}
    mapping = found if replace else found | {k: v for k, v in (existing or {}).items() if k in left and v in right}
    used = set(mapping.values())
    return Matched(dict(sorted(mapping.items())), sorted(c for c in left if c not in mapping), sorted(c for c in right if c not in used))


def match_frames(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_col, right_col, status) of two frames (column_name): matched, left_only, right_only."""
    lhs = left.select(F.col("column_name").alias("left_col"), F.lower("column_name").alias("k"))
    rhs = right.select(F.col("column_name").alias("right_col"), F.lower("column_name").alias("k"))
    status = F.when(F.col("right_col").isNull(), "left_only").when(F.col("left_col").isNull(), "right_only").otherwise("matched")
    return lhs.join(rhs, "k", "full_outer").select("left_col", "right_col", status.alias("status"))


_EITHER = re.compile(r"\([^()|]*(?:\|[^()|]*)+\)")
_WILD = re.compile(rf"(\*|{_EITHER.pattern})")


@dataclass(frozen=True)
class Rule:
    """wildcard: `*` on the left stands for any text, what the first one held replaces every `*` on the right; `(a|b)` on the left stands for either,
    and the `(A|B)` at the same place on the right gives the partner of the one found. regex: groups."""

    left: str
    right: str
    kind: str = "wildcard"

    def apply(self, name: str) -> str | None:
        if self.kind == "regex":
            try:
                m = re.fullmatch(self.left, name, re.IGNORECASE)
                return m.expand(self.right) if m else None
            except (re.error, IndexError):
                return None
        if "*" not in self.left and not _EITHER.search(self.left):
            return self.right if name == self.left else None
        parts = _WILD.split(self.left)  # texts and wildcards by turns
        m = re.fullmatch("".join(f"({'.*' if p == '*' else '|'.join(map(re.escape, p[1:-1].split('|')))})" if i % 2 else re.escape(p) for i, p in enumerate(parts)), name, re.IGNORECASE)
        return self._written(parts[1::2], list(m.groups())) if m else None

    def _written(self, wild: list[str], held: list[str]) -> str | None:
        """The right side for what each wildcard of the left held; None where the two sides' alternatives don't pair."""
        star = next((h for w, h in zip(wild, held, strict=True) if w == "*"), "*")
        found = [[x.lower() for x in w[1:-1].split("|")].index(h.lower()) for w, h in zip(wild, held, strict=True) if w != "*"]
        places = [(len(w.split("|")), at) for w, at in zip((w for w in wild if w != "*"), found, strict=True)]
        own = _EITHER.findall(self.right)
        if own and [len(o.split("|")) for o in own] != [n for n, _ in places]:
            return None
        picks = iter([at for _, at in places])
        return _WILD.sub(lambda m: star if m[0] == "*" else m[0][1:-1].split("|")[next(picks)], self.right)


def apply_rules(rules: list[Rule], left: list[str], right: list[str]) -> dict[str, tuple[str, int]]:
    """left column -> (right column, number of the rule): the first rule that leads to a free right column."""
    free, out = set(right), {}
    for n, rule in enumerate(rules):
        for name in left:
            to = None if name in out else rule.apply(name)
            if to in free:
                out[name] = (to, n)
                free.remove(to)
    return out


def filter_columns(names: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Names that fit an include pattern (none: all) and no exclude pattern; `*` and `?` stand for any text, case does not matter."""
    fits = lambda c, patterns: any(fnmatchcase(c.lower(), p.lower()) for p in patterns)
    return sorted(c for c in names if (not include or fits(c, include)) and not fits(c, exclude or []))


def unmapped_matches(names: list[str], mapping: dict[str, str], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Columns that a filter picks but no mapping has."""
    return [c for c in filter_columns(names, include, exclude) if c not in mapping]


def parse_mapping(text: str) -> dict[str, str]:
    """`A=b, C=d` as a mapping."""
    return {k.strip(): v.strip() for k, _, v in (p.partition("=") for p in text.split(",")) if k.strip() and v.strip()}


def pick_mapping(pair: tuple[str, str], stored: dict[tuple[str, str], dict[str, str]], override: dict[str, str] | None = None) -> dict[str, str]:
    """An override, else the pair's, else the reverse pair's turned around, else none."""
    if override:
        return override
    if pair in stored:
        return stored[pair]
    return {v: k for k, v in stored.get(pair[::-1], {}).items()}
