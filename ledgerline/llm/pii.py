"""Personal data by gradient boosting over candidate spans, in DataFrame operations only.

Generators propose spans, which may overlap: the base patterns, whose matches that pass their checks stay whatever the model says; and wider ones for
written-around forms, of which the model selects. Every span gets a few small integer features of its shape and its context, none of which takes part in the base checks. Base matches that pass
their checks are examples of personal data; those that fail, and addresses without a dot, are examples of the contrary. The table of distinct feature vectors, counted over all
documents, is all the boosting needs, and its size is bounded by the features' ranges. Two thirds of the documents give the examples the trees are fitted to, the others those the threshold is
calibrated on. Trees become nested CASE expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import written

KINDS = ["email", "ip", "card", "phone"]

#: (kind, role, pattern, what a text must hold for the pattern to be tried). Runs are taken whole from their first character
#: (\G: or from the last match's end), so that long runs without a match cost linear time.
GENERATORS = [
    ("email", "base", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", "base", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\."),
    ("card", "base", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    ("phone", "base", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]"),
    ("email", "wider", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[](?:at|AT|@)[)\]])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[](?:dot|DOT|\.)[)\]])\x20?[A-Za-z0-9-]++)++", "@|[(\\[](?:at|AT)"),
    ("email", "not", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?@\x20?[A-Za-z0-9-]++(?!\x20?\.[A-Za-z0-9-])", "@"),
    ("ip", "wider", r"(?<![0-9.])[0-9]{1,3}+(?:[(\[]\.[)\]]|\x20\.\x20?|\.\x20)[0-9]{1,3}+(?:[(\[]\.[)\]]|\x20\.\x20?|\.\x20)[0-9]{1,3}+(?:[(\[]\.[)\]]|\x20\.\x20?|\.\x20)[0-9]{1,3}+(?![0-9.])", "[0-9][(\\[\\x20]?\\."),
    ("card", "wider", r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){3}(?![0-9])", "[0-9]{4}"),
    ("phone", "wider", r"(?<![0-9A-Za-z+(.-])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", "[0-9]{3}[\x20.-][0-9]{4}"),
]

#: Words near a span that speak of such data.
_KEYWORDS = r"(?i)mail|contact|tel|phone|call|fax|mobil|card|visa|credit|account|konto|tarjeta|carte|server|host|address|ip\b"
_CONTEXT = 24


def _with_found(docs: DataFrame) -> DataFrame:
    """docs with found: all generators' matches of `text` as (g, i, m, gap, before, after), gap being the characters since the match before."""
    none = F.array().cast("array<string>")
    every = range(len(GENERATORS))
    # matches and the pieces between them are columns of their own: within a lambda they'd be computed anew for each match
    rows = docs
    for g, (_, _, pattern, needs) in enumerate(GENERATORS):
        has = F.col("text").contains(needs) if needs == "@" else F.col("text").rlike(needs)
        rows = rows.withColumn(f"__m{g}", F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    rows = rows.withColumns({f"__p{g}": F.when(F.size(f"__m{g}") > 0, F.split("text", GENERATORS[g][2], -1)).otherwise(none) for g in every})

    def of(g: int) -> Column:
        p = F.col(f"__p{g}")

        def match(x: Column, i: Column) -> Column:
            return F.struct(
                F.lit(g).alias("g"), i.alias("i"), x.alias("m"), F.length(F.get(p, i)).alias("gap"),
                F.right(F.get(p, i), F.lit(_CONTEXT)).alias("before"), F.substring(F.get(p, i + 1), 1, _CONTEXT).alias("after"),
            )

        return F.transform(f"__m{g}", match)

    return rows.select(*docs.columns, F.concat(*map(of, every)).alias("found"))


def _per_generator(value) -> Column:
    """value(kind, role) by the generator that found a span."""
    out = F.lit(None)
    for g, (kind, role, *_) in enumerate(GENERATORS):
        out = F.when(F.col("g") == g, F.lit(value(kind, role))).otherwise(out)
    return out


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (c.cast("int") * (1 + i % 2)).alias("d"))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def spans(found: DataFrame) -> DataFrame:
    """One row per span of found(row, found): row, kind (number), role, valid (a base match that passes its checks), start, end, and the features f_*."""
    rows = found.select("row", F.explode("found").alias("s")).select("row", "s.*")
    m, digits = F.col("m"), F.regexp_replace("m", "[^0-9]", "")
    n = F.length(digits)
    octets = ~m.rlike(r"(?:^|[^0-9])0*(?:25[6-9]|2[6-9][0-9]|[3-9][0-9][0-9]|[1-9][0-9]{3,})(?:$|[^0-9])")
    card = F.when(n.between(16, 19), _luhn(digits)).otherwise(False)
    kind, role = _per_generator(lambda k, _: KINDS.index(k)), _per_generator(lambda _, r: r)
    valid = (role == "base") & F.when(kind == 0, True).when(kind == 1, octets).when(kind == 2, card).otherwise(n.between(8, 15))

    def beside(c: Column) -> Column:
        return F.when(c.rlike(r"^[0-9]"), 3).when(c.rlike(r"^\p{L}"), 2).when(c.rlike(r"^[._@/=-]"), 1).otherwise(0)

    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: F.length(g) > 0)
    sizes = F.transform(groups, lambda g: F.length(g))
    sign = F.regexp_extract(m, r"[0-9]([^0-9]+)[0-9]", 1)
    features = {
        "kind": kind,
        "groups": F.least(F.lit(6), F.size(groups)),
        "longest": F.least(F.lit(7), F.coalesce(F.array_max(sizes), F.lit(0))),
        "equal": (F.size(F.array_distinct(sizes)) == 1).cast("int"),
        "sign": F.when(sign == "", 0).when(sign == " ", 1).when(sign == "-", 2).when(sign == ".", 3).otherwise(4),
        "before": beside(F.right("before", F.lit(1))),
        "after": beside(F.substring("after", 1, 1)),
        "hint": (F.col("before").rlike(_KEYWORDS) | F.col("after").rlike(_KEYWORDS)).cast("int"),
    }
    running = Window.partitionBy("row", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length(m)).over(running)
    rows = rows.withColumns({"kind": kind, "role": role, "valid": valid, "end": end, "start": end - F.length(m)} | {f"f_{k}": v.cast("int") for k, v in features.items()})
    return rows.select("row", "kind", "role", "valid", "start", "end", *[f"f_{k}" for k in features])


FEATURES = ["f_kind", "f_groups", "f_longest", "f_equal", "f_sign", "f_before", "f_after", "f_hint"]


@dataclass
class Boosted:
    """Boosted trees of depth 2: (feature, cut, (feature, cut, left, right) below, the same above); and the threshold of selection, with the precision and the recall that the
    examples it was calibrated on have there."""

    trees: list
    start: float
    threshold: float
    precision: float = 0.0
    recall: float = 0.0

    def score(self) -> Column:
        def leaf(side) -> Column:
            f, cut, low, high = side
            return F.when(F.col(f) <= cut, low).otherwise(high)

        total = F.lit(self.start)
        for f, cut, low, high in self.trees:
            total = total + F.when(F.col(f) <= cut, leaf(low)).otherwise(leaf(high))
        return 1 / (1 + F.exp(-total))


def boost(table: list[tuple[tuple[int, ...], int, int, int, int]], rounds: int = 40, rate: float = 0.3, precision: float = 0.99) -> Boosted:
    """Fit to (feature values, positives, negatives, and the same of the documents held out). The threshold is the least score from which on the held-out examples' precision
    is at least `precision`. Without examples of both kinds, or where that precision isn't reached, nothing is selected."""
    x = np.array([r[0] for r in table], np.int64).reshape(len(table), len(FEATURES))
    pos, neg, held_pos, held_neg = (np.array([r[k] for r in table], float) for k in (1, 2, 3, 4))
    if not pos.sum() or not neg.sum():
        return Boosted([], 0.0, 2.0)
    start = log(pos.sum() / neg.sum())
    logit, trees = np.full(len(table), start), []

    def best(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, int, float, float]:
        """(gain, feature, cut, value up to the cut, value above)."""
        g, h = grad[rows].sum(), hess[rows].sum()
        top = (0.0, 0, 1 << 30, rate * g / (h + 1), 0.0)
        for j in range(x.shape[1]):
            low_g, low_h = (np.cumsum(np.bincount(x[rows, j], of[rows]))[:-1] for of in (grad, hess))
            gain = low_g**2 / (low_h + 1) + (g - low_g) ** 2 / (h - low_h + 1) - g * g / (h + 1)
            if gain.size and gain.max() > top[0] + 1e-9:
                c = int(gain.argmax())
                top = (float(gain[c]), j, c, float(rate * low_g[c] / (low_h[c] + 1)), float(rate * (g - low_g[c]) / (h - low_h[c] + 1)))
        return top

    every = np.arange(len(table))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        grad, hess = pos - (pos + neg) * p, (pos + neg) * p * (1 - p)
        _, j, c, *_ = best(every, grad, hess)
        sides = []
        for side in (every[x[:, j] <= c], every[x[:, j] > c]):
            _, k, d, low, high = best(side, grad, hess)
            sides.append((FEATURES[k], d, float(low), float(high)))
            logit[side] += np.where(x[side, k] <= d, low, high)
        trees.append((FEATURES[j], c, *sides))
    out, good, bad = Boosted(trees, start, 2.0), 0.0, 0.0
    for z in np.unique(logit)[::-1]:  # vectors of one score are selected together
        at = logit == z
        good, bad = good + held_pos[at].sum(), bad + held_neg[at].sum()
        if good and good >= precision * (good + bad):
            out.threshold, out.precision, out.recall = float(1 / (1 + np.exp(-z)) - 1e-9), good / (good + bad), good / held_pos.sum()
    return out


def learnt(every: DataFrame, precision: float = 0.99) -> Boosted:
    """The model of spans(): a third of the rows, by a hash of their number, is held out for the threshold."""
    held = F.pmod(F.xxhash64("row"), F.lit(3)) == 0
    count = lambda c: F.sum(c.cast("long"))
    examples = every.where("role <> 'wider'").groupBy(*FEATURES).agg(*[count(c).alias(n) for n, c in (("p", F.col("valid") & ~held), ("n", ~F.col("valid") & ~held), ("hp", F.col("valid") & held), ("hn", ~F.col("valid") & held))])
    return boost(sorted((tuple(r[f] for f in FEATURES), r.p, r.n, r.hp, r.hn) for r in examples.collect()), precision=precision)


def selected_spans(found: DataFrame, precision: float = 0.99) -> DataFrame:
    """(row, kind, base, start, end) of all redactions: base matches that pass their checks, and what the model selects beside them."""
    every = spans(found)
    model = learnt(every, precision)
    kept = every.withColumn("sure", F.col("valid")).where(F.col("sure") | ((F.col("role") == "wider") & (model.score() >= model.threshold)))
    # a span beside the base ones goes where it overlaps one of them
    earlier = Window.partitionBy("row").orderBy("start", F.desc("sure")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row").orderBy(F.desc("start"), "sure").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumns({"reach": F.max(F.when(F.col("sure"), F.col("end"))).over(earlier), "next": F.min(F.when(F.col("sure"), F.col("start"))).over(later)})
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return kept.where(F.col("sure") | free).select("row", "kind", F.col("sure").alias("base"), "start", "end").distinct()


def _scanned(docs: DataFrame) -> DataFrame:
    """(kept, row, found): docs, written once with numbered rows and all generators' matches: the texts are searched once."""
    numbered = docs.select("text", F.struct(*docs.columns).alias("kept"), F.monotonically_increasing_id().alias("row"))
    return written(_with_found(numbered).select("kept", "row", "found"), "pii")


def find_pii(docs: DataFrame, precision: float = 0.99) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for every row of docs(doc_id, text).

    base and spans: arrays of (kind, start, end) in code points, end exclusive, in order of kind and start; the counts are those of base.
    Null and empty texts have none; repeated rows are all returned; long texts are searched whole.
    """
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = written(_with_found(numbered).select("doc_id", "row", "found"), "pii")
    marks = selected_spans(found, precision).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("spans"))
    out = found.select("row", "doc_id").join(marks, "row", "left").withColumn("spans", F.coalesce("spans", F.expr("filter(array(struct(0 kind,0L start,0L end,true base)), x -> false)")))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    return out.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], base.alias("base"), "spans")


def written_out(spans_column: str) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, precision: float = 0.99) -> DataFrame:
    """docs with <EMAIL>, <IP>, <CARD> or <PHONE> in place of every span found in text; overlapping spans become one. Rows without a
    span are unchanged, and their texts are not shuffled."""
    found = _scanned(docs)
    far = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    cuts = selected_spans(found, precision).withColumn("since", F.coalesce(F.max("end").over(far), F.lit(0))).where("end > since")
    cuts = cuts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "since", "kind"))).alias("cuts"))
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def part(c: Column) -> Column:
        gap = F.col("kept.text").substr((c["since"] + 1).cast("int"), F.greatest(F.lit(0), c["start"] - c["since"]).cast("int"))
        return F.concat(gap, F.when(c["start"] >= c["since"], F.get(tags, c["kind"])).otherwise(""))

    last = F.element_at("cuts", -1)["end"]
    text = F.when(F.col("cuts").isNull(), F.col("kept.text")).otherwise(F.concat(F.array_join(F.transform("cuts", part), ""), F.col("kept.text").substr((last + 1).cast("int"), F.length("kept.text"))))
    some = found.where("size(found) > 0").join(cuts, "row", "left").select(F.col("kept").withField("text", text).alias("kept"))
    return found.where("size(found) = 0").select("kept").unionAll(some).select("kept.*")
