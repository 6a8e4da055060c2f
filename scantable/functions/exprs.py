"""Column expressions: safe casts, names, boxes, scores, labels. All run inside code generation, none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    """A column from its name or itself."""
    return F.col(c) if isinstance(c, str) else c


def safe_double(c: ColumnLike, default: float | None = None) -> Column:
    """The value if it is a finite number, else default. Text is parsed; booleans count 1 and 0."""
    x = col(c).try_cast("double")
    ok = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return ok if default is None else F.coalesce(ok, F.lit(float(default)))


def clamp(c: ColumnLike, low: float, high: float) -> Column:
    """The value between low and high; NULL stays NULL."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def normal_label(c: ColumnLike) -> Column:
    """Lower case, underscores, hyphens and other signs as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", " "))


def contains_words(text: ColumnLike, label: ColumnLike) -> Column:
    """Whether a normalised text has a normalised label as whole words."""
    return F.concat(F.lit(" "), normal_label(text), F.lit(" ")).contains(F.concat(F.lit(" "), normal_label(label), F.lit(" "))) & (normal_label(label) != "")


def slug(c: ColumnLike) -> Column:
    """Letters, digits, dots, hyphens and underscores; runs of others become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...], floor: float | None = None) -> Column:
    """IoU of boxes (x1, y1, x2, y2). Without a floor an empty union gives NULL; with one the union is at least that."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    if floor is None:
        union = area(a) + area(b) - wide * high
        return wide * high / F.nullif(union, F.lit(0.0))
    side = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    return wide * high / F.greatest(side(a) + side(b) - wide * high, F.lit(float(floor)))


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int, pad: float = 0.0, least: float = 1.0) -> list[Column]:
    """A box padded by a share of its size, kept inside the image and at least so many pixels wide and high."""
    px, py = (x2 - x1) * pad, (y2 - y1) * pad
    ax, ay = clamp(x1 - px, 0, width - least), clamp(y1 - py, 0, height - least)
    bx, by = clamp(x2 + px, 0, width), clamp(y2 + py, 0, height)
    return [ax, ay, F.greatest(bx, ax + least), F.greatest(by, ay + least)]


def novelty(covered: Column, iou: Column, coverage: Column) -> Column:
    """How new a candidate is beside what exists: (1 - covered) sqrt(1 - iou) sqrt(1 - coverage), inputs and result in [0, 1]."""
    a, b, c = (clamp(F.coalesce(x, F.lit(0.0)), 0.0, 1.0) for x in (covered, iou, coverage))
    return clamp((1.0 - a) * F.sqrt(1.0 - b) * F.sqrt(1.0 - c), 0.0, 1.0)


def label_factor(consensus: Column, conflict: Column) -> Column:
    """Consensus lessened by half the conflict; 1 without a consensus."""
    value = clamp(consensus, 0.0, 1.0) * (1.0 - 0.5 * clamp(F.coalesce(conflict, F.lit(0.0)), 0.0, 1.0))
    return F.when(consensus.isNull(), F.lit(1.0)).otherwise(value)


def candidate_quality(score: Column, fusion: Column, views: Column, mean_iou: Column, best_iou: Column, covered: Column, iou: Column, area: Column, label: Column) -> Column:
    """Product of eight terms: fusion and detector score, support, consistency, label, novelty, separation, extent.

    Inputs are finite (see safe_double); a missing fusion score is the detector score.
    """
    one = lambda x: F.least(F.lit(1.0), x)
    zero = lambda x: F.greatest(F.lit(0.0), x)
    # fixed values: weights of the terms
    support = 0.45 + 0.55 * one(views / 50.0)
    consistency = 0.35 + 0.45 * one(mean_iou) + 0.20 * one(best_iou)
    new = 1.0 - 0.65 * one(covered)
    apart = 1.0 - 0.35 * one(iou)
    extent = 1.0 - 0.25 * one(area / 0.25)
    return zero(F.coalesce(fusion, score)) * zero(score) * support * consistency * label * new * apart * extent


def calibration(quality_z: Column, new: Column, label: Column, quality_weight: float, novelty_weight: float, label_weight: float, low: float = 0.2, high: float = 1.2) -> Column:
    """Factor on a score from its z-score, novelty and label agreement, between low and high."""
    factor = 1.0 + quality_weight * F.tanh(quality_z / 2.0)
    factor = factor * ((1.0 - novelty_weight) + novelty_weight * new)
    factor = factor * ((1.0 - label_weight) + label_weight * label)
    return clamp(factor, low, high)


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its maximum; an empty array stays empty."""
    # a lambda's argument is computed once, an outer expression once per element
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    shares = lambda e: once(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))
    return once(values, lambda v: once(F.array_max(v), lambda top: once(F.transform(v, lambda x: F.exp(x - top)), shares)))


def token_jaccard(a: ColumnLike, b: ColumnLike) -> Column:
    """Jaccard of the word sets of two names; equal names give 1, an empty one 0."""
    x, y = normal_label(a), normal_label(b)
    s, t = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    both = F.size(F.array_intersect(s, t))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(both / (F.size(s) + F.size(t) - both))


def first_reason(rules: list[tuple[str, Column]], default: str) -> Column:
    """Ordered cascade: the name of the first rule that holds; a null condition doesn't hold."""
    out = F
    for name, holds in rules:
        out = out.when(holds, F.lit(name))
    return out.otherwise(F.lit(default)) if rules else F.lit(default)


def all_reasons(rules: list[tuple[str, Column]], separator: str = ";") -> Column:
    """The names of all rules that hold, in order, joined; empty text if none does."""
    return F.concat_ws(separator, *[F.when(holds, F.lit(name)) for name, holds in rules])


def rule_lookup(rules: dict[str, float], names: list[Column], default: float) -> Column:
    """Value of the first name that is a key; else of the first key, in the order given, that the first name contains; else default."""
    if not rules:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for k, v in rules.items() for x in (k.strip().lower(), float(v))])
    exact = [F.element_at(table, F.lower(F.coalesce(n, F.lit("")))) for n in names]
    inside = [F.when(F.lower(F.coalesce(names[0], F.lit(""))).contains(k.strip().lower()), F.lit(float(v))) for k, v in rules.items() if k.strip()]
    return F.coalesce(*exact, *inside, F.lit(float(default)))


def parse_rules(text: str | None) -> dict[str, float]:
    """k=v,k:v: malformed entries are left out; a later key replaces an earlier one."""
    out: dict[str, float] = {}
    for item in (text or "").split(","):
        sign = "=" if "=" in item else ":"
        key, found, value = item.partition(sign)
        try:
            if found and key.strip():
                out[key.strip().lower()] = float(value)
        except ValueError:
            continue
    return out


def parse_list(text: str | None) -> list[str] | None:
    """Comma list without blanks; None for a blank text: no filter."""
    return [x.strip() for x in (text or "").split(",") if x.strip()] or None
