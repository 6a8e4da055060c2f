"""Schemas that drift between files: fingerprints, migration steps, and one consistent table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scantable.common import cut, small_or_not

#: Share of common candidates whose values must be equal for a rename; it must be exceeded.
MOST = 0.5


def parsed_lines(rows: DataFrame) -> DataFrame:
    """(file_id, line_no, cand, v): the lines that are JSON objects, v as VARIANT; cand: the digits of candidate_id, NULL without."""
    lines = rows.select("file_id", "line_no", F.try_parse_json("raw_record").alias("v")).where("v is not null")
    lines = lines.where(F.schema_of_variant("v").startswith("OBJECT"))
    digits = F.regexp_replace(F.expr("try_variant_get(v, '$.candidate_id', 'string')"), r"\D", "")
    return lines.select("file_id", "line_no", F.when(digits != "", digits).alias("cand"), "v")


def json_type(value: Column) -> Column:
    """string, number, boolean, array or object; NULL for null."""
    shape = F.schema_of_variant(value)
    return (
        F.when(shape == "VOID", None).when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean")
        .when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("number")
    )


def parsed_fields(rows: DataFrame) -> DataFrame:
    """(file_id, line_no, cand, field, type, value): one row per member of every line that is a JSON object, see json_type().

    Lines that don't parse give no rows.
    """
    lines = parsed_lines(rows)
    each = lines.lateralJoin(lines.sparkSession.tvf.variant_explode(F.col("v").outer())).select("file_id", "line_no", "cand", F.col("key").alias("field"), "value")
    return each.select("file_id", "line_no", "cand", "field", json_type(F.col("value")).alias("type"), "value")


def comparable() -> Column:
    """Text of a parsed field that is equal for equal values: numbers by value, objects regardless of the order of members."""
    number = F.expr("try_variant_get(value, '$', 'double')").cast("string")
    return F.when(F.col("type") == "number", number).when(F.col("type").isNotNull(), F.to_json("value"))


#: fixed values: JSON types of a field, in the order that settles ties
TYPES = ("array", "boolean", "number", "object", "string")


def file_fields(fields: DataFrame) -> DataFrame:
    """(file_id, field, type): the fields of a file, with the type of most non-null values (the first by name on a tie)."""
    counts = fields.groupBy("file_id", "field").agg(*[F.count_if(F.col("type") == t).alias(t) for t in TYPES])
    most = F.array_min(F.array(*[F.struct((-F.col(t)).alias("n"), F.lit(t).alias("t")) for t in TYPES]))
    return counts.select("file_id", "field", F.when(most["n"] < 0, most["t"]).alias("type"))


def prints(known: DataFrame) -> DataFrame:
    """(file_id, fields, fingerprint): the fields of a file with their types, in order of names, and their hash."""
    fields = F.array_sort(F.collect_list(F.struct("field", "type"))).alias("fields")  # as many as a schema is wide
    return known.groupBy("file_id").agg(fields).withColumn("fingerprint", F.sha2(F.to_json("fields"), 256))


def fingerprints(files: DataFrame, known: DataFrame) -> DataFrame:
    """(file_id, series_name, version, fingerprint, n_fields): version counts the changes of fingerprint in a series from 1."""
    ordered = Window.partitionBy("series_name").orderBy("exported_at", "file_id")
    out = files.select("file_id", "series_name", "exported_at").join(prints(known), "file_id", "left")
    new = F.coalesce((~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(ordered))).cast("int"), F.lit(1))
    out = out.withColumn("__new", new)
    return out.select("file_id", "series_name", F.sum("__new").over(ordered).alias("version"), "fingerprint", F.coalesce(F.size("fields"), F.lit(0)).alias("n_fields"))


def successors(files: DataFrame) -> DataFrame:
    """(file_id, prev_id): each file and the one before it in its series; files without series or export time have none."""
    return _ordered(files).select("file_id", F.lag("file_id").over(Window.partitionBy("series_name").orderBy("exported_at", "file_id")).alias("prev_id")).where("prev_id is not null")


def _ordered(files: DataFrame) -> DataFrame:
    return files.where("series_name is not null and exported_at is not null and file_id is not null").select("file_id", "series_name", "exported_at").distinct()


def version_steps(files: DataFrame, known: DataFrame) -> DataFrame:
    """(file_id, prev_id, gone, came, typed): what a new fingerprint changes against the one of the file before.

    Files with the fingerprint of their predecessor give no row: nothing of them is looked at any more. gone, came and typed
    are arrays of field names; those that bear another type are typed, a field without a value has no type.
    """
    ordered = Window.partitionBy("series_name").orderBy("exported_at", "file_id")
    none = F.array().cast("array<struct<field:string,type:string>>")
    each = _ordered(files).join(prints(known), "file_id", "left").withColumns({"fields": F.coalesce("fields", none), "fingerprint": F.coalesce("fingerprint", F.lit(""))})
    before = {f"prev_{c}": F.lag(c).over(ordered) for c in ("file_id", "fields", "fingerprint")}
    new = each.withColumns(before).where("prev_file_id is not null and fingerprint <> prev_fingerprint")
    names = lambda c: F.transform(c, lambda x: x["field"])
    other = F.filter("fields", lambda x: F.exists("prev_fields", lambda y: (x["field"] == y["field"]) & (x["type"] != y["type"])))
    return new.select("file_id", F.col("prev_file_id").alias("prev_id"), F.array_except(names("prev_fields"), names("fields")).alias("gone"), F.array_except(names("fields"), names("prev_fields")).alias("came"), names(other).alias("typed"))


def renames(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """(file_id, renamed): old_field and new_field of the fields that go on under another name, see schema_changes().

    Only lines of files that lost and gained fields are read again, and only values of those fields are compared: they travel
    once, to their candidate. All fits of a step are then matched best first, in one pass over them.
    """
    torn = steps.where("size(gone) > 0 and size(came) > 0").select(F.col("file_id").alias("pair"), "prev_id", "gone", "came")
    ask = lambda side, fields: F.transform(fields, lambda f: F.struct("pair", F.lit(side).alias("side"), f.alias("field")))
    asks = torn.select(F.col("prev_id").alias("file_id"), ask("old", "gone").alias("w")).union(torn.select(F.col("pair").alias("file_id"), ask("new", "came").alias("w")))
    # a file is asked at most twice: as the one before and as the one after
    asks = cut(asks.groupBy("file_id").agg(F.flatten(F.collect_list("w")).alias("wants")))
    lines = parsed_lines(rows).where("cand is not null").join(small_or_not(asks), "file_id")
    members = lines.select("line_no", "cand", "wants", F.expr("try_variant_get(v, '$', 'map<string,variant>')").alias("m"))
    each = members.select("line_no", "cand", "m", F.explode("wants").alias("w")).select("line_no", "cand", "w.pair", "w.side", "w.field", F.col("m")[F.col("w.field")].alias("value"))
    each = each.where("value is not null").withColumn("type", json_type(F.col("value"))).where("type is not null").withColumn("val", comparable())
    near = each.select("pair", "cand", "side", "field", "line_no", "val").repartition("pair", "cand")
    first = near.groupBy("pair", "cand", "side", "field").agg(F.min_by("val", "line_no").alias("val"))
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("field", "val")))
    met = first.groupBy("pair", "cand").agg(side("old").alias("old"), side("new").alias("new"))
    met = met.select("pair", F.explode("old").alias("o"), "new").select("pair", "o", F.explode("new").alias("n"))
    fits = met.groupBy("pair", F.col("o.field").alias("old_field"), F.col("n.field").alias("new_field")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o.val") == F.col("n.val")).alias("same"))
    fits = fits.where(F.col("same") > F.col("n") * MOST)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("same") / F.col("n")).alias("share"), (-F.col("n")).alias("n"), "old_field", "new_field")))
    nothing = F.array().cast("array<struct<old_field:string,new_field:string>>")

    def take(done: Column, fit: Column) -> Column:
        used = F.exists(done, lambda d: (d["old_field"] == fit["old_field"]) | (d["new_field"] == fit["new_field"]))
        return F.when(used, done).otherwise(F.concat(done, F.array(F.struct(fit["old_field"].alias("old_field"), fit["new_field"].alias("new_field")))))

    return fits.groupBy(F.col("pair").alias("file_id")).agg(ranked.alias("fits")).select("file_id", F.aggregate("fits", nothing, take).alias("renamed"))


def schema_changes(files: DataFrame, rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(file_id, change_kind, old_field, new_field): changes of each file against the one before it in its series.

    added, removed, renamed, type_changed. Each file has a fingerprint, its fields and their types; only where it differs from the
    predecessor's are fields compared. A rename is a field that is gone and a new one whose values are equal for over MOST
    of the candidates that both files have, nulls left out; of several fits the largest share, then the most candidates,
    then the first names win, and each field is used once. A candidate on several lines counts with its first line. Field
    statistics are combined before they are shuffled. known: file_fields() of the rows, if they are there already.
    """
    steps = cut(version_steps(files, file_fields(parsed_fields(rows)) if known is None else known))
    return changes_of(steps, renames(rows, steps))


def changes_of(steps: DataFrame, renamed: DataFrame) -> DataFrame:
    """The migration steps as one row per change."""
    whole = steps.join(small_or_not(cut(renamed)), "file_id", "left")
    whole = whole.withColumn("renamed", F.coalesce("renamed", F.array().cast("array<struct<old_field:string,new_field:string>>")))
    change = lambda kind, old, new: F.struct(F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"))
    rest = lambda fields, side: F.array_except(fields, F.transform("renamed", lambda r: r[side]))
    each = F.concat(
        F.transform("renamed", lambda r: change("renamed", r["old_field"], r["new_field"])), F.transform(rest("gone", "old_field"), lambda f: change("removed", f, F.lit(""))),
        F.transform(rest("came", "new_field"), lambda f: change("added", F.lit(""), f)), F.transform("typed", lambda f: change("type_changed", f, f)),
    )
    return whole.select("file_id", F.explode(each).alias("c")).select("file_id", "c.change_kind", "c.old_field", "c.new_field")


def final_names(files: DataFrame, known: DataFrame, changes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(file_id, field, final_field): the name each field ends up with when the renames of all later files are chained.

    A field of a file points to the field it is in the next file of the series; pointers are doubled until all end.
    """
    nexts = successors(files).select(F.col("prev_id").alias("file_id"), F.col("file_id").alias("next_id"))
    renamed = changes.where("change_kind = 'renamed'").select(F.col("file_id").alias("next_id"), F.col("old_field").alias("field"), "new_field")
    hops = known.select("file_id", "field").join(nexts, "file_id").join(renamed, ["next_id", "field"], "left").withColumn("next_field", F.coalesce("new_field", "field"))
    there = known.select(F.col("file_id").alias("next_id"), F.col("field").alias("next_field"))
    links = hops.join(there, ["next_id", "next_field"], "left_semi").select("file_id", "field", "next_id", "next_field")
    state = cut(known.select("file_id", "field").join(links, ["file_id", "field"], "left").select("file_id", "field", F.coalesce("next_id", "file_id").alias("to_id"), F.coalesce("next_field", "field").alias("to_field")))
    for _ in range(max_rounds):
        step = state.select(F.col("file_id").alias("to_id"), F.col("field").alias("to_field"), F.col("to_id").alias("id2"), F.col("to_field").alias("field2"))
        further = cut(state.join(step, ["to_id", "to_field"]).select("file_id", "field", "to_id", "to_field", "id2", "field2"))
        moved = further.where("to_id <> id2 or to_field <> field2").isEmpty()
        state = further.select("file_id", "field", F.col("id2").alias("to_id"), F.col("field2").alias("to_field"))
        if moved:
            break
    return state.select("file_id", "field", F.col("to_field").alias("final_field"))


#: fixed values: names of the field with the path of the candidate file, by letters only
PATH_NAMES = ("sourcejson", "candidatesourcejson", "sourcepath")


def unified_name(field: Column) -> Column:
    """One spelling per field over all series: snake case, and source_path for all names of the path field."""
    snake = F.regexp_replace(F.lower(F.regexp_replace(field, r"([a-z0-9])([A-Z])", "$1_$2")), r"^_+|_+$", "")
    return F.when(F.regexp_replace(snake, "_", "").isin(*PATH_NAMES), F.lit("source_path")).otherwise(snake)


def alias_classes(known: DataFrame, changes: DataFrame, max_names: int = 10_000) -> dict[str, str]:
    """Unified name -> the name its files use most, over the names that renames of any series link.

    Field names are a vocabulary: at most max_names of them and ten times as many pairs, otherwise ValueError.
    """
    names = known.groupBy(unified_name(F.col("field")).alias("name")).count()
    used = {r.name: r["count"] for r in names.limit(max_names + 1).collect()}
    if len(used) > max_names:
        raise ValueError(f"more than {max_names} field names")
    links = changes.where("change_kind = 'renamed'").select(unified_name(F.col("old_field")).alias("a"), unified_name(F.col("new_field")).alias("b")).distinct()
    root = {n: n for n in used}

    def top(n: str) -> str:
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    pairs = links.limit(max_names * 10 + 1).collect()
    if len(pairs) > max_names * 10:
        raise ValueError(f"more than {max_names * 10} renamed pairs of names")
    for r in sorted(pairs):
        a, b = top(r.a), top(r.b)
        if a != b:
            first, second = sorted((a, b), key=lambda n: (-used.get(n, 0), n))
            root[second] = first
    return {n: top(n) for n in root if top(n) != n}


def routes(files: DataFrame, known: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_id, route): for every file the map from its fields to their name in the consistent table.

    The migration steps of all later files are chained; names that renames of any series link are one.
    """
    names = final_names(files, known, changes)
    same = alias_classes(known, changes)
    name = unified_name(F.col("final_field"))
    if same:
        name = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(same.items()) for x in pair])[name], name)
    return names.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", name))).alias("route"))


def consistent_table(files: DataFrame, rows: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row per line that parses, with the same fields for all files: chained renames, then defaults and casts.

    (file_id, line_no, series_name, candidate_id, scene_name, source_path, class_name, score, support_view_count, num_seed_points,
    others). Names that renames of any series link are one field, under the name most files use. candidate_id is the number its digits give; score is a number, a text of one or an object's value; counts are whole
    numbers, else NULL; a field that a file doesn't have is NULL. others: MAP of the remaining fields' texts by unified name.
    If two fields of a line unify to one name, the first by original name that isn't null is taken. A line is converted where it is read, by its
    file's route: neither lines nor values are shuffled unless there are too many files to broadcast the routes.
    """
    known = cut(file_fields(parsed_fields(rows)))
    changes = cut(schema_changes(files, rows, known) if changes is None else changes)
    by_file = cut(routes(files, known, changes).join(files.where("file_id is not null").select("file_id", "series_name").distinct(), "file_id", "left"))
    lines = parsed_lines(rows).join(small_or_not(by_file), "file_id")
    members = F.map_entries(F.expr("try_variant_get(v, '$', 'map<string,variant>')"))

    def entry(e: Column) -> Column:
        value = e["value"]
        empty = json_type(value).isNull()
        text = F.when(~empty, F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))
        return F.struct(
            empty.alias("empty"), e["key"].alias("field"), F.col("route")[e["key"]].alias("name"), text.alias("t"), F.try_variant_get(value, "$.value", "double").alias("inner")
        )

    lines = lines.withColumn("e", F.array_sort(F.transform(members, entry)))
    one = lambda n: F.get(F.filter("e", lambda x: x["name"] == n), F.lit(0))
    get = lambda n: one(n)["t"]
    core = ["candidate_id", "scene_name", "source_path", "class_name", "score", "support_view_count", "num_seed_points"]
    left = F.array_sort(F.array_distinct(F.transform(F.filter("e", lambda x: ~x["name"].isin(*core)), lambda x: x["name"])))
    others = F.map_from_entries(F.transform(left, lambda n: F.struct(n, get(n))))
    return lines.select(
        "file_id", "line_no", F.col("cand").try_cast("long").alias("candidate_id"), get("scene_name").alias("scene_name"), get("source_path").alias("source_path"), get("class_name").alias("class_name"),
        F.coalesce(get("score").try_cast("double"), one("score")["inner"]).alias("score"), get("support_view_count").try_cast("int").alias("support_view_count"), get("num_seed_points").try_cast("int").alias("num_seed_points"), others.alias("others"), "series_name",
    )
