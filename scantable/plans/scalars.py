"""Queries over scans, filters, expressions and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scantable.common import table
from scantable.functions import exprs as X
from scantable.operators import greedy, ranking
from scantable.plans.registry import query
from scantable.plans.views import cand, obs, pts, with_views

#: fixed values: an example of rules by source, in the order they are tried
RULES = "mask_graph=0.9,bpr:0.7,sam=0.8,broken,=1,dense_ibsp=x"
QUALITY = """greatest(0, coalesce(fusion, score)) * greatest(0, score) * (0.45 + 0.55 * least(1, views / 50.0)) * (0.35 + 0.45 * least(1, mean_iou) + 0.20 * least(1, best_iou))
    * (1 - 0.65 * least(1, covered)) * (1 - 0.35 * least(1, existing_iou)) * (1 - 0.25 * least(1, area_ratio / 0.25))"""


def quality() -> F.Column:
    """Quality of a candidate record."""
    return X.candidate_quality(*[F.col(c) for c in ("score", "fusion", "views", "mean_iou", "best_iou", "covered", "existing_iou", "area_ratio")], F.lit(1.0))


@query(with_views("pts", "SELECT p.scene_name, p.candidate_id, count(*) AS n_points, count(*) - max(s.n) AS differs FROM pts p JOIN (SELECT candidate_id, max(num_seed_points) AS n FROM seed_points GROUP BY 1) s USING (candidate_id) GROUP BY 1, 2"))
def i12_seed_scan(spark: SparkSession, d: str) -> DataFrame:
    """Seed points in range per candidate, and how far their number is from the one stated."""
    said = table(spark, d, "seed_points").groupBy("candidate_id").agg(F.max("num_seed_points").alias("n"))
    counts = pts(spark, d).groupBy("scene_name", "candidate_id").agg(F.count(F.lit(1)).alias("n_points"))
    return counts.join(said, "candidate_id").select("scene_name", "candidate_id", "n_points", (F.col("n_points") - F.col("n")).alias("differs"))


@query("SELECT DISTINCT s.scene_name FROM seed_points s WHERE s.scene_name NOT IN (SELECT scene_name FROM observations WHERE scene_name IS NOT NULL)")
def i15_missing_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with seeds but without any observation."""
    return table(spark, d, "seed_points").select("scene_name").distinct().join(table(spark, d, "observations"), "scene_name", "left_anti")


@query("SELECT split, count(*) AS n, sha256(string_agg(name, ',' ORDER BY class_id)) AS signature FROM classes GROUP BY split")
def i14_signature(spark: SparkSession, d: str) -> DataFrame:
    """Signature of the class vocabulary per split."""
    names = F.array_sort(F.collect_list(F.struct("class_id", "name")))
    return table(spark, d, "classes").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(",", F.transform(names, lambda x: x["name"])), 256).alias("signature"))


@query("SELECT row_number() OVER (ORDER BY class_id) - 1 AS label_index, class_id, replace(name, ' ', '_') AS label FROM (SELECT DISTINCT class_id, name FROM classes)")
def i18_label_table(spark: SparkSession, d: str) -> DataFrame:
    """Label table: distinct pairs, dense index, names without spaces."""
    one = table(spark, d, "classes").select("class_id", "name").dropDuplicates(["class_id", "name"])
    return one.select((F.row_number().over(Window.orderBy("class_id")) - 1).alias("label_index"), "class_id", F.replace("name", F.lit(" "), F.lit("_")).alias("label"))


@query(with_views("cand", """, b AS (SELECT scene_name, arg_max(record_id, (score, -record_id)) AS best, max(CAST(score >= 0.97 AS INT)) AS any_ok FROM cand GROUP BY 1)
    SELECT c.record_id, c.scene_name FROM cand c JOIN b USING (scene_name) WHERE CASE WHEN any_ok = 1 THEN score >= 0.97 ELSE record_id = best END"""))
def f1_score_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Records over a score threshold, or a scene's best one where none is."""
    return ranking.threshold_or_best(cand(spark, d), ["scene_name"], "score", 0.97, "record_id").select("record_id", "scene_name")


@query(with_views("obs", """SELECT observation_id, 1.0 AS uniform_score, score AS native_score,
    CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS calibrated_score FROM obs WINDOW w AS (PARTITION BY scene_name)"""))
def f2_score_modes(spark: SparkSession, d: str) -> DataFrame:
    """Scores in three modes."""
    o = obs(spark, d)
    modes = {f"{m}_score": m for m in ("uniform", "native", "calibrated")}
    return ranking.score_modes(o.select("observation_id", "scene_name", "score"), ["scene_name"], "score", modes).select("observation_id", *modes)


@query(with_views("cand", "SELECT record_id, class_name FROM cand WHERE class_name IN ('sink', 'tap', 'mirror') AND coalesce(kind, '') NOT IN ('bpr')"))
def f3_class_filter(spark: SparkSession, d: str) -> DataFrame:
    """Allowed classes without blocked sources; a blank list would be no filter."""
    rows, allowed, blocked = cand(spark, d), X.parse_list("sink, tap ,mirror"), X.parse_list("bpr")
    if allowed:
        rows = rows.where(F.col("class_name").isin(allowed))
    if blocked:
        rows = rows.where(~F.coalesce("kind", F.lit("")).isin(blocked))
    return rows.select("record_id", "class_name")


@query("""SELECT record_id, CASE lower(source_kind) WHEN 'mask_graph' THEN 0.9 WHEN 'bpr' THEN 0.7 WHEN 'sam' THEN 0.8 ELSE CASE WHEN contains(lower(coalesce(source_kind, '')), 'mask_graph') THEN 0.9
    WHEN contains(lower(coalesce(source_kind, '')), 'bpr') THEN 0.7 WHEN contains(lower(coalesce(source_kind, '')), 'sam') THEN 0.8 ELSE 0.5 END END AS factor FROM backprojection_candidates""")
def f5_rule_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Factor by source: exact name, else the first rule inside the name, else a default."""
    return table(spark, d, "backprojection_candidates").select("record_id", X.rule_lookup(X.parse_rules(RULES), [F.col("source_kind")], 0.5).alias("factor"))


@query(with_views("cand", """SELECT record_id, CASE WHEN score < 0.2 THEN 'score_below_minimum' WHEN views < 2 THEN 'too_few_views' WHEN existing_iou > 0.5 THEN 'covered_by_existing' WHEN covered > 0.8 THEN 'seed_covered'
    WHEN area_ratio > 0.25 THEN 'box_too_large' ELSE 'accepted' END AS reason FROM cand"""))
def f6_first_reason(spark: SparkSession, d: str) -> DataFrame:
    """Ordered cascade that names the first rule a record fails."""
    c = F.col
    rules = [("score_below_minimum", c("score") < 0.2), ("too_few_views", c("views") < 2), ("covered_by_existing", c("existing_iou") > 0.5), ("seed_covered", c("covered") > 0.8), ("box_too_large", c("area_ratio") > 0.25)]
    return cand(spark, d).select("record_id", X.first_reason(rules, "accepted").alias("reason"))


@query()
def f7_admission(spark: SparkSession, d: str) -> DataFrame:
    """Admission under caps per source and class, by quality."""
    rows = cand(spark, d).select("scene_name", "record_id", F.round(quality(), 9).alias("quality"), "kind", "class_id", (F.col("score") >= 0.2).alias("passes"))
    return greedy.admit(rows, ["scene_name"], "record_id", "quality", "kind", "class_id", "passes", 30, 5)


@query(with_views("cand", f"SELECT record_id, {QUALITY} AS quality FROM cand"))
def f8_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of every candidate record."""
    return cand(spark, d).select("record_id", quality().alias("quality"))


@query(with_views("cand", "SELECT record_id, (1 - least(1, greatest(0, covered))) * sqrt(1 - least(1, greatest(0, existing_iou))) AS novelty FROM cand"))
def f9_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Novelty of every candidate record."""
    return cand(spark, d).select("record_id", X.novelty(F.col("covered"), F.col("existing_iou"), F.lit(0.0)).alias("novelty"))


@query(with_views("cand", f""", q AS (SELECT *, {QUALITY} AS quality FROM cand), z AS (SELECT *, CASE WHEN stddev_pop(quality) OVER w < 1e-6 THEN 0 ELSE (quality - avg(quality) OVER w) / stddev_pop(quality) OVER w END AS z
    FROM q WINDOW w AS (PARTITION BY scene_name, kind)) SELECT record_id, least(1.2, greatest(0.2, (1 + 0.3 * tanh(z / 2)) * (0.5 + 0.5 * (1 - least(1, greatest(0, covered))) * sqrt(1 - least(1, greatest(0, existing_iou)))))) AS factor FROM z"""))
def f10_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Score factor from the quality's z-score in its scene and source, and novelty."""
    q = cand(spark, d).withColumn("quality", quality())
    scored = ranking.with_group_z(q.select("record_id", "scene_name", "kind", "covered", "existing_iou", "quality"), ["scene_name", "kind"], "quality")
    factor = X.calibration(F.col("z"), X.novelty(F.col("covered"), F.col("existing_iou"), F.lit(0.0)), F.lit(1.0), 0.3, 0.5, 0.0)
    return scored.select("record_id", factor.alias("factor"))


@query(with_views("cand", """SELECT record_id, concat_ws(';', CASE WHEN views < 2 THEN 'few_views' END, CASE WHEN mean_iou < 0.3 THEN 'inconsistent' END, CASE WHEN covered > 0.5 THEN 'covered' END, CASE WHEN class_name IS NULL THEN 'no_class' END) AS reasons FROM cand"""))
def f14_all_reasons(spark: SparkSession, d: str) -> DataFrame:
    """All reasons that hold for a record."""
    c = F.col
    return cand(spark, d).select("record_id", X.all_reasons([("few_views", c("views") < 2), ("inconsistent", c("mean_iou") < 0.3), ("covered", c("covered") > 0.5), ("no_class", c("class_name").isNull())]).alias("reasons"))


@query(with_views("cand", "SELECT least(9, greatest(0, CAST(floor(mean_iou * 10) AS INT))) AS bin, count(*) AS n, avg(best_iou) AS mean_best FROM cand GROUP BY 1"))
def f21_binning(spark: SparkSession, d: str) -> DataFrame:
    """Records in ten bins of mean IoU."""
    bin_ = X.clamp(F.floor(F.col("mean_iou") * 10), 0, 9).cast("int")
    return cand(spark, d).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("best_iou").alias("mean_best"))


@query("SELECT record_id, coalesce(CASE WHEN isfinite(score) THEN score END, -1.0) AS score, coalesce(try_cast(regexp_extract(export_code_version, '([0-9]+)', 1) AS INT), 0) AS major FROM backprojection_candidates")
def f22_safe_casts(spark: SparkSession, d: str) -> DataFrame:
    """Safe casts with defaults."""
    major = F.coalesce(F.regexp_extract("export_code_version", r"([0-9]+)", 1).try_cast("int"), F.lit(0))
    return table(spark, d, "backprojection_candidates").select("record_id", X.safe_double("score", -1.0).alias("score"), major.alias("major"))


@query(with_views("cand", """SELECT record_id, CAST(kind = 'bpr' AS INT) AS is_bpr, CAST(kind = 'maskgraph' AS INT) AS is_maskgraph, CAST(kind = 'samfused' AS INT) AS is_samfused, (mean_iou - m) / s AS mean_iou_std FROM cand,
    (SELECT avg(mean_iou) AS m, CASE WHEN stddev_pop(mean_iou) < 1e-6 THEN 1 ELSE stddev_pop(mean_iou) END AS s FROM cand)"""))
def f23_features(spark: SparkSession, d: str) -> DataFrame:
    """One-hot source kinds and a standardised number."""
    rows = cand(spark, d)
    fit = rows.agg(F.avg("mean_iou").alias("m"), F.stddev_pop("mean_iou").alias("s")).select("m", F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s")).alias("s"))
    hot = [(F.col("kind") == k).cast("int").alias(f"is_{k}") for k in ("bpr", "maskgraph", "samfused")]
    return rows.crossJoin(F.broadcast(fit)).select("record_id", *hot, ((F.col("mean_iou") - F.col("m")) / F.col("s")).alias("mean_iou_std"))


@query(with_views("cand", """SELECT record_id, score AS keep_score, coalesce(fusion, score) AS replace_score, greatest(score, coalesce(fusion, score)) AS max_score, 0.5 * score + 0.5 * coalesce(fusion, score) AS blend_score, least(1, score * 1.2) AS boost_score FROM cand"""))
def f25_score_policies(spark: SparkSession, d: str) -> DataFrame:
    """Five policies of combining two scores."""
    a, b = F.col("score"), F.coalesce("fusion", "score")
    return cand(spark, d).select("record_id", a.alias("keep_score"), b.alias("replace_score"), F.greatest(a, b).alias("max_score"), (0.5 * a + 0.5 * b).alias("blend_score"), F.least(F.lit(1.0), a * 1.2).alias("boost_score"))


@query("""WITH l AS (SELECT class_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS label FROM classes), t AS (SELECT DISTINCT class_name, ' ' || trim(regexp_replace(lower(class_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t
    FROM backprojection_candidates WHERE class_name IS NOT NULL) SELECT class_name, arg_max(class_id, (length(label), label)) AS class_id FROM t JOIN l ON label <> '' AND contains(t, ' ' || label || ' ') GROUP BY 1""")
def f26_label_match(spark: SparkSession, d: str) -> DataFrame:
    """Class of every spelling: the longest label it has as whole words."""
    labels = table(spark, d, "classes").select("class_id", X.normal_label("name").alias("label")).where("label <> ''")
    seen = table(spark, d, "backprojection_candidates").where("class_name is not null").select("class_name").distinct()
    hit = seen.join(F.broadcast(labels), X.contains_words(F.col("class_name"), F.col("label")))  # 48 labels, a fixed vocabulary
    return hit.groupBy("class_name").agg(F.max_by("class_id", F.struct(F.length("label"), F.col("label"))).alias("class_id"))


@query("SELECT DISTINCT source_json, regexp_replace(regexp_replace(source_json, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM backprojection_candidates WHERE source_json IS NOT NULL")
def f27_slug(spark: SparkSession, d: str) -> DataFrame:
    """Safe names of paths."""
    return table(spark, d, "backprojection_candidates").where("source_json is not null").select("source_json", X.slug("source_json").alias("slug")).distinct()


@query(with_views("obs", """, c AS (SELECT observation_id, least(639, greatest(0, x1 - (x2 - x1) * 0.1)) AS ax, least(479, greatest(0, y1 - (y2 - y1) * 0.1)) AS ay, least(640, greatest(0, x2 + (x2 - x1) * 0.1)) AS bx,
    least(480, greatest(0, y2 + (y2 - y1) * 0.1)) AS by_ FROM obs) SELECT observation_id, ax, ay, greatest(bx, ax + 1) AS bx, greatest(by_, ay + 1) AS by_ FROM c"""))
def f28_clamped_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Padded boxes inside the image."""
    box = X.clamp_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], width=640, height=480, pad=0.1)
    return obs(spark, d).select("observation_id", *[b.alias(a) for a, b in zip(("ax", "ay", "bx", "by_"), box)])


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e FROM embeddings)
    SELECT vec_id, e[1] / list_sum(e) AS first_p, list_max(e) / list_sum(e) AS top_p FROM e""")
def f30_softmax_whole(spark: SparkSession, d: str) -> DataFrame:
    """Softmax over all numbers of a vector."""
    p = X.softmax(F.transform("embedding", lambda v: v.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", F.get("p", F.lit(0)).alias("first_p"), F.array_max("p").alias("top_p"))


@query("""WITH u AS (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding) AS v FROM embeddings), r AS (SELECT vec_id, k, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k) AS n FROM u)
    SELECT vec_id, max(k) FILTER (WHERE n = 1) AS best, max(k) FILTER (WHERE n = 2) AS second, CAST(max(v) FILTER (WHERE n = 1) AS DOUBLE) - CAST(max(v) FILTER (WHERE n = 2) AS DOUBLE) AS margin FROM r GROUP BY 1""")
def f31_top_two(spark: SparkSession, d: str) -> DataFrame:
    """Best and second axis of a vector and their margin, inside the array."""
    ranked = F.sort_array(F.transform("embedding", lambda v, i: F.struct(v.alias("v"), (-i).alias("k"))), asc=False)
    out = table(spark, d, "embeddings").select("vec_id", ranked.alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return out.select("vec_id", (-first["k"]).alias("best"), (-second["k"]).alias("second"), (first["v"].cast("double") - second["v"].cast("double")).alias("margin"))


@query("""SELECT 'error' AS severity, 'score_range' AS category, count(*) AS n FROM backprojection_candidates WHERE score IS NOT NULL AND NOT (isfinite(score) AND score BETWEEN 0 AND 1)
    UNION ALL SELECT 'error', 'unknown_class', count(*) FROM backprojection_candidates WHERE class_id IS NOT NULL AND class_id NOT IN (SELECT class_id FROM classes)
    UNION ALL SELECT 'error', 'duplicate_record', count(*) FROM (SELECT record_id FROM backprojection_candidates GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'warning', 'view_count', count(*) FROM backprojection_candidates WHERE support_view_count IS NOT NULL AND support_view_count <> coalesce(len(support_views), 0)""")
def f32_audit(spark: SparkSession, d: str) -> DataFrame:
    """Integrity audit: ranges, references, uniqueness, stated counts."""
    rows, classes = table(spark, d, "backprojection_candidates"), table(spark, d, "classes")
    bad_score = F.col("score").isNotNull() & ~(~F.isnan("score") & (F.abs("score") < float("inf")) & F.col("score").between(0, 1))
    unknown = rows.where("class_id is not null").join(F.broadcast(classes.select("class_id")), "class_id", "left_anti")  # a fixed vocabulary
    twice = rows.groupBy("record_id").count().where("count > 1")
    counts = rows.where(F.col("support_view_count").isNotNull() & (F.col("support_view_count") != F.coalesce(F.array_size("support_views"), F.lit(0))))
    parts = [("error", "score_range", rows.where(bad_score)), ("error", "unknown_class", unknown), ("error", "duplicate_record", twice), ("warning", "view_count", counts)]
    out = None
    for severity, category, bad in parts:
        one = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), "n")
        out = one if out is None else out.union(one)
    return out


@query(with_views("cand", """SELECT record_id, CASE WHEN len(r) = 0 THEN 'fast' ELSE array_to_string(r, ',') END AS routes FROM (SELECT record_id, list_filter([CASE WHEN score < 0.4 THEN 'sam' END, CASE WHEN mean_iou < 0.4 OR views < 2 THEN 'mllm' END], lambda x: x IS NOT NULL) AS r FROM cand)"""))
def f33_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes a record takes, in a fixed order; the fast one if none holds."""
    r = F.array_compact(F.array(F.when(F.col("score") < 0.4, "sam"), F.when((F.col("mean_iou") < 0.4) | (F.col("views") < 2), "mllm")))
    return cand(spark, d).select("record_id", F.when(F.size(r) == 0, "fast").otherwise(F.concat_ws(",", r)).alias("routes"))


@query("""SELECT record_id, coalesce(nullif(trim(source_kind), ''), CASE WHEN contains(source_json, 'mask_graph') THEN 'mask_graph' WHEN contains(source_json, 'sam') THEN 'sam' ELSE 'unknown' END) AS inferred FROM backprojection_candidates""")
def f38_source_inference(spark: SparkSession, d: str) -> DataFrame:
    """Source kind by precedence: the field, then a part of the path, then unknown."""
    guess = F.when(F.contains("source_json", F.lit("mask_graph")), "mask_graph").when(F.contains("source_json", F.lit("sam")), "sam").otherwise("unknown")
    return table(spark, d, "backprojection_candidates").select("record_id", F.coalesce(F.nullif(F.trim("source_kind"), F.lit("")), guess).alias("inferred"))


@query("""SELECT scene_name, CAST(regexp_extract(scene_name, 'scene([0-9]+)_([0-9]+)', 1) AS BIGINT) AS scene, CAST(regexp_extract(scene_name, 'scene([0-9]+)_([0-9]+)', 2) AS BIGINT) AS scan, count(*) AS n
    FROM observations WHERE regexp_matches(scene_name, 'scene[0-9]+_[0-9]+') GROUP BY 1, 2, 3""")
def f39_scene_ids(spark: SparkSession, d: str) -> DataFrame:
    """Scene and scan numbers from names."""
    part = lambda i: F.regexp_extract("scene_name", r"scene([0-9]+)_([0-9]+)", i).cast("long")
    rows = table(spark, d, "observations").where(F.col("scene_name").rlike(r"scene[0-9]+_[0-9]+"))
    return rows.groupBy("scene_name", part(1).alias("scene"), part(2).alias("scan")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^  class=([a-z_]+) ap=([0-9.]+)', 1)) AS class_name, unnest(regexp_extract_all(text, '(?m)^  class=([a-z_]+) ap=([0-9.]+)', 2)) AS ap FROM documents WHERE source = 'run_log')
    SELECT class_name, count(*) AS n, avg(try_cast(ap AS DOUBLE)) AS mean_ap FROM m GROUP BY 1""")
def f40_log_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics scraped from logs by a multi-line pattern."""
    pattern = F.lit(r"(?m)^  class=([a-z_]+) ap=([0-9.]+)")
    pairs = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("c"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("a"))
    each = table(spark, d, "documents").where("source = 'run_log'").select(F.explode(pairs).alias("p"))
    return each.groupBy(F.col("p.c").alias("class_name")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("p.a").try_cast("double")).alias("mean_ap"))


@query("""WITH c AS (SELECT name, string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ') AS t FROM classes) SELECT a.name AS name_a, b.name AS name_b,
    len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) AS jaccard FROM c a JOIN c b ON a.name < b.name WHERE len(list_intersect(a.t, b.t)) > 0""")
def s7_name_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of class names that share a word, by an equi-join on words."""
    words = table(spark, d, "classes").select("name", F.explode(F.array_distinct(F.split(X.normal_label("name"), " "))).alias("w"))
    met = words.toDF("name_a", "w").join(words.toDF("name_b", "w"), "w").where("name_a < name_b").select("name_a", "name_b").distinct()
    return met.select("name_a", "name_b", X.token_jaccard("name_a", "name_b").alias("jaccard"))
