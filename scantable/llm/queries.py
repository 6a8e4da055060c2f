"""The pN_ queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantable.common import cut, same_name, table, usable_count, usable_score
from scantable.llm.caps import Level, beyond_caps, laminar_caps
from scantable.llm.components import observation_groups
from scantable.llm.fuse import Fused, discover_truth
from scantable.llm.mixing import Mixture, poisson_mix
from scantable.llm.packing import fill_report, pack
from scantable.llm.setjoin import SimilarSets, set_links, similar_pairs, similar_sets
from scantable.llm.tokens import with_tokens
from scantable.llm.topn import best_records
from scantable.llm.truncation import cut_rates, cut_texts

CANDIDATES = "backprojection_candidates"
KEY = ["scene_name", "candidate_id"]
#: Class names taken into the plan as literals; more are an error, not a shorter list.
MOST_CLASSES = 10_000


def _fused(spark: SparkSession, sf_dir: str, **how: float) -> Fused:
    rows = table(spark, sf_dir, CANDIDATES)
    # a fixed dimension table of 48 rows
    names = [r.k for r in table(spark, sf_dir, "classes").select(same_name("name").alias("k")).where("k is not null").distinct().limit(MOST_CLASSES + 1).collect()]
    if len(names) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} class names")
    fields = {
        "class_name": F.when(same_name("class_name").isin(names), same_name("class_name")),
        "score": usable_score("score"),
        "support_view_count": usable_count("support_view_count"),
    }
    return discover_truth(rows, KEY, "source_kind", table(spark, sf_dir, "source_kinds"), fields, "exported_at", "record_id", **how)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which record gives each field, with the trust order as a dominating prior (discount 1/4)."""
    rid = lambda f: F.coalesce(F.col(f"{f}_id"), F.lit(-1)).cast("long")
    out = _fused(spark, sf_dir).chosen
    return out.select(*KEY, rid("class_name").alias("class_record_id"), rid("score").alias("score_record_id"), rid("support_view_count").alias("views_record_id"))


def p1_outvoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving records of plain truth discovery: agreeing sources outvote trusted ones."""
    chosen = _fused(spark, sf_dir, discount=1.0, floor=0.05).chosen
    return chosen.withColumns({c: F.round(c, 9) for c in chosen.columns if c.endswith("_support")})


def p1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources with their reliability after the last round of plain truth discovery, and whether the rounds settled."""
    fused = _fused(spark, sf_dir, discount=1.0, floor=0.05)
    rows = [(name, rank, float(fused.reliability[i]), fused.rounds, fused.converged) for i, (name, rank) in enumerate(fused.sources)]
    return spark.createDataFrame(rows, "source string, trust_rank long, reliability double, rounds int, converged boolean")


def _capped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    rows = table(spark, sf_dir, CANDIDATES).select("record_id", "scene_name", same_name("source_kind").alias("source"), usable_score("score").alias("score"), F.coalesce(usable_count("support_view_count"), F.lit(0)).alias("views"))
    return rows, [F.col("score").desc_nulls_last(), F.col("views").desc(), F.col("record_id").asc()]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records beyond the first 20 of their scene and source kind."""
    rows, order = _capped(spark, sf_dir)
    return beyond_caps(rows, [Level(("scene_name", "source"), cap=20)], order, "record_id")


def p3_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records kept under nested caps: 20 a scene and source kind, 60 a scene."""
    rows, order = _capped(spark, sf_dir)
    return laminar_caps(rows, [Level(("scene_name", "source"), cap=20), Level(("scene_name",), cap=60)], order).select("record_id", "scene_name")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records kept where a source kind may supply at most half of its own records and no scene more than 2,000."""
    rows, order = _capped(spark, sf_dir)
    levels = [Level(("scene_name", "source"), share=0.5), Level(("scene_name",), cap=2000)]
    return laminar_caps(rows, levels, order).select("record_id", "scene_name")


def _seed_sets(spark: SparkSession, sf_dir: str) -> SimilarSets:
    seeds = table(spark, sf_dir, "seed_points")
    return similar_sets(seeds, "candidate_id", ["scene_name"], F.filter("point_indices", lambda p: p >= 0))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of candidates of a scene whose seeds share at least 0.8 of their union."""
    return similar_pairs(_seed_sets(spark, sf_dir)).toDF("candidate_id_a", "candidate_id_b")


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate and set: the smallest candidate with an equal set, copies and links."""
    found = _seed_sets(spark, sf_dir)
    first = found.members.groupBy("set_id").agg(F.min("id").alias("first_id"))
    return set_links(found).join(first, "set_id").select(F.col("id").alias("candidate_id"), "first_id", "n_copies", "n_links")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 records with a usable score of every scene."""
    return best_records(table(spark, sf_dir, CANDIDATES), usable_score("score"), 10)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group per observation over linking rows and common candidates."""
    trace = table(spark, sf_dir, "mask_graph_trace")
    links = F.coalesce(same_name("relation_type"), F.lit("")) != "conflict"
    return observation_groups(trace, "member_observation_ids", "candidate_id", links)


def _sizes(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    return cut(with_tokens(table(spark, sf_dir, "documents"), "text", keep))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which container of 2,048 tokens every text, or piece of a longer text, goes to."""
    return pack(_sizes(spark, sf_dir, ["doc_id"]), "doc_id", "n_tokens").withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p8_packed(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str, total: str | None = "targeted") -> Mixture:
    """total: tokens aimed at - those of all texts of sources with a target, those of the whole corpus, or as many as keep all shares (None)."""
    sizes, targets = _sizes(spark, sf_dir, ["doc_id", "source"]), table(spark, sf_dir, "mix_targets")
    aim = None
    if total is not None:
        counted = sizes.join(F.broadcast(targets.where("target_share > 0").select("source")), "source", "left_semi") if total == "targeted" else sizes
        aim = float(counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n)
    return poisson_mix(sizes, targets, "doc_id", "source", "n_tokens", total=aim)


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen texts, each copy a row, in shuffled order; as many tokens as the targeted sources have, scarce ones stop at max_repeats."""
    return _mixture(spark, sf_dir).rows.withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources in p9_mixed."""
    return _mixture(spark, sf_dir).shares


def p9_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen texts of a mixture only as large as its scarcest source allows, so that no share falls short."""
    return _mixture(spark, sf_dir, None).rows.withColumnRenamed("id", "doc_id")


def p9_even_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources in p9_even."""
    return _mixture(spark, sf_dir, None).shares


def p9_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen texts of a mixture that aims at as many tokens as all documents have, those without a target among them."""
    return _mixture(spark, sf_dir, "corpus").rows.withColumnRenamed("id", "doc_id")


def p9_corpus_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of that mixture: scarce sources fall short."""
    return _mixture(spark, sf_dir, "corpus").shares


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return cut_texts(table(spark, sf_dir, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts per source."""
    docs = table(spark, sf_dir, "documents")
    return cut_rates(docs.select("doc_id", "source"), cut_texts(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    return {f.__name__: f for f in (p1_found, p1_outvoted, p1_sources, p3_found, p3_nested, p3_shares, p5_found, p5_links, p6_found, p7_found, p8_packed, p8_fill, p9_mixed, p9_shares, p9_even, p9_even_shares, p9_corpus, p9_corpus_shares, p10_found, p10_rates)}


def _outvoted_sql(name: Callable[[str], str], usable: str, rounds: int = 14) -> str:
    """Plain truth discovery with its rounds written out one by one; a round after the last one needed changes nothing."""
    fields = {"class_name": "cn", "score": "CAST(s AS VARCHAR)", "support_view_count": "CAST(v AS VARCHAR)"}
    claims = " UNION ALL ".join(f"SELECT '{f}' AS f, scene_name, candidate_id, sid, rank, exported_at AS ts, record_id AS id, {v} AS val FROM r WHERE {v} IS NOT NULL" for f, v in fields.items())
    steps = ["w0 AS MATERIALIZED (SELECT sid, 1.0::DOUBLE AS w, false AS done FROM src)"]

    def won(i: int) -> str:
        sums = f"SELECT f, scene_name, candidate_id, val, sum(w) AS s, min(place) AS place FROM c JOIN w{i} USING (sid) GROUP BY 1, 2, 3, 4"
        return f"SELECT f, scene_name, candidate_id, first(val ORDER BY round(s, 9) DESC, place) AS val, first(s ORDER BY round(s, 9) DESC, place) AS s, sum(s) AS total FROM ({sums}) GROUP BY 1, 2, 3"

    for i in range(rounds):
        steps.append(f"j{i} AS MATERIALIZED (SELECT sid, count(*) AS n, count(*) FILTER (WHERE c.val = x.val) AS ok FROM c JOIN ({won(i)}) x USING (f, scene_name, candidate_id) GROUP BY 1)")
        steps.append(f"n{i} AS MATERIALIZED (SELECT sid, w, done, CASE WHEN n IS NULL THEN w ELSE greatest(0.05, (ok + 10) / (n + 10)::DOUBLE) END AS new FROM w{i} LEFT JOIN j{i} USING (sid))")
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT sid, CASE WHEN done THEN w ELSE new END AS w, done OR (SELECT max(abs(new - w)) FROM n{i}) <= 1e-3 AS done FROM n{i})")
    each = ", ".join(f"max(CASE WHEN f = '{f}' THEN id END) AS {f}_id, max(CASE WHEN f = '{f}' THEN val END) AS {f}_t, max(CASE WHEN f = '{f}' THEN s / nullif(total, 0) END) AS {f}_support" for f in fields)
    return f"""WITH k AS (SELECT {name('source_kind')} AS sk, min(trust_rank) AS rank FROM source_kinds GROUP BY 1), cl AS (SELECT DISTINCT {name('name')} AS cn FROM classes), src AS (SELECT sk AS sid FROM k WHERE sk IS NOT NULL UNION ALL SELECT ''),
        r AS (SELECT b.scene_name, b.candidate_id, b.record_id, b.exported_at, coalesce(k.sk, '') AS sid, coalesce(k.rank, (SELECT max(rank) + 1 FROM k)) AS rank, cl.cn, {usable} AS s, CASE WHEN support_view_count >= 1 THEN support_view_count END AS v
            FROM backprojection_candidates b LEFT JOIN k ON k.sk = {name('b.source_kind')} LEFT JOIN cl ON cl.cn = {name('b.class_name')} WHERE scene_name IS NOT NULL AND candidate_id IS NOT NULL),
        g AS (SELECT scene_name, candidate_id, count(*) AS n_records FROM r GROUP BY 1, 2 HAVING count(*) > 1),
        a AS (SELECT *, row_number() OVER (PARTITION BY f, scene_name, candidate_id, sid ORDER BY ts DESC NULLS LAST, id DESC) AS i FROM ({claims}) JOIN g USING (scene_name, candidate_id)),
        c AS MATERIALIZED (SELECT f, scene_name, candidate_id, sid, id, val, row_number() OVER (PARTITION BY f, scene_name, candidate_id ORDER BY rank, ts DESC NULLS LAST, id DESC) AS place FROM a WHERE i = 1),
        {', '.join(steps)}, x AS ({won(rounds)}), y AS (SELECT x.*, (SELECT arg_min(c.id, c.place) FROM c WHERE c.f = x.f AND c.scene_name = x.scene_name AND c.candidate_id = x.candidate_id AND c.val = x.val) AS id FROM x),
        z AS (SELECT scene_name, candidate_id, {each} FROM y GROUP BY 1, 2)
        SELECT scene_name, candidate_id, n_records, class_name_t AS class_name, class_name_id, round(class_name_support, 9) AS class_name_support, CAST(score_t AS DOUBLE) AS score, score_id, round(score_support, 9) AS score_support,
            CAST(support_view_count_t AS INT) AS support_view_count, support_view_count_id, round(support_view_count_support, 9) AS support_view_count_support FROM g LEFT JOIN z USING (scene_name, candidate_id)"""


_NAME = r"nullif(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g'), '')"


def oracle_sql() -> dict[str, str]:
    """Name -> the same in SQL."""
    name = _NAME.format
    usable = "CASE WHEN NOT isnan(score) AND score >= 0 AND score <= 1 THEN score END"
    capped = f"""SELECT record_id, scene_name, {name('source_kind')} AS source, {usable} AS s,
        CASE WHEN support_view_count >= 1 THEN support_view_count ELSE 0 END AS v FROM backprojection_candidates"""
    order = "ORDER BY s DESC NULLS LAST, v DESC, record_id"
    pick = "coalesce(first(record_id ORDER BY rank, exported_at DESC NULLS LAST, record_id DESC) FILTER (WHERE {} IS NOT NULL), -1) AS {}"
    return {
        "p1_found": f"""WITH k AS (SELECT {name('source_kind')} AS sk, min(trust_rank) AS rank FROM source_kinds GROUP BY 1),
            c AS (SELECT DISTINCT {name('name')} AS cn FROM classes),
            r AS (SELECT b.scene_name, b.candidate_id, b.record_id, b.exported_at, coalesce(k.rank, (SELECT max(rank) + 1 FROM k)) AS rank, c.cn, {usable} AS s,
                CASE WHEN support_view_count >= 1 THEN support_view_count END AS v
                FROM backprojection_candidates b LEFT JOIN k ON k.sk = {name('b.source_kind')} LEFT JOIN c ON c.cn = {name('b.class_name')})
            SELECT scene_name, candidate_id, {pick.format('cn', 'class_record_id')}, {pick.format('s', 'score_record_id')}, {pick.format('v', 'views_record_id')}
            FROM r GROUP BY 1, 2 HAVING count(*) > 1""",
        "p1_outvoted": _outvoted_sql(name, usable),
        "p3_found": f"SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY scene_name, source {order}) AS n FROM ({capped})) WHERE n > 20",
        "p3_nested": f"""SELECT record_id, scene_name FROM (SELECT *, row_number() OVER (PARTITION BY scene_name {order}) AS m FROM
            (SELECT *, row_number() OVER (PARTITION BY scene_name, source {order}) AS n FROM ({capped})) WHERE n <= 20) WHERE m <= 60""",
        "p3_shares": f"""SELECT record_id, scene_name FROM (SELECT *, row_number() OVER (PARTITION BY scene_name {order}) AS m FROM
            (SELECT *, row_number() OVER (PARTITION BY scene_name, source {order}) AS n, count(*) OVER (PARTITION BY scene_name, source) AS c FROM ({capped}))
            WHERE n <= greatest(1, floor(c * 0.5))) WHERE m <= 2000""",
        "p6_found": f"""SELECT scene_name, record_id FROM (SELECT scene_name, record_id, row_number() OVER
            (PARTITION BY scene_name ORDER BY s DESC, candidate_id, record_id) AS n FROM (SELECT scene_name, candidate_id, record_id, {usable} AS s
            FROM backprojection_candidates) WHERE s IS NOT NULL) WHERE n <= 10""",
        "p5_found": """WITH e AS (SELECT DISTINCT scene_name, candidate_id, unnest(point_indices) AS p FROM seed_points),
            v AS (SELECT * FROM e WHERE p >= 0), z AS (SELECT scene_name, candidate_id, count(*) AS n FROM v GROUP BY 1, 2),
            j AS (SELECT a.scene_name, a.candidate_id AS candidate_id_a, b.candidate_id AS candidate_id_b, count(*) AS shared FROM v a JOIN v b
                ON a.scene_name = b.scene_name AND a.p = b.p AND a.candidate_id < b.candidate_id GROUP BY 1, 2, 3)
            SELECT candidate_id_a, candidate_id_b FROM j JOIN z x ON x.scene_name = j.scene_name AND x.candidate_id = candidate_id_a
            JOIN z y ON y.scene_name = j.scene_name AND y.candidate_id = candidate_id_b WHERE shared * 10 >= (x.n + y.n - shared) * 8""",
        "p5_links": """WITH r AS (SELECT DISTINCT scene_name, candidate_id AS id, list_sort(list_distinct(list_filter(point_indices, lambda x: x >= 0))) AS s FROM seed_points WHERE scene_name IS NOT NULL AND candidate_id IS NOT NULL),
            c AS MATERIALIZED (SELECT scene_name, s, min(id) AS first_id, count(*) AS n_copies, row_number() OVER (ORDER BY scene_name, s) AS k FROM r WHERE len(s) > 0 GROUP BY 1, 2), e AS (SELECT scene_name, k, len(s) AS n, unnest(s) AS p FROM c),
            j AS (SELECT a.k, b.k AS other, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.scene_name = b.scene_name AND a.p = b.p AND a.k <> b.k GROUP BY 1, 2, 3, 4), l AS (SELECT k, count(*) AS n_links FROM j WHERE shared * 10 >= (na + nb - shared) * 8 GROUP BY 1)
            SELECT r.id AS candidate_id, first_id, n_copies, coalesce(n_links, 0) AS n_links FROM r JOIN c ON c.scene_name = r.scene_name AND c.s = r.s LEFT JOIN l USING (k)""",
        "p7_found": f"""WITH RECURSIVE r AS (SELECT DISTINCT candidate_id, list_filter(list_distinct(member_observation_ids), lambda x: x IS NOT NULL AND x >= 0) AS m
                FROM mask_graph_trace WHERE coalesce({name('relation_type')}, '') <> 'conflict'),
            s AS (SELECT candidate_id AS c, list_min(m) AS a, unnest(m) AS b FROM r WHERE len(m) > 0),
            t AS (SELECT c, min(a) AS a FROM s WHERE c IS NOT NULL GROUP BY 1),
            e AS (SELECT a, b FROM s UNION SELECT b, a FROM s UNION SELECT t.a, s.a FROM s JOIN t USING (c) UNION SELECT s.a, t.a FROM s JOIN t USING (c)),
            w(v, g) AS (SELECT a, a FROM e UNION SELECT e.b, w.g FROM w JOIN e ON e.a = w.v WHERE w.g < e.b)
            SELECT v AS observation_id, min(g) AS group_id FROM w GROUP BY 1""",
    }
