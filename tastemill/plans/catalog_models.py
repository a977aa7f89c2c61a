"""Queries over recommenders, similarity, metrics, features, ranking and vectors, with their SQL."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.expressions import steady
from tastemill.operators import (
    als,
    clean,
    features,
    folds,
    hybrid,
    knn,
    labels,
    linalg,
    metrics,
    popular,
    ranking,
    search,
    similarity,
    vectors,
)
from tastemill.plans import inputs as I
from tastemill.plans import jobs
from tastemill.plans.catalog_data import GENRE_CTES, LABEL_CTES, labelled, main_folds
from tastemill.plans.inputs import r6, rounded, sql
from tastemill.schema import DATE, FOLD, ITEM, RANK, TARGET, USER
from tastemill.session import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# --- popularity --------------------------------------------------------------------------------

POP_CTES = {
    "recent": (
        "select * from inter where start_date > (select max(start_date) from inter) - 30",
        ("inter",),
    ),
    "pop": (
        """select item_id, n, row_number() over (order by n desc, item_id) as rank from
        (select item_id, count(*) as n from recent group by item_id) qualify rank <= 100""",
        ("recent",),
    ),
    "pop_age": (
        """select age, item_id, n, row_number() over (partition by age order by n desc, item_id) as rank
        from (select age, item_id, count(*) as n from recent join users using (user_id)
        where age is not null group by age, item_id) qualify rank <= 100""",
        ("recent", "users"),
    ),
    "everyone": ("select distinct user_id from inter", ("inter",)),
}


@query("r1_popular", sql("select * from pop", "pop", extra=POP_CTES))
def r1(spark, d):
    return popular.popular(I.interactions(spark, d))


@query(
    "r2_popular_recommend",
    sql(
        "select user_id, item_id, rank from everyone, pop where rank <= 10", "everyone", "pop", extra=POP_CTES
    ),
)
def r2(spark, d):
    df = I.interactions(spark, d)
    return popular.popular_recommend(df, popular.popular(df), 10)


@query("r3_popular_by_age", sql("select * from pop_age", "pop_age", extra=POP_CTES))
def r3(spark, d):
    return popular.popular_by(I.interactions(spark, d), I.users(spark, d))


_R4 = {
    **POP_CTES,
    # A short window leaves segments with fewer than ten items, so lists must be topped up.
    "day": ("select * from inter where start_date > (select max(start_date) from inter) - 1", ("inter",)),
    "seg": (
        """select age, item_id, row_number() over (partition by age order by n desc, item_id) as rank
        from (select age, item_id, count(*) as n from day join users using (user_id)
        where age is not null group by age, item_id) qualify rank <= 10""",
        ("day", "users"),
    ),
    "lists": (
        """select age, item_id, row_number() over (partition by age order by src, place) as rank from
        (select age, item_id, 0 as src, rank as place from seg union all
         select a.age, p.item_id, 1, p.rank from (select distinct age from seg) a, pop p
         where p.rank <= 10 and (a.age, p.item_id) not in (select (age, item_id) from seg))
        qualify rank <= 10""",
        ("seg", "pop"),
    ),
    "with_age": (
        "select e.user_id, u.age from everyone e left join users u using (user_id)",
        ("everyone", "users"),
    ),
}


@query(
    "r4_popular_by_age_recommend",
    sql(
        """select user_id, item_id, rank from with_age join lists using (age) union all
        select user_id, item_id, rank from with_age, pop where rank <= 10
        and (age is null or age not in (select age from lists))""",
        "with_age",
        "lists",
        "pop",
        extra=_R4,
    ),
)
def r4(spark, d):
    df, users = stored(I.interactions(spark, d)), I.users(spark, d)
    own = popular.popular_by(df, users, days=1)
    return popular.popular_by_recommend(df, users, own, popular.popular(df), 10)


# --- neighbours --------------------------------------------------------------------------------


def _knn_ctes(source: str, prefix: str = "", k: int = 10) -> dict:
    """Weights, similarities and neighbour lists over the view `source`."""
    p = prefix
    out = {
        f"{p}du": (f"select user_id, count(*) as du from {source} group by user_id", (source,)),
        f"{p}li": (f"select item_id, count(*) as li from {source} group by item_id", (source,)),
        f"{p}tot": (f"select count(*) as ni, avg(li) as al from {p}li", (f"{p}li",)),
        f"{p}cosine_w": (f"select user_id, item_id, 1.0::double as w from {source}", (source,)),
        f"{p}tfidf_w": (
            f"""select user_id, item_id, ln(ni * 1.0::double / (1 + du)) as w from {source}
            join {p}du using (user_id), {p}tot""",
            (source, f"{p}du", f"{p}tot"),
        ),
        f"{p}bm25_w": (
            f"""select user_id, item_id, 2.2::double / (1 + 1.2::double * (0.25::double + 0.75::double * li / al))
            * ln(ni * 1.0::double / (1 + du)) as w from {source} join {p}du using (user_id)
            join {p}li using (item_id), {p}tot""",
            (source, f"{p}du", f"{p}li", f"{p}tot"),
        ),
    }
    for kind in knn.WEIGHTINGS:
        w = f"{p}{kind}_w"
        norm = (
            f"select item_id, 1.0::double as nn from {w} group by item_id"
            if kind == "bm25"
            else f"select item_id, sqrt(sum(w * w)) as nn from {w} group by item_id"
        )
        out |= {
            f"{p}{kind}_norm": (norm, (w,)),
            f"{p}{kind}_u": (
                f"""select user_id, item_id, case when nn = 0 then 0 else w / nn end as w from {w}
                join {p}{kind}_norm using (item_id)""",
                (w, f"{p}{kind}_norm"),
            ),
            f"{p}{kind}_nbr": (
                f"""select item_id, similar_item_id, score,
                row_number() over (partition by item_id order by score desc, similar_item_id) as rank
                from (select a.item_id, b.item_id as similar_item_id, {rounded('sum(a.w * b.w)', 9)} as score
                from {p}{kind}_u a join {p}{kind}_u b on a.user_id = b.user_id and a.item_id <> b.item_id
                group by a.item_id, b.item_id) qualify rank <= {k}""",
                (f"{p}{kind}_u",),
            ),
        }
    return out


KNN_CTES = _knn_ctes("inter")

for _kind in knn.WEIGHTINGS:

    @query(f"r5_knn_{_kind}", sql(f"select * from {_kind}_nbr", f"{_kind}_nbr", extra=KNN_CTES))
    def r5(spark, d, kind=_kind):
        return knn.item_knn(I.interactions(spark, d), kind)


def _recs_sql(source: str, nbr: str, k: int) -> str:
    return f"""select user_id, item_id, score, row_number() over (partition by user_id
        order by score desc, item_id) as rank from (select h.user_id, n.similar_item_id as item_id,
        {rounded('sum(n.score)', 9)} as score from {source} h join {nbr} n using (item_id) group by 1, 2) s
        where not exists (select 1 from {source} h where h.user_id = s.user_id and h.item_id = s.item_id)
        qualify rank <= {k}"""


@query("r6_knn_recommend", sql(_recs_sql("inter", "bm25_nbr", 10), "bm25_nbr", extra=KNN_CTES))
def r6_knn(spark, d):
    df = stored(I.interactions(spark, d))
    return knn.knn_recommend(df, df, knn.item_knn(df, "bm25"), 10)


@query(
    "r7_similar_items",
    sql(
        """select n.* from tfidf_nbr n where rank <= 5 and item_id in
        (select item_id from recent)""",
        "tfidf_nbr",
        "recent",
        extra={**KNN_CTES, **POP_CTES},
    ),
)
def r7(spark, d):
    df = stored(I.interactions(spark, d))
    newest = df.agg(F.max(DATE)).scalar()
    recent = df.filter(F.col(DATE) > F.date_sub(newest, 30))
    return knn.similar_items(recent, knn.item_knn(df, "tfidf"), 5)


@query("r8_als_fit")
def r8(spark, d):
    fit = als.als_fit(stored(I.clean_interactions(spark, d)), weight="progress", seed=7)
    sides = (("user", fit.model.userFactors), ("item", fit.model.itemFactors))
    parts = [f.select(F.lit(s).alias("side"), "id", "features") for s, f in sides]
    return parts[0].unionByName(parts[1])


@query(
    "r8_contract",
    sql(
        """select 'user' as side, count(distinct user_id) as factors, 64::integer as narrow, 64::integer as wide, 0::bigint as odd
        from clean union all select 'item', count(distinct item_id), 64, 64, 0 from clean""",
        "clean",
    ),
)
def r8_contract(spark, d):
    # One vector of 64 finite numbers for each user and each item of the interactions.
    size, odd = F.size("features"), F.exists("features", lambda x: F.isnan(x) | (F.abs(x) > 1e6))
    return stored(r8(spark, d)).groupBy("side").agg(
        F.count_distinct("id").alias("factors"), F.min(size).alias("narrow"), F.max(size).alias("wide"), F.count_if(odd).alias("odd")
    )


def _contract(recs: DataFrame, seen: DataFrame) -> DataFrame:
    """One row: users and rows of top lists, and counts of what must not be: gaps in ranks, double and seen items."""
    lists = recs.groupBy(USER).agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct(ITEM).alias("items"))
    repeats = recs.join(seen.select(USER, ITEM), [USER, ITEM], "left_semi").agg(F.count("*")).scalar()
    return lists.agg(
        F.count("*").alias("users"),
        F.sum("n").alias("listed"),
        F.count_if(F.col("last") != F.col("n")).alias("gaps"),
        F.count_if(F.col("items") != F.col("n")).alias("doubles"),
    ).withColumn("seen", repeats)


def _contract_sql(items: str) -> str:
    return f"""select count(*) as users, sum(least(10, total - n))::bigint as listed, 0::bigint as gaps,
        0::bigint as doubles, 0::bigint as seen from (select user_id, count(*) as n from history group by user_id),
        ({items}) where least(10, total - n) > 0"""


@query(
    "r9_contract",
    sql(
        _contract_sql("select count(distinct item_id) as total from history"),
        "history",
        extra={"history": ("select * from clean", ("clean",))},
    ),
)
def r9_contract(spark, d):
    df = stored(I.clean_interactions(spark, d))
    return _contract(stored(r9(spark, d)), df)


@query(
    "r12_contract",
    sql(
        _contract_sql("select count(*) as total from items"),
        "history",
        "items",
        extra={"history": ("select * from inter where user_id in (select user_id from users)", ("inter", "users"))},
    ),
)
def r12_contract(spark, d):
    df = stored(I.interactions(spark, d))
    return _contract(stored(r12(spark, d)), df)


@query("r9_als_recommend")
def r9(spark, d):
    df = stored(I.clean_interactions(spark, d))
    return als.als_recommend(als.als_fit(df, seed=7), df, df, 10)


#: Whole numbers in place of fitted factors: scores are exact, and an item's length grows with its interactions.
_USER_STEPS, _ITEM_STEPS = (3, 5, 7, 11, 13, 17), (19, 23, 29, 31, 37, 41)


def _fixed_factors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = F.array(*(((F.col(USER) * p) % 19 - 4).cast("double") for p in _USER_STEPS))
    grown = F.col("_n") * F.col("_n") * F.col("_n")
    right = F.array(*((((F.col(ITEM) * q) % 17 - 3) * grown).cast("double") for q in _ITEM_STEPS))
    counts = df.groupBy(ITEM).agg(F.count("*").alias("_n"))
    return (
        df.select(USER).distinct().select(USER, left.alias("vec")),
        counts.select(ITEM, right.alias("vec"), F.lit(0.0).alias("bias")),
    )


_FIXED_CTES = {
    "grown": ("select item_id, count(*)::bigint as n from clean group by item_id", ("clean",)),
    "scores": (
        f"""select u.user_id, g.item_id, ({' + '.join(
            f"((u.user_id * {p}) % 19 - 4) * ((g.item_id * {q}) % 17 - 3)" for p, q in zip(_USER_STEPS, _ITEM_STEPS)
        )})::double * (n * n * n) as score from (select distinct user_id from clean) u, grown g""",
        ("clean", "grown"),
    ),
}


@query(
    "r9_fixed_factors",
    sql(
        """select user_id, item_id, score, row_number() over (partition by user_id order by score desc, item_id) as rank
        from scores s where not exists (select 1 from clean c where c.user_id = s.user_id and c.item_id = s.item_id)
        qualify rank <= 10""",
        "scores",
        "clean",
        extra=_FIXED_CTES,
    ),
)
def r9_fixed(spark, d):
    df = stored(I.clean_interactions(spark, d))
    return search.bounded_search(*_fixed_factors(df), 10, df, block=64).found


@query(
    "r9_search_work",
    sql(
        """select count(distinct user_id) as users, count(distinct item_id) as items,
        count(distinct user_id) * count(distinct item_id) as cells, true as spared_half from clean""",
        "clean",
    ),
)
def r9_work(spark, d):
    df = stored(I.clean_interactions(spark, d))
    work = search.bounded_search(*_fixed_factors(df), 10, df, block=64).work
    return work.select("users", "items", "cells", (2 * F.col("scored") < F.col("cells")).alias("spared_half"))


@query(
    "r10_fill_short",
    sql(
        """select user_id, item_id, rank, false as filled from recs union all
        select user_id, item_id, have + extra as rank, true as filled from
        (select e.user_id, p.item_id, coalesce(c.have, 0) as have, row_number() over
         (partition by e.user_id order by p.rank) as extra from everyone e left join
         (select user_id, count(*) as have from recs group by user_id) c using (user_id), ranked p
         where coalesce(c.have, 0) < 30
         and not exists (select 1 from inter i where i.user_id = e.user_id and i.item_id = p.item_id)
         and not exists (select 1 from recs r where r.user_id = e.user_id and r.item_id = p.item_id))
        where have + extra <= 30""",
        "recs",
        "everyone",
        "ranked",
        extra={
            **_knn_ctes("inter", k=1),
            **POP_CTES,
            "ranked": (
                """select item_id, row_number() over (order by count(*) desc, item_id) as rank
                from recent group by item_id""",
                ("recent",),
            ),
            "recs": (_recs_sql("inter", "cosine_nbr", 30), ("inter", "cosine_nbr")),
        },
    ),
)
def r10(spark, d):
    # One neighbour per item leaves many lists short of thirty.
    df = stored(I.interactions(spark, d))
    recs = knn.knn_recommend(df, df, knn.item_knn(df, "cosine", k=1), 30)
    return popular.fill_short(recs, df, popular.popular(df, max_k=None), df, 30)


@query("r11_hybrid_fit")
def r11(spark, d):
    fit = _hybrid(spark, d)
    return hybrid.side_vectors(fit, "item")


def _hybrid(spark, d):
    return hybrid.hybrid_fit(labelled(spark, d), I.users(spark, d), I.items(spark, d))


@query("r12_hybrid_recommend")
def r12(spark, d):
    df = stored(I.interactions(spark, d))
    return hybrid.hybrid_recommend(_hybrid(spark, d), df, df, 10)


@query(
    "r13_drop_seen",
    sql(
        """select user_id, item_id, rank from everyone, pop where not exists (select 1 from inter i
        where i.user_id = everyone.user_id and i.item_id = pop.item_id)""",
        "everyone",
        "pop",
        extra=POP_CTES,
    ),
)
def r13(spark, d):
    df = I.interactions(spark, d)
    return popular.drop_seen(popular.popular_recommend(df, popular.popular(df), 100), df)


# --- similarity --------------------------------------------------------------------------------


def _sim_ctes(support: int) -> dict:
    return {
        "means": (
            "select user_id, avg(rating) as m from inter where rating is not null group by user_id",
            ("inter",),
        ),
        "cen": (
            """select user_id, item_id, rating, m, rating - m as c from inter join means using (user_id)
            where rating is not null""",
            ("inter", "means"),
        ),
        "pairs": (
            f"""select a.item_id as item_i, b.item_id as item_j, count(*) as support,
            sum(a.c * b.c) as dot, sum(a.c * a.c) as ii, sum(b.c * b.c) as jj,
            sum(a.rating * b.rating) as rdot, sum((a.rating - b.rating) * (a.rating - b.rating)) as rsq,
            sum(abs(a.rating - b.rating)) as rabs
            from cen a join cen b on a.user_id = b.user_id and a.item_id <> b.item_id
            group by a.item_id, b.item_id having count(*) >= {support}""",
            ("cen",),
        ),
        "sim": (
            f"""select item_i, item_j, {rounded('case when ii <= 1e-8 or jj <= 1e-8 then 0 else dot / (sqrt(ii) * sqrt(jj)) end', 9)} as sim,
            support from pairs""",
            ("pairs",),
        ),
        "near": (
            """select *, row_number() over (partition by item_i order by sim desc, item_j) as rank
            from sim qualify rank <= 10""",
            ("sim",),
        ),
        "cands": (
            """select distinct user_id, item_j as item_id from cen join near on item_i = item_id
            where (user_id, item_j) not in (select (user_id, item_id) from cen)""",
            ("cen", "near"),
        ),
        "sums": (
            """select c.user_id, s.item_i as item_id, sum(c.c * s.sim) as num, sum(abs(s.sim)) as den,
            sum(s.sim) as tot from cen c join sim s on s.item_j = c.item_id group by 1, 2""",
            ("cen", "sim"),
        ),
        "scores": (
            f"""select user_id, item_id, {rounded('m + case when den > 1e-8 then num / den else 0 end', 8)} as score,
            {rounded('tot', 9)} as total from cands join sums using (user_id, item_id) join means using (user_id)""",
            ("cands", "sums", "means"),
        ),
    }


SIM_ALL, SIM_TWO = _sim_ctes(1), _sim_ctes(2)


def _centered(spark, d) -> DataFrame:
    return clean.center_ratings(stored(I.interactions(spark, d).filter("rating is not null")))


@query(
    "sim1_adjusted_cosine",
    sql(
        """select * from sim union all select item_id, item_id, 1.0::double, count(*) from cen
        group by item_id""",
        "sim",
        extra=SIM_ALL,
    ),
)
def sim1(spark, d):
    return similarity.item_similarity(_centered(spark, d))


def _sim_two(spark, d) -> tuple[DataFrame, DataFrame]:
    history = stored(_centered(spark, d))
    return history, stored(similarity.item_similarity(history, min_support=2, diagonal=False))


@query("sim2_min_support", sql("select * from sim", "sim", extra=SIM_TWO))
def sim2(spark, d):
    return _sim_two(spark, d)[1]


@query("sim3_neighbors", sql("select * from near", "near", extra=SIM_TWO))
def sim3(spark, d):
    return similarity.top_neighbors(_sim_two(spark, d)[1], 10)


@query(
    "sim4_explain",
    sql(
        """select n.*, a.title as title_i, b.title as title_j from near n
        join items a on a.item_id = n.item_i join items b on b.item_id = n.item_j""",
        "near",
        "items",
        extra=SIM_TWO,
    ),
)
def sim4(spark, d):
    near = similarity.top_neighbors(_sim_two(spark, d)[1], 10)
    return similarity.explain_neighbors(near, I.items(spark, d))


@query("sim5_candidates", sql("select * from cands", "cands", extra=SIM_TWO))
def sim5(spark, d):
    history, sim = _sim_two(spark, d)
    return similarity.candidates(history, similarity.top_neighbors(sim, 10))


@query("sim6_predict", sql("select user_id, item_id, score from scores", "scores", extra=SIM_TWO))
def sim6(spark, d):
    history, sim = _sim_two(spark, d)
    cands = similarity.candidates(history, similarity.top_neighbors(sim, 10))
    return similarity.predict_ratings(cands, history, sim)


@query("sim7_sum_score", sql("select user_id, item_id, total as score from scores", "scores", extra=SIM_TWO))
def sim7(spark, d):
    history, sim = _sim_two(spark, d)
    cands = similarity.candidates(history, similarity.top_neighbors(sim, 10))
    return similarity.predict_ratings(cands, history, sim, "sum")


@query(
    "sim8_topn",
    sql(
        """select user_id, item_id, score, rank, title from (select user_id, item_id, score,
        row_number() over (partition by user_id order by score desc, item_id) as rank from scores)
        join items using (item_id) where rank <= 30""",
        "scores",
        "items",
        extra=SIM_TWO,
    ),
)
def sim8(spark, d):
    rated = I.interactions(spark, d).filter("rating is not null")
    return jobs.item_to_item(rated, I.items(spark, d), min_support=2, k=10, n=30)


_AD_HOC = {
    **SIM_TWO,
    "recently": (
        """select c.* from cen c join inter i on i.user_id = c.user_id and i.item_id = c.item_id
        where start_date > (select max(start_date) from inter where rating is not null) - 365""",
        ("cen", "inter"),
    ),
    "pcands": (
        """select distinct user_id, item_j as item_id from recently join near on item_i = item_id
        where (user_id, item_j) not in (select (user_id, item_id) from recently)""",
        ("recently", "near"),
    ),
    "psums": (
        """select c.user_id, s.item_i as item_id, sum(c.c * s.sim) as num, sum(abs(s.sim)) as den
        from recently c join sim s on s.item_j = c.item_id group by 1, 2""",
        ("recently", "sim"),
    ),
    "pscores": (
        f"""select user_id, item_id, {rounded('m + case when den > 1e-8 then num / den else 0 end', 8)} as score
        from pcands join psums using (user_id, item_id) join means using (user_id)""",
        ("pcands", "psums", "means"),
    ),
}


@query(
    "sim9_ad_hoc_history",
    sql(
        """select user_id, item_id, score, rank, title from (select user_id, item_id, score,
        row_number() over (partition by user_id order by score desc, item_id) as rank from pscores)
        join items using (item_id) where rank <= 10""",
        "pscores",
        "items",
        extra=_AD_HOC,
    ),
)
def sim9(spark, d):
    # What was rated in the last year, scored against the full similarity table.
    history, sim = _sim_two(spark, d)
    newest = history.agg(F.max(DATE)).scalar()
    part = stored(history.filter(F.col(DATE) > F.date_sub(newest, 365)))
    cands = similarity.candidates(part, similarity.top_neighbors(sim, 10))
    return similarity.topn_items(similarity.predict_ratings(cands, part, sim), I.items(spark, d), 10)


@query(
    "sim10_sparsity",
    sql(
        f"""select count(*) as cells, count(distinct user_id) as users, count(distinct item_id) as items,
        {r6('1 - count(*) / (count(distinct user_id) * 1.0::double * count(distinct item_id))')} as sparsity
        from inter""",
        "inter",
    ),
)
def sim10(spark, d):
    return similarity.sparsity(I.interactions(spark, d)).withColumn("sparsity", steady("sparsity", 6))


_TOTALS = {
    **SIM_TWO,
    "raters": (
        "select item_id, count(*) as n, sum(rating * rating) as sq from cen group by item_id",
        ("cen",),
    ),
}
_MEASURES = {
    "cosine": rounded("rdot / (sqrt(a.sq) * sqrt(b.sq))", 9),
    "jaccard": rounded("support / cast(a.n + b.n - support as double)", 9),
    "euclidean": r6("sqrt(rsq)"),
    "manhattan": rounded("rabs", 9),
}
for _name, _expr in _MEASURES.items():

    @query(
        f"sim11_{_name}",
        sql(
            f"""select item_i, item_j, {_expr} as sim, support from pairs
            join raters a on a.item_id = item_i join raters b on b.item_id = item_j""",
            "pairs",
            "raters",
            extra=_TOTALS,
        ),
    )
    def sim11(spark, d, measure=_name):
        rated = I.interactions(spark, d).filter("rating is not null")
        return similarity.item_similarity(
            rated, "rating", min_support=2, measure=measure, diagonal=False
        )


# --- metrics -----------------------------------------------------------------------------------

FOLD_POP = {
    "fold_recent": (
        """select t.* from main_train t join (select fold, max(start_date) as last from main_train
        group by fold) m using (fold) where t.start_date > last - 30""",
        ("main_train",),
    ),
    "fold_pop": (
        """select fold, item_id, row_number() over (partition by fold order by n desc, item_id) as rank
        from (select fold, item_id, count(*) as n from fold_recent group by fold, item_id)
        qualify rank <= 10""",
        ("fold_recent",),
    ),
    "fold_recs": (
        """select fold, user_id, item_id, rank from (select distinct fold, user_id from main_test)
        join fold_pop using (fold)""",
        ("main_test", "fold_pop"),
    ),
}


def _rank_ctes(truth: str, recs: str) -> dict:
    return {
        "joined": (
            f"""select t.fold, t.user_id, t.item_id, r.rank, count(*) over (partition by t.fold, t.user_id)
            as item_count_per_user from {truth} t left join {recs} r
            on r.fold = t.fold and r.user_id = t.user_id and r.item_id = t.item_id""",
            (truth, recs),
        ),
        "hit_rows": (
            """select *, row_number() over (partition by fold, user_id order by rank) as pos
            from joined where rank <= 10""",
            ("joined",),
        ),
        "fold_users": (
            "select fold, count(distinct user_id) as u from joined group by fold",
            ("joined",),
        ),
        "per_k": (
            """select fold, k, sum(case when rank <= k then 1 else 0 end) * 1.0::double / k / any_value(u) as prec,
            sum(case when rank <= k then 1.0::double / item_count_per_user else 0 end) / any_value(u) as recall
            from joined join fold_users using (fold), range(1, 11) as t(k) group by fold, k""",
            ("joined", "fold_users"),
        ),
        "mrr_map": (
            """select f.fold, coalesce(any_value(m.s), 0) / any_value(f.u) as mrr,
            coalesce(sum(h.pos * 1.0::double / h.rank / h.item_count_per_user), 0) / any_value(f.u) as map
            from fold_users f left join (select fold, sum(b) as s from (select fold, user_id,
            max(1.0::double / rank) as b from hit_rows group by fold, user_id) group by fold) m on m.fold = f.fold
            left join hit_rows h on h.fold = f.fold group by f.fold""",
            ("fold_users", "hit_rows"),
        ),
        "report": (
            f"""select fold, 'prec' as name, k::integer as k, {r6('prec')} as value from per_k union all
            select fold, 'recall', k::integer, {r6('recall')} from per_k union all
            select fold, 'MRR', 10::integer, {r6('mrr')} from mrr_map union all
            select fold, 'MAP', 10::integer, {r6('map')} from mrr_map""",
            ("per_k", "mrr_map"),
        ),
    }


M_CTES = {**FOLD_POP, **_rank_ctes("main_test", "fold_recs")}


def _fold_recs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Truth and popularity lists of the main folds."""
    df = stored(I.clean_interactions(spark, d))
    train, test = folds.split(df, main_folds(df))
    test = stored(test)
    pop = popular.popular(train, max_k=10, by=[FOLD])
    return test, popular.popular_recommend(test, pop, 10, by=[FOLD])


@query("m0_join_truth", sql("select * from joined", "joined", extra=M_CTES))
def m0(spark, d):
    return metrics.join_truth(*_fold_recs(spark, d), by=[FOLD])


@query(
    "m1_hits",
    sql(
        """select fold, user_id, item_id, coalesce(rank <= 5, false) as "hit@5" from joined""",
        "joined",
        extra=M_CTES,
    ),
)
def m1(spark, d):
    joined = metrics.join_truth(*_fold_recs(spark, d), by=[FOLD])
    return metrics.hits(joined, 5).select(FOLD, USER, ITEM, "hit@5")


def _per_user(spark, d):
    return metrics.user_hits(*_fold_recs(spark, d), 10, by=[FOLD])


@query(
    "m2_precision",
    sql(f"select fold, {r6('prec')} as value from per_k where k = 10", "per_k", extra=M_CTES),
)
def m2(spark, d):
    return metrics.precision_at(_per_user(spark, d), 10, [FOLD]).withColumn("value", steady("value", 6))


@query(
    "m3_recall",
    sql(f"select fold, {r6('recall')} as value from per_k where k = 10", "per_k", extra=M_CTES),
)
def m3(spark, d):
    return metrics.recall_at(_per_user(spark, d), 10, [FOLD]).withColumn("value", steady("value", 6))


@query("m4_mrr", sql(f"select fold, {r6('mrr')} as value from mrr_map", "mrr_map", extra=M_CTES))
def m4(spark, d):
    return metrics.mrr(_per_user(spark, d), [FOLD]).withColumn("value", steady("value", 6))


@query("m5_map", sql(f"select fold, {r6('map')} as value from mrr_map", "mrr_map", extra=M_CTES))
def m5(spark, d):
    return metrics.map_score(_per_user(spark, d), [FOLD]).withColumn("value", steady("value", 6))


@query("m6_report", sql("select * from report", "report", extra=M_CTES))
def m6(spark, d):
    report = metrics.compute_metrics(*_fold_recs(spark, d), 10, separate_k=True, by=[FOLD])
    return report.withColumn("value", steady("value", 6))


# A holdout with BM25 lists for the list-quality metrics.
HOLD = {
    "htrain": ("select * from inter where start_date < date '2000-06-01'", ("inter",)),
    "htest": (
        """select * from inter where start_date >= date '2000-06-01'
        and user_id in (select user_id from htrain)""",
        ("inter", "htrain"),
    ),
    **_knn_ctes("htrain", "h_"),
    "hrecs_all": (_recs_sql("htrain", "h_bm25_nbr", 10), ("htrain", "h_bm25_nbr")),
    "hrecs": (
        "select * from hrecs_all where user_id in (select user_id from htest)",
        ("hrecs_all", "htest"),
    ),
    "sets": (
        """select distinct item_id, unnest(string_split(lower(trim(genres)), ',')) as genre from items
        where genres is not null""",
        ("items",),
    ),
    "flags": ("select item_id, list(genre) as gs from sets group by item_id", ("sets",)),
    "ild": (
        f"""select user_id, {r6('2.0::double * coalesce(apart, 0) / (n * (n - 1) * v)')} as intra_list_div from
        (select user_id, max(rank) as n from hrecs group by user_id) left join
        (select a.user_id, sum(len(fa.gs) + len(fb.gs) - 2 * len(list_intersect(fa.gs, fb.gs))) as apart
         from hrecs a join hrecs b on a.user_id = b.user_id and a.rank < b.rank
         join flags fa on fa.item_id = a.item_id join flags fb on fb.item_id = b.item_id
         group by a.user_id) using (user_id),
        (select count(distinct genre)::double as v from sets)""",
        ("hrecs", "flags", "sets"),
    ),
    "miuf": (
        f"""select user_id, {r6('avg(-log2(coalesce(n, 1) / total))')} as miuf from hrecs left join
        (select item_id, count(distinct user_id)::double as n from htrain group by item_id) using (item_id),
        (select count(distinct user_id)::double as total from htrain) group by user_id""",
        ("hrecs", "htrain"),
    ),
    "seren": (
        f"""select r.user_id, {r6('avg(greatest(p.pr - r.rank, 0) * case when t.item_id is null then 0 else 1 end)')}
        as seren from hrecs r join (select item_id, row_number() over (order by count(*) desc, item_id) as pr
        from htrain group by item_id) p on p.item_id = r.item_id
        left join htest t on t.user_id = r.user_id and t.item_id = r.item_id group by r.user_id""",
        ("hrecs", "htrain", "htest"),
    ),
}


def _holdout(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = stored(I.interactions(spark, d))
    train, test = folds.holdout(df, dt.date(2000, 6, 1), dt.date(2100, 1, 1))
    test = test.join(train.select(USER).distinct(), USER, "left_semi")
    recs = stored(knn.knn_recommend(test, train, knn.item_knn(train, "bm25"), 10))
    return train, test, recs


@query("m7_diversity", sql("select * from ild", "ild", extra=HOLD))
def m7(spark, d):
    _, _, recs = _holdout(spark, d)
    found = metrics.intra_list_diversity(recs, I.items(spark, d))
    return found.withColumn("intra_list_div", steady("intra_list_div", 6))


@query("m8_novelty", sql("select * from miuf", "miuf", extra=HOLD))
def m8(spark, d):
    train, _, recs = _holdout(spark, d)
    return metrics.miuf(recs, train).withColumn("miuf", steady("miuf", 6))


@query("m9_serendipity", sql("select * from seren", "seren", extra=HOLD))
def m9(spark, d):
    train, test, recs = _holdout(spark, d)
    return metrics.serendipity(recs, train, test).withColumn("seren", steady("seren", 6))


@query("m10_mean_diversity", sql(f"select {r6('avg(intra_list_div)')} as mean_intra_list_div from ild", "ild", extra=HOLD))
def m10(spark, d):
    mean = metrics.mean_metric(m7(spark, d), "intra_list_div")
    return mean.withColumn("mean_intra_list_div", steady("mean_intra_list_div", 6))


_CV_WEIGHTS = {
    "cosine": "1.0::double / sqrt(li)",
    "tfidf": """ln(ni * 1.0::double / (1 + du))
        / sqrt(sum(pow(ln(ni * 1.0::double / (1 + du)), 2)) over (partition by fold, item_id))""",
    "bm25": """2.2::double / (1 + 1.2::double * (0.25::double + 0.75::double * li / al))
        * ln(ni * 1.0::double / (1 + du))""",
}


def _cv_ctes(model: str) -> dict:
    """Lists of a model fitted on the labelled train rows of every main fold."""
    base = {
        "cv_pos": (
            "select distinct fold, user_id, item_id, start_date from main_train_labels where target = 1",
            ("main_train_labels",),
        ),
        "cv_truth": (
            "select fold, user_id, item_id from main_test_labels where target = 1",
            ("main_test_labels",),
        ),
        "cv_recent": (
            """select p.* from cv_pos p join (select fold, max(start_date) as last from cv_pos group by fold) m
            using (fold) where p.start_date > last - 30""",
            ("cv_pos",),
        ),
        "cv_pop": (
            """select fold, item_id, row_number() over (partition by fold order by n desc, item_id) as rank
            from (select fold, item_id, count(*) as n from cv_recent group by fold, item_id)
            qualify rank <= 10""",
            ("cv_recent",),
        ),
        "cv_users": ("select distinct fold, user_id from cv_truth", ("cv_truth",)),
    }
    if model == "popular":
        base["cv_recs"] = (
            "select fold, user_id, item_id, rank from cv_users join cv_pop using (fold)",
            ("cv_users", "cv_pop"),
        )
    elif model == "popular_by_age":
        base |= {
            "cv_seg": (
                """select fold, age, item_id, row_number() over (partition by fold, age
                order by n desc, item_id) as rank from (select fold, age, item_id, count(*) as n
                from cv_recent join users using (user_id) where age is not null
                group by fold, age, item_id) qualify rank <= 10""",
                ("cv_recent", "users"),
            ),
            "cv_lists": (
                """select fold, age, item_id, row_number() over (partition by fold, age
                order by src, place) as rank from (select fold, age, item_id, 0 as src, rank as place
                from cv_seg union all select a.fold, a.age, p.item_id, 1, p.rank
                from (select distinct fold, age from cv_seg) a join cv_pop p using (fold)
                where (a.fold, a.age, p.item_id) not in (select (fold, age, item_id) from cv_seg))
                qualify rank <= 10""",
                ("cv_seg", "cv_pop"),
            ),
            "cv_recs": (
                """select c.fold, c.user_id, l.item_id, l.rank from cv_users c join users u using (user_id)
                join cv_lists l on l.fold = c.fold and l.age = u.age union all
                select c.fold, c.user_id, p.item_id, p.rank from cv_users c left join users u using (user_id)
                join cv_pop p on p.fold = c.fold where u.age is null
                or (c.fold, u.age) not in (select (fold, age) from cv_lists)""",
                ("cv_users", "cv_lists", "users", "cv_pop"),
            ),
        }
    else:
        base |= {
            "cv_du": (
                "select fold, user_id, count(*) as du from cv_pos group by fold, user_id",
                ("cv_pos",),
            ),
            "cv_li": (
                "select fold, item_id, count(*) as li from cv_pos group by fold, item_id",
                ("cv_pos",),
            ),
            "cv_tot": (
                "select fold, count(*) as ni, avg(li) as al from cv_li group by fold",
                ("cv_li",),
            ),
            "cv_w": (
                f"""select fold, user_id, item_id, {_CV_WEIGHTS[model]} as w from cv_pos
                join cv_du using (fold, user_id) join cv_li using (fold, item_id) join cv_tot using (fold)""",
                ("cv_pos", "cv_du", "cv_li", "cv_tot"),
            ),
            "cv_nbr": (
                f"""select fold, i, j, score from (select *, row_number() over (partition by fold, i
                order by score desc, j) as rn from (select a.fold, a.item_id as i, b.item_id as j,
                {rounded('sum(a.w * b.w)', 9)} as score from cv_w a join cv_w b on a.fold = b.fold
                and a.user_id = b.user_id and a.item_id <> b.item_id group by all)) where rn <= 10""",
                ("cv_w",),
            ),
            "cv_recs": (
                f"""select fold, user_id, item_id, row_number() over (partition by fold, user_id
                order by score desc, item_id) as rank from (select h.fold, h.user_id, n.j as item_id,
                {rounded('sum(n.score)', 9)} as score from cv_pos h join cv_users using (fold, user_id)
                join cv_nbr n on n.fold = h.fold and n.i = h.item_id group by all) s
                where not exists (select 1 from cv_pos h where h.fold = s.fold
                and h.user_id = s.user_id and h.item_id = s.item_id) qualify rank <= 10""",
                ("cv_pos", "cv_users", "cv_nbr"),
            ),
        }
    return {**base, **_rank_ctes("cv_truth", "cv_recs")}


def _cv_sql(model: str) -> str:
    return sql(
        f"""select r.name || '@' || r.k as name, r.value, '{model}' as model, f.s as start_date,
        f.e as end_date, r.fold::smallint as fold from report r join main_folds f using (fold)""",
        "report",
        "main_folds",
        extra=_cv_ctes(model),
    )


def _cv(spark, d, model: str, **params) -> DataFrame:
    scores = jobs.cross_validate(
        I.clean_interactions(spark, d),
        I.users(spark, d),
        I.items(spark, d),
        model,
        30,
        params.pop("folds", 7),
        10,
        **params,
    )
    return scores.withColumn("value", steady("value", 6))


for _model in ("popular", "popular_by_age", "cosine", "tfidf", "bm25"):

    @query(f"m11_cv_{_model}", _cv_sql(_model))
    def m11(spark, d, model=_model):
        return _cv(spark, d, model)


@query("m11_cv_als")
def m11_als(spark, d):
    return _cv(spark, d, "als", weight="progress")


@query("m11_cv_hybrid")
def m11_hybrid(spark, d):
    return _cv(spark, d, "hybrid")


@query("jobs_parameter_search")
def parameter_search(spark, d):
    choices = [{"rank": 16, "reg": 0.1}, {"rank": 16, "reg": 1.0}]
    found = jobs.parameter_search(
        I.clean_interactions(spark, d), I.users(spark, d), I.items(spark, d), "als", choices, 30, 2
    )
    rows = [(n, p["rank"], p["reg"], value) for n, (value, p) in enumerate(found, 1)]
    return spark.createDataFrame(rows, "place int, rank int, reg double, mean_map double")


@query("r7_als_similar_items")
def r7_als(spark, d):
    df = I.clean_interactions(spark, d)
    return als.als_similar_items(als.als_fit(df, weight="progress", seed=7), df.select("item_id"), 10)


@query(
    "m12_mean_map",
    sql(
        f"select {r6('avg(value)')} as mean_map from report where name = 'MAP'",
        "report",
        extra=_cv_ctes("popular"),
    ),
)
def m12(spark, d):
    return metrics.mean_map(_cv(spark, d, "popular"), 10).withColumn("mean_map", steady("mean_map", 6))


def _two_models() -> str:
    """Both metric reports in one statement: the views of the second get their own prefix."""
    first = _cv_ctes("popular")
    second = _cv_ctes("popular_by_age")
    names = [n for n in second if second[n] != first.get(n)]
    names += [n for n in ("joined", "hit_rows", "fold_users", "per_k", "mrr_map", "report") if n not in names]
    import re

    def renamed(text: str) -> str:
        return re.sub(r"\b(" + "|".join(names) + r")\b", r"b_\1", text)

    other = {
        renamed(n): (renamed(second[n][0]), tuple(renamed(v) for v in second[n][1])) for n in names
    }
    return sql(
        """select a.name || '@' || a.k as name, max(a.value) as popular, max(b.value) as popular_by_age
        from report a join b_report b on a.name = b.name and a.k = b.k where a.name in ('MAP', 'MRR')
        group by 1""",
        "report",
        "b_report",
        extra={**first, **other},
    )


@query("m13_compare", _two_models())
def m13(spark, d):
    both = _cv(spark, d, "popular").unionByName(_cv(spark, d, "popular_by_age"))
    return metrics.compare(both, ["popular", "popular_by_age"], "MAP|MRR")


@query(
    "m14_auc",
    sql(
        f"""select {r6('(sum(case when target = 1 then r end) - p * (p + 1) / 2) / (p * q)')} as auc from
        (select target, avg(o) over (partition by progress) as r from (select target, progress,
         row_number() over (order by progress) as o from labelled)),
        (select sum(target)::double as p, sum(1 - target)::double as q from labelled) group by p, q""",
        "labelled",
        extra=LABEL_CTES,
    ),
)
def m14(spark, d):
    # How well the progress alone tells positives from negatives.
    marked = labelled(spark, d)
    value = metrics.auc(marked, "progress")
    return spark.createDataFrame([(value,)], "auc double").withColumn("auc", steady("auc", 6))


# --- features and ranking sets -----------------------------------------------------------------


@query(
    "f1_genre_matrix",
    sql(
        """select i.item_id, g.genre, cast(coalesce(list_contains(l.gs, g.genre), false) as tinyint) as flag
        from items i left join (select item_id, list(genre) as gs from one group by item_id) l using (item_id),
        (select distinct genre from one) g""",
        "items",
        "one",
        extra={
            **GENRE_CTES,
            "one": (
                "select item_id, unnest(string_split(genres, ',')) as genre from kept_items",
                ("kept_items",),
            ),
        },
    ),
)
def f1(spark, d):
    kept = clean.select_genres(I.items(spark, d), 0.95, "unknown")
    vocabulary = features.genre_vocabulary(kept)
    wide = features.genre_matrix(kept, vocabulary)
    return wide.unpivot(ITEM, vocabulary, "genre", "flag")


@query(
    "f2_dense_ids",
    sql("select user_id, row_number() over (order by user_id) - 1 as idx from (select distinct user_id from clean)", "clean"),
)
def f2(spark, d):
    return features.dense_ids(I.clean_interactions(spark, d), USER)


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "unknown")


@query(
    "f3_one_hot",
    sql(
        "select user_id, "
        + ", ".join(f"(coalesce(age, 'unknown') = '{v}')::tinyint as \"age_{v}\"" for v in _SEGMENTS)
        + ", "
        + ", ".join(f"(coalesce(sex, 'unknown') = '{v}')::tinyint as sex_{v}" for v in ("0", "1", "unknown"))
        + " from users",
        "users",
    ),
)
def f3(spark, d):
    return features.one_hot(clean.fill_user_features(I.users(spark, d)), ["age", "sex"])


@query(
    "f4_feature_lists",
    sql(
        """select 'user' as side, user_id as id,
        coalesce(age, 'age_unknown') || ',' || coalesce(sex, 'sex_unknown') as features from users union all
        select 'item', item_id, coalesce(genres, 'genre_unknown') from items""",
        "users",
        "items",
    ),
)
def f4(spark, d):
    u, i = features.feature_lists(I.users(spark, d), I.items(spark, d))
    joined = F.array_join("features", ",").alias("features")
    return u.select(F.lit("user").alias("side"), F.col(USER).alias("id"), joined).unionByName(
        i.select(F.lit("item").alias("side"), F.col(ITEM).alias("id"), joined)
    )


@query(
    "f4_vocabulary",
    sql(
        """select distinct 'user' as side, unnest([coalesce(age, 'age_unknown'), coalesce(sex, 'sex_unknown')]) as feature
        from users union all select distinct 'item', unnest(string_split(coalesce(genres, 'genre_unknown'), ','))
        from items""",
        "users",
        "items",
    ),
)
def f4_vocabulary(spark, d):
    return features.feature_vocabulary(*features.feature_lists(I.users(spark, d), I.items(spark, d)))


@query(
    "f5_add_features",
    sql(
        """select l.user_id, l.item_id, l.target::tinyint as target, i.genres, i.year from labelled l
        join items i using (item_id)""",
        "labelled",
        "items",
        extra=LABEL_CTES,
    ),
)
def f5(spark, d):
    rows = labelled(spark, d).select(USER, ITEM, TARGET)
    return features.add_features(rows, I.items(spark, d).select(ITEM, "genres", "year"), ITEM)


_GROUP = "dense_rank() over (order by user_id, start_date) - 1 as group_id"


@query("f6_group_ids", sql(f"select user_id, item_id, start_date, {_GROUP} from clean", "clean"))
def f6(spark, d):
    rows = I.clean_interactions(spark, d).select(USER, ITEM, DATE)
    return features.add_group_ids(rows, [USER, DATE])


@query(
    "f7_typed",
    sql(
        """select l.user_id, l.item_id, l.target::tinyint as target, coalesce(age, 'unknown') as age,
        coalesce(sex, 'unknown') as sex, coalesce(genres, 'genre_unknown') as genres, coalesce(year, 'unknown') as year,
        l.progress::float as progress from labelled l join users using (user_id) join items using (item_id)""",
        "labelled",
        "users",
        "items",
        extra=LABEL_CTES,
    ),
)
def f7(spark, d):
    rows = ranking.with_features(labelled(spark, d).select(USER, ITEM, TARGET, "progress"), I.users(spark, d), I.items(spark, d))
    return features.typed_features(rows, [USER, ITEM, TARGET])[1]


def _pairs(spark, d) -> DataFrame:
    """Triplets as two rows per pair id, with the dates of the interactions."""
    df = stored(I.interactions(spark, d))
    marked = labels.label(df, labels.user_stats(df))
    dates = df.select(USER, ITEM, DATE)
    pair = F.concat_ws("-", F.col(USER).cast("string"), "pos_item").alias("pair_id")
    sides = F.explode(
        F.array(
            F.struct(F.col("pos_item").alias(ITEM), F.lit(1).alias(TARGET)),
            F.struct(F.col("neg_item").alias(ITEM), F.lit(0).alias(TARGET)),
        )
    )
    rows = labels.make_triplets(marked).select(USER, pair, sides.alias("_s")).select(USER, "pair_id", "_s.*")
    return rows.join(dates, [USER, ITEM]).withColumn("group_id", F.col(USER))


@query(
    "f8_pairwise",
    sql(
        """select p.user_id || '-' || p.item_id as pair_id, p.user_id as group_id, p.item_id as pos_item,
        n.item_id as neg_item, p.start_date as pos_date, n.start_date as neg_date from
        (select user_id, item_id, start_date, row_number() over (partition by user_id order by item_id) as p
         from labelled where target = 1) p join
        (select user_id, item_id, start_date, row_number() over (partition by user_id order by item_id) as n,
         count(*) over (partition by user_id) as total from labelled where target = 0) n
        on n.user_id = p.user_id and (p.p - 1) % n.total = n.n - 1""",
        "labelled",
        extra=LABEL_CTES,
    ),
)
def f8(spark, d):
    return features.pairwise_set(_pairs(spark, d))


@query(
    "f9_listwise",
    sql(
        """select dense_rank() over (order by user_id) - 1 as group_id, item_id, target::tinyint as target,
        start_date, progress from labelled""",
        "labelled",
        extra=LABEL_CTES,
    ),
)
def f9(spark, d):
    rows = features.add_group_ids(labelled(spark, d), [USER])
    return features.listwise_set(rows, ["progress"])


# --- two-stage ranking -------------------------------------------------------------------------

_ALS = {"rank": 64, "iterations": 10, "reg": 0.1, "seed": 1123}


def _stages(spark, d):
    early, late = folds.quantile_split(stored(I.clean_interactions(spark, d)), 0.6)
    fit, cands = ranking.stage_one(early, late, 50, **_ALS)
    return fit, early, late, cands


@query(
    "n7_sample_negatives",
    sql(
        """select user_id, item_id, rank, 0::tinyint as target from (select *, row_number() over
        (order by md5(user_id || '-' || item_id || '-10'), user_id, item_id) as place from hrecs
        where (user_id, item_id) not in (select (user_id, item_id) from htest))
        where place <= (select 2 * count(*) from hrecs where (user_id, item_id) in
        (select (user_id, item_id) from htest))""",
        "hrecs",
        "htest",
        extra=HOLD,
    ),
)
def n7(spark, d):
    # BM25 lists are the candidates; twice as many misses as hits are drawn.
    train, test, recs = _holdout(spark, d)
    hits = recs.join(test.select(USER, ITEM), [USER, ITEM], "left_semi")
    return labels.sample_negatives(recs.select(USER, ITEM, RANK), hits, 2, 10)


@query("t1_stage_one")
def t1(spark, d):
    return _stages(spark, d)[3]


@query("t2_ranker_samples")
def t2(spark, d):
    _, _, late, cands = _stages(spark, d)
    return ranking.ranker_samples(stored(cands), late, I.users(spark, d), I.items(spark, d))


def _ranker(spark, d):
    samples = stored(t2(spark, d))
    return samples, ranking.fit_ranker(samples)


@query("t3_ranker_scores")
def t3(spark, d):
    samples, model = _ranker(spark, d)
    return ranking.score(model, samples.filter(F.col("part") == "test")).select(USER, ITEM, TARGET, "score")


@query(
    "t4_rerank",
    sql(
        """select user_id, item_id, score, row_number() over (partition by user_id
        order by score desc, item_id) as rank from (select user_id, item_id,
        progress + coalesce(rating, 0) as score from clean)""",
        "clean",
    ),
)
def t4(spark, d):
    score = F.col("progress") + F.coalesce("rating", F.lit(0.0))
    return ranking.rerank(I.clean_interactions(spark, d).withColumn("score", score))


@query("t5_two_stage")
def t5(spark, d):
    return jobs.two_stage(
        I.interactions(spark, d),
        I.users(spark, d),
        I.items(spark, d),
        interval_days=30,
        **_ALS,
    )


@query("t6_importance")
def t6(spark, d):
    _, model = _ranker(spark, d)
    return ranking.importance(model, spark)


@query("t6_permutation")
def t6_permutation(spark, d):
    samples, model = _ranker(spark, d)
    drops = ranking.permutation_importance(model, samples)
    return spark.createDataFrame(sorted(drops.items()), "feature string, auc_drop double")


_SAMPLES = {
    **GENRE_CTES,
    "pknown": (
        "select * from inter where user_id in (select user_id from users) and item_id in (select item_id from items)",
        ("inter", "users", "items"),
    ),
    "pclean": (
        """select * from pknown where progress > 0 and user_id in
        (select user_id from pknown where progress > 0 group by user_id having count(*) > 4)""",
        ("pknown",),
    ),
    "pstart": ("select max(start_date) - 60 as s from pclean", ("pclean",)),
    "ptrain": ("select c.* from pclean c, pstart where start_date < s", ("pclean", "pstart")),
    "ptest": (
        """select c.* from pclean c, pstart where start_date >= s and start_date < s + 30
        and user_id in (select user_id from ptrain) and item_id in (select item_id from ptrain)""",
        ("pclean", "pstart", "ptrain"),
    ),
    "pstats": ("select user_id, coalesce(avg(rating), 0) as mr from ptrain group by user_id", ("ptrain",)),
    **{
        f"{part}_judged": (
            f"""select t.user_id, t.item_id, case when rating is not null then rating < mr else progress < 10 end as neg
            from {part} t join pstats using (user_id)""",
            (part, "pstats"),
        )
        for part in ("ptrain", "ptest")
    },
    **{
        f"{part}_pos": (
            f"""select user_id, item_id from {part}_judged where not neg or user_id in
            (select user_id from {part}_judged group by user_id having bool_and(neg))""",
            (f"{part}_judged",),
        )
        for part in ("ptrain", "ptest")
    },
    "pplain": (
        """select user_id, item_id from ptrain_judged where neg
        and (user_id, item_id) not in (select (user_id, item_id) from ptrain_pos)""",
        ("ptrain_judged", "ptrain_pos"),
    ),
    **_knn_ctes("ptrain_pos", "p_"),
    "pasked": (
        "select * from ptrain_pos where user_id not in (select user_id from pplain)",
        ("ptrain_pos", "pplain"),
    ),
    "precs": (_recs_sql("pasked", "p_bm25_nbr", 20), ("pasked", "p_bm25_nbr")),
    "samples": (
        """select user_id, item_id, 1::tinyint as target from ptrain_pos
        union all select user_id, item_id, 0::tinyint from pplain
        union all select user_id, item_id, 0::tinyint from precs
        where (user_id, item_id) not in (select (user_id, item_id) from ptrain)""",
        ("ptrain_pos", "pplain", "precs", "ptrain"),
    ),
    "pkeys": (
        "select user_id, item_id from samples union select user_id, item_id from ptest_pos",
        ("samples", "ptest_pos"),
    ),
    "pusers": (
        """select user_id, coalesce(age, 'unknown') as age, coalesce(sex, 'unknown') as sex from users
        where user_id in (select user_id from pkeys)""",
        ("users", "pkeys"),
    ),
    "pitems": (
        "select item_id, string_split(genres, ',') as g from kept_items where item_id in (select item_id from pkeys)",
        ("kept_items", "pkeys"),
    ),
}


@query("jobs_prepare_samples", sql("select * from samples", "samples", extra=_SAMPLES))
def prepare(spark, d):
    made = jobs.prepare_samples(I.interactions(spark, d), I.users(spark, d), I.items(spark, d), 30)
    return made.samples


@query(
    "jobs_network_features",
    sql(
        """select 'user' as side, user_id as id, 'age_' || v as feature, (age = v)::tinyint as flag
        from pusers, (select distinct age as v from pusers)
        union all select 'user', user_id, 'sex_' || v, (sex = v)::tinyint from pusers, (select distinct sex as v from pusers)
        union all select 'item', item_id, v, list_contains(g, v)::tinyint
        from pitems, (select distinct unnest(g) as v from pitems)""",
        "pusers",
        "pitems",
        extra=_SAMPLES,
    ),
)
def network(spark, d):
    made = jobs.prepare_samples(I.interactions(spark, d), I.users(spark, d), I.items(spark, d), 30)
    users, items = jobs.network_features(made)
    sides = []
    for side, key, frame in (("user", USER, users), ("item", ITEM, items)):
        flags = [c for c in frame.columns if c != key]
        long = frame.unpivot(key, flags, "feature", "flag")
        sides.append(long.select(F.lit(side).alias("side"), F.col(key).alias("id"), "feature", "flag"))
    return sides[0].unionByName(sides[1])


# --- vectors -----------------------------------------------------------------------------------

VEC_CTES = {
    "cells": (
        """select vec_id, label, unnest(range(0, len(embedding))) as pos,
        unnest(embedding)::double as x from embeddings""",
        (),
    ),
    "centers": ("select pos, avg(x) as m from cells group by pos", ("cells",)),
    "cent": (
        """select label::bigint as user_id, list(x order by pos) as vec from
        (select label, pos, avg(x) as x from cells group by label, pos) group by label""",
        ("cells",),
    ),
    "dist": (
        f"""select user_id, vec_id as item_id, {r6('list_distance(vec, embedding::double[])')} as distance
        from cent, embeddings""",
        ("cent",),
    ),
}


def _embeddings(spark, d) -> DataFrame:
    return I.table(spark, d, "embeddings")


@query(
    "x1_scatter",
    sql(
        f"""select a.pos::integer as i, b.pos::integer as j, {rounded('sum(a.x * b.x)', 5)} as value from
        (select vec_id, pos, x - m as x from cells join centers using (pos)) a join
        (select vec_id, pos, x - m as x from cells join centers using (pos)) b using (vec_id)
        group by a.pos, b.pos""",
        "cells",
        "centers",
        extra=VEC_CTES,
    ),
)
def x1(spark, d):
    return linalg.scatter(_embeddings(spark, d)).withColumn("value", steady("value", 5))


@query("x1_means", sql(f"select pos::integer as pos, {r6('m')} as mean from centers", "centers", extra=VEC_CTES))
def x1_means(spark, d):
    return linalg.column_means(_embeddings(spark, d)).withColumn("mean", steady("mean", 6))


@query("x2_pca")
def x2(spark, d):
    return linalg.recover(linalg.pca(_embeddings(spark, d), 8))


@query("x3_svd")
def x3(spark, d):
    return linalg.recover(linalg.svd(_embeddings(spark, d), 8))


@query("x4_error_by_rank")
def x4(spark, d):
    return linalg.error_by_rank(_embeddings(spark, d))


def _cells(recovered: DataFrame) -> DataFrame:
    """(vec_id, pos, x): the cells of a reconstruction, which at full rank are those of the table."""
    return recovered.select("vec_id", F.posexplode("recovered").alias("pos", "x")).withColumn("x", steady("x", 4))


_CELLS_SQL = sql(f"select vec_id, pos::integer as pos, {rounded('x', 4)} as x from cells", "cells", extra=VEC_CTES)


@query("x2_full_rank", _CELLS_SQL)
def x2_full(spark, d):
    df = _embeddings(spark, d)
    return _cells(linalg.recover(linalg.pca(df, df.select(F.max(F.size("embedding"))).first()[0])))


@query("x3_full_rank", _CELLS_SQL)
def x3_full(spark, d):
    df = _embeddings(spark, d)
    return _cells(linalg.recover(linalg.svd(df, df.select(F.max(F.size("embedding"))).first()[0])))


@query(
    "x4_no_and_full_rank",
    sql(
        f"""select 0::integer as k, {rounded('sum((x - m) * (x - m))', 3)} as error from cells join centers using (pos)
        union all select count(*)::integer, 0::double from centers""",
        "cells",
        "centers",
        extra=VEC_CTES,
    ),
)
def x4_ends(spark, d):
    found = stored(linalg.error_by_rank(_embeddings(spark, d)))
    ends = found.filter((F.col("k") == 0) | (F.col("k") == found.agg(F.max("k")).scalar()))
    return ends.withColumn("error", steady("error", 3))


@query("x5_als_trace")
def x5(spark, d):
    return linalg.als_trace(_embeddings(spark, d), k=2)


@query(
    "x6_nearest",
    sql(
        """select *, row_number() over (partition by user_id order by distance, item_id) as rank
        from dist qualify rank <= 10""",
        "dist",
        extra=VEC_CTES,
    ),
)
def x6(spark, d):
    return search.nearest(I.centroids(spark, d), I.vectors(spark, d), 10)


@query(
    "x7_distance_profile",
    sql(
        f"""select user_id, count(*) as n, min(distance) as min,
        {r6('quantile_cont(distance, 0.25)')} as q25, {r6('quantile_cont(distance, 0.5)')} as median,
        {r6('quantile_cont(distance, 0.75)')} as q75, max(distance) as max from dist group by user_id""",
        "dist",
        extra=VEC_CTES,
    ),
)
def x7(spark, d):
    found = vectors.distance_profile(vectors.distances(I.centroids(spark, d), I.vectors(spark, d)))
    return found.withColumns({c: steady(c, 6) for c in ("q25", "median", "q75")})


@query(
    "x8_describe",
    sql(
        """select n.user_id, n.item_id, n.distance, n.rank, e.label from (select *, row_number() over
        (partition by user_id order by distance, item_id) as rank from dist qualify rank <= 10) n
        join embeddings e on e.vec_id = n.item_id""",
        "dist",
        extra=VEC_CTES,
    ),
)
def x8(spark, d):
    attributes = _embeddings(spark, d).select(F.col("vec_id").alias(ITEM), "label")
    return vectors.describe_items(x6(spark, d), attributes)


def layer_weights(width: int, features_width: int, hidden: int = 32, out: int = 16) -> dict:
    """Small fixed layer weights in place of trained ones."""
    rng = np.random.default_rng(0)
    return {
        "w_feat": rng.standard_normal((features_width, hidden)) / 4,
        "b_feat": np.zeros(hidden),
        "w_hid": rng.standard_normal((width + hidden, hidden)) / 8,
        "b_hid": np.zeros(hidden),
        "w_out": rng.standard_normal((hidden, out)) / 4,
    }


@query("x9_embed")
def x9(spark, d):
    rows = _embeddings(spark, d).select(
        F.col("vec_id").alias(ITEM),
        F.col("embedding").alias("vec"),
        F.array(F.col("label").cast("float"), F.lit(1.0).cast("float")).alias("features"),
    )
    width = rows.select(F.max(F.size("vec"))).first()[0]
    return vectors.embed(rows, layer_weights(width, 2))


@query("x10_project")
def x10(spark, d):
    return linalg.project(_embeddings(spark, d), 2)


@query(
    "x11_triplet_loss",
    sql(
        f"""select {r6('avg(greatest(dp.distance - dn.distance + 0.5, 0))')} as loss, count(*) as triplets from
        (select c.user_id, e.vec_id, row_number() over (partition by c.user_id order by e.vec_id) as p
         from cent c join embeddings e on e.label = c.user_id) p join
        (select c.user_id, e.vec_id, row_number() over (partition by c.user_id order by e.vec_id) as n,
         count(*) over (partition by c.user_id) as total from cent c join embeddings e
         on e.label <> c.user_id) n on n.user_id = p.user_id and (p.p - 1) % n.total = n.n - 1
        join exact dp on dp.user_id = p.user_id and dp.item_id = p.vec_id
        join exact dn on dn.user_id = n.user_id and dn.item_id = n.vec_id""",
        "cent",
        "exact",
        extra={
            **VEC_CTES,
            "exact": (
                """select user_id, vec_id as item_id, list_distance(vec, embedding::double[]) as distance
                from cent, embeddings""",
                ("cent",),
            ),
        },
    ),
)
def x11(spark, d):
    # A label's centroid should lie nearer to its own vectors than to those of other labels.
    centers = I.centroids(spark, d)
    own = _embeddings(spark, d).select(F.col("vec_id").alias(ITEM), F.col("label").cast("bigint").alias("_own"))
    pairs = vectors.distances(centers, I.vectors(spark, d)).select(USER, ITEM).join(own, ITEM)
    marked = pairs.select(USER, ITEM, (F.col("_own") == F.col(USER)).cast("tinyint").alias(TARGET))
    loss = vectors.triplet_loss(labels.make_triplets(marked), centers, I.vectors(spark, d), 0.5)
    return loss.withColumn("loss", steady("loss", 6))
