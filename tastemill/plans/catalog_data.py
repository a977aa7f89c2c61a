"""Queries over sources, cleaning, folds, labels and profiles, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions.expressions import quantize, steady
from tastemill.operators import clean, folds, knn, labels, profile
from tastemill.plans import inputs as I
from tastemill.plans.inputs import r6, sql
from tastemill.schema import FILM_GENRES, FOLD, ITEM, USER
from tastemill.session import scratch_folder, stored
from tastemill.sources import delimited, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _written(df: DataFrame, name: str, **options: str) -> str:
    path = scratch_folder(df.sparkSession, name)
    df.write.options(**options).csv(path)
    return path


# --- sources and sinks -------------------------------------------------------------------------


@query(
    "io1_ratings",
    sql(
        "select user_id, item_id, cast(rating as float) as rating, start_date from inter_raw where rating is not null",
        "inter_raw",
    ),
)
def io1(spark: SparkSession, d: str) -> DataFrame:
    raw = I.inter_raw(spark, d).filter("rating is not null")
    epoch = F.unix_date("start_date").cast("bigint") * 86_400 + 3_600
    path = _written(raw.select(USER, ITEM, "rating", epoch), "ratings", sep="\t")
    return delimited.read_ratings(spark, path)


def _flag(n: int) -> str:
    return f"p_size % {len(FILM_GENRES)} = {n} or p_brand = 'Brand#{n}'"


@query(
    "io2_flag_items",
    "select p_partkey as item_id, p_name || ' é' as title, date '1990-01-01' + p_size as release_date, "
    "coalesce(array_to_string(list_sort([x for x in ["
    + ", ".join(
        f"case when {_flag(n)} then '{name.lower().replace(chr(39), chr(39) * 2)}' end"
        for n, name in enumerate(FILM_GENRES)
    )
    + "] if x is not null]), ','), '') as genres, 'u' || p_partkey as \"IMDb_URL\" from part",
)
def io2(spark: SparkSession, d: str) -> DataFrame:
    part = I.table(spark, d, "part")
    rows = part.select(
        "p_partkey",
        F.concat("p_name", F.lit(" é")),
        F.date_format(F.expr("date '1990-01-01' + p_size"), "dd-MMM-yyyy"),
        F.lit(None).cast("string"),
        F.concat(F.lit("u"), F.col("p_partkey").cast("string")),
        *(F.expr(f"cast({_flag(n)} as int)").alias(f"g{n}") for n in range(len(FILM_GENRES))),
    )
    path = _written(rows, "film-items", sep="|", encoding="ISO-8859-1")
    return delimited.read_flag_items(spark, path, columns=None)


@query(
    "io3_flag_users",
    """select c_custkey as user_id, cast(18 + c_nationkey as smallint) as age,
    case when c_acctbal < 5000 then 'F' else 'M' end as gender,
    c_mktsegment as occupation, c_name as zip_code from customer""",
)
def io3(spark: SparkSession, d: str) -> DataFrame:
    rows = I.table(spark, d, "customer").select(
        "c_custkey",
        18 + F.col("c_nationkey"),
        F.when(F.col("c_acctbal") < 5000, "F").otherwise("M"),
        "c_mktsegment",
        "c_name",
    )
    return delimited.read_flag_users(spark, _written(rows, "film-users", sep="|"))


@query(
    "io4_interactions",
    sql("select user_id, item_id, cast(progress as smallint) as progress, rating, start_date from inter_raw", "inter_raw"),
)
def io4(spark: SparkSession, d: str) -> DataFrame:
    rows = I.inter_raw(spark, d).withColumn(
        "rating", F.coalesce("rating", F.when(F.col("progress") > 50, F.lit(float("nan"))))
    )
    return delimited.read_interactions(spark, _written(rows, "interactions", header="true"))


_WORDS = "list_sort(string_split(lower(trim(genres)), ','))"


@query(
    "io5_items",
    sql(
        f"""select item_id, lower(trim(title)) as title, array_to_string({_WORDS}, ',') as genres,
        'a' || item_id as authors, year from items""",
        "items",
    ),
)
def io5(spark: SparkSession, d: str) -> DataFrame:
    rows = I.items(spark, d).select(
        F.col(ITEM).alias("id"),
        F.upper("title").alias("title"),
        "genres",
        F.concat(F.lit("a"), F.col(ITEM).cast("string")).alias("authors"),
        "year",
    )
    return delimited.read_items(spark, _written(rows, "items", header="true"))


@query("io6_users", sql("select user_id, age, sex from users", "users"))
def io6(spark: SparkSession, d: str) -> DataFrame:
    rows = I.users(spark, d).withColumn("sex", F.col("sex").cast("double"))
    return delimited.read_users(spark, _written(rows, "users", header="true"))


@query("io7_table", "select o_orderkey, o_custkey, cast(o_orderdate as date) as o_day from orders")
def io7(spark: SparkSession, d: str) -> DataFrame:
    orders = tables.read_table(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderdate"])
    return orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_day"))


@query(
    "io8_write_table",
    sql("select *, extract(year from start_date)::integer as year from inter", "inter"),
)
def io8(spark: SparkSession, d: str) -> DataFrame:
    rows = I.interactions(spark, d).withColumn("year", F.year("start_date"))
    path = scratch_folder(spark, "table")
    tables.write_table(rows, path, partition_by="year")
    return tables.read_table(spark, path)


_REPORT = """select year, part, count(*) as n from
(select extract(year from start_date)::integer as year,
 case when progress < 50 then 'low' else 'high' end as part from inter) group by all"""


@query("io9_reports", sql(_REPORT, "inter"))
def io9(spark: SparkSession, d: str) -> DataFrame:
    rows = I.interactions(spark, d).withColumn("year", F.year("start_date"))
    paths = []
    for part, test in (("low", "progress < 50"), ("high", "progress >= 50")):
        path = scratch_folder(spark, f"report-{part}")
        report = rows.filter(test).groupBy("year").agg(F.count("*").alias("n"))
        tables.write_report(report.select("year", F.lit(part).alias("part"), "n"), path)
        paths.append(path)
    return tables.read_reports(spark, paths, "year int, part string, n bigint")


# --- cleaning ----------------------------------------------------------------------------------


@query("c1_dedupe", sql("select * from inter", "inter"))
def c1(spark, d):
    return I.interactions(spark, d)


@query("c2_noise", sql("select * from clean", "clean"))
def c2(spark, d):
    return I.clean_interactions(spark, d)


@query(
    "c3_known",
    sql(
        """select * from inter where user_id in (select c_custkey from customer where c_acctbal >= 0)
        and item_id in (select p_partkey from part where p_size > 5)""",
        "inter",
    ),
)
def c3(spark, d):
    # Accounts in good standing and articles of a size still sold are the known entities here.
    users = I.table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias(USER))
    items = I.table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias(ITEM))
    return clean.restrict_to_known(I.interactions(spark, d), users, items)


@query(
    "c4_normalize",
    sql(
        f"""select item_id, lower(trim(title)) as title, array_to_string({_WORDS}, ',') as genres, year
        from items""",
        "items",
    ),
)
def c4(spark, d):
    return clean.normalize_items(I.items(spark, d))


GENRE_CTES = {
    "mentions": (
        f"select item_id, unnest({_WORDS}) as genre from items where genres is not null",
        ("items",),
    ),
    "genre_n": ("select genre, count(*) as n from mentions group by genre", ("mentions",)),
    "coverage": (
        """select genre, n, cast(sum(n) over (order by n desc, genre) as double)
        / (select sum(n) from genre_n) as cum from genre_n""",
        ("genre_n",),
    ),
    "kept_lists": (
        """select item_id, string_agg(genre, ',' order by genre) as genres from
        (select distinct item_id, genre from mentions join coverage using (genre) where cum <= 0.95)
        group by item_id""",
        ("mentions", "coverage"),
    ),
    "kept_items": (
        """select i.item_id, lower(trim(i.title)) as title, coalesce(k.genres, 'unknown') as genres,
        i.year from items i left join kept_lists k on k.item_id = i.item_id""",
        ("items", "kept_lists"),
    ),
}


@query("c5_select_genres", sql("select * from kept_items", "kept_items", extra=GENRE_CTES))
def c5(spark, d):
    return clean.select_genres(I.items(spark, d), 0.95, "unknown")


@query(
    "c6_top_items",
    sql(
        """select * from inter where item_id in (select item_id from inter group by item_id
        order by count(*) desc, item_id limit 500)""",
        "inter",
    ),
)
def c6(spark, d):
    return clean.keep_top_items(I.interactions(spark, d), 500)


@query(
    "c7_user_features",
    sql("select user_id, coalesce(age, 'unknown') as age, coalesce(sex, 'unknown') as sex from users", "users"),
)
def c7(spark, d):
    return clean.fill_user_features(I.users(spark, d))


@query(
    "c8_item_features",
    sql(
        """select item_id, coalesce(genres, 'genre_unknown') as genres,
        coalesce(year, 'unknown') as year from items""",
        "items",
    ),
)
def c8(spark, d):
    return clean.fill_item_features(I.items(spark, d))


@query(
    "c9_quantize",
    sql(
        """select user_id, item_id, cast(floor(progress / 5.0) * 5 as integer) as progress,
        cast(floor(progress / 20.0) * 20 as integer) as coarse from inter""",
        "inter",
    ),
)
def c9(spark, d):
    return I.interactions(spark, d).select(
        USER, ITEM, quantize("progress", 5).alias("progress"), quantize("progress", 20).alias("coarse")
    )


@query(
    "c10_center",
    sql(
        f"""select i.user_id, i.item_id, i.rating, {r6('m')} as mean_user_rating,
        {r6('i.rating - m')} as norm_rating from inter i join (select user_id, avg(rating) as m
        from inter where rating is not null group by user_id) a on a.user_id = i.user_id
        where rating is not null""",
        "inter",
    ),
)
def c10(spark, d):
    rated = I.interactions(spark, d).filter("rating is not null")
    return clean.center_ratings(rated).select(
        USER,
        ITEM,
        "rating",
        steady("mean_user_rating", 6).alias("mean_user_rating"),
        steady("norm_rating", 6).alias("norm_rating"),
    )


# --- folds -------------------------------------------------------------------------------------

EARLY = dt.date(1995, 4, 1)


def main_folds(df: DataFrame) -> DataFrame:
    return folds.make_folds(df, 30, 7)


def early_folds(df: DataFrame) -> DataFrame:
    return folds.make_folds(df, 30, 6, start=EARLY)


@query(
    "s1_folds",
    sql(
        """select 'main' as kind, fold, s as start_date, e as end_date from main_folds union all
        select 'early' as kind, fold, s, e from early_folds""",
        "main_folds",
        "early_folds",
    ),
)
def s1(spark, d):
    df = stored(I.clean_interactions(spark, d))
    both = [
        made.select(
            F.lit(kind).alias("kind"),
            FOLD,
            F.col("start").alias("start_date"),
            F.col("end").alias("end_date"),
        )
        for kind, made in (("main", main_folds(df)), ("early", early_folds(df)))
    ]
    return both[0].unionByName(both[1])


@query(
    "s2_train",
    sql(
        "select fold, user_id, item_id, start_date from main_train where start_date >= date '1996-01-01'",
        "main_train",
    ),
)
def s2(spark, d):
    df = stored(I.clean_interactions(spark, d))
    train = folds.assign_train(df, main_folds(df), train_min_date=dt.date(1996, 1, 1))
    return train.select(FOLD, USER, ITEM, "start_date")


@query("s3_test", sql("select fold, user_id, item_id, start_date from main_test0", "main_test0"))
def s3(spark, d):
    df = stored(I.clean_interactions(spark, d))
    return folds.assign_test(df, main_folds(df)).select(FOLD, USER, ITEM, "start_date")


def _early(spark, d):
    df = stored(I.clean_interactions(spark, d))
    table = early_folds(df)
    return folds.assign_train(df, table), folds.assign_test(df, table)


@query("s4_cold_users", sql("select fold, user_id, item_id from early_test1", "early_test1"))
def s4(spark, d):
    train, test = _early(spark, d)
    return folds.filter_cold(test, train, USER).select(FOLD, USER, ITEM)


@query("s5_cold_items", sql("select fold, user_id, item_id from early_test2", "early_test2"))
def s5(spark, d):
    train, test = _early(spark, d)
    warm = folds.filter_cold(test, train, USER)
    return folds.filter_cold(warm, train, ITEM).select(FOLD, USER, ITEM)


@query(
    "s6_seen",
    sql(
        """select fold, user_id, item_id from (select distinct f.fold, r.user_id, r.item_id
        from inter_raw r join early_folds f on r.start_date >= f.s and r.start_date < f.e) t
        where not exists (select 1 from inter_raw r join early_folds f on r.start_date < f.s
        where f.fold = t.fold and r.user_id = t.user_id and r.item_id = t.item_id)""",
        "inter_raw",
        "early_folds",
    ),
)
def s6(spark, d):
    # Raw rows repeat pairs over time, so a test pair can have been seen before.
    table = early_folds(I.clean_interactions(spark, d))
    raw = I.inter_raw(spark, d)
    test = folds.assign_test(raw, table).select(FOLD, USER, ITEM).distinct()
    return folds.filter_seen(test, folds.assign_train(raw, table))


@query(
    "s6_split",
    sql("select fold, user_id, item_id, start_date from early_test", "early_test"),
)
def s6_split(spark, d):
    df = stored(I.clean_interactions(spark, d))
    _, test = folds.split(df, early_folds(df))
    return test.select(FOLD, USER, ITEM, "start_date")


@query(
    "s7_set_diff",
    sql(
        """select distinct user_id, item_id from inter_raw where (user_id, item_id) not in
        (select (user_id, item_id) from clean)""",
        "clean",
    ),
)
def s7(spark, d):
    return folds.set_diff(I.inter_raw(spark, d), I.clean_interactions(spark, d), [USER, ITEM])


_S8 = """select f.fold, f.s as start_date, f.e as end_date,
 (select count(*) from early_train t where t.fold = f.fold) as train,
 (select count(distinct user_id) from early_test0 t where t.fold = f.fold
   and (t.fold, t.user_id) not in (select (fold, user_id) from early_train)) as new_users,
 (select count(*) from early_test0 t where t.fold = f.fold
   and (t.fold, t.user_id) not in (select (fold, user_id) from early_train)) as new_users_interactions,
 (select count(distinct item_id) from early_test1 t where t.fold = f.fold
   and (t.fold, t.item_id) not in (select (fold, item_id) from early_train)) as new_items,
 (select count(*) from early_test1 t where t.fold = f.fold
   and (t.fold, t.item_id) not in (select (fold, item_id) from early_train)) as new_items_interactions,
 (select count(*) from early_test2 t where t.fold = f.fold) -
 (select count(*) from early_test t where t.fold = f.fold) as known_interactions,
 (select count(*) from early_test t where t.fold = f.fold) as test,
 (select count(*) from early_train_labels t where t.fold = f.fold and target = 1) as train_pos,
 (select count(*) from early_train_labels t where t.fold = f.fold and target = 0) as train_neg,
 (select count(*) from early_test_labels t where t.fold = f.fold and target = 1) as test_pos,
 (select count(*) from early_test_labels t where t.fold = f.fold and target = 0) as test_neg
from early_folds f"""


@query("s8_fold_stats", sql(_S8, "early_folds", "early_test", "early_train_labels", "early_test_labels"))
def s8(spark, d):
    df = stored(I.clean_interactions(spark, d))
    return (
        folds.fold_stats(df, early_folds(df))
        .withColumnRenamed("start", "start_date")
        .withColumnRenamed("end", "end_date")
    )


@query(
    "s9_n_folds",
    sql(
        "select (select count(*) from main_folds) as main, (select count(*) from early_folds) as early",
        "main_folds",
        "early_folds",
    ),
)
def s9(spark, d):
    df = stored(I.clean_interactions(spark, d))
    first = folds.n_folds(df, 30, 7)
    second = folds.n_folds(df, 30, 6, start=EARLY)
    return main_folds(df).limit(1).select(
        F.lit(first).cast("bigint").alias("main"), F.lit(second).cast("bigint").alias("early")
    )


@query(
    "s10_holdout",
    sql(
        """select case when start_date < date '2000-06-01' then 'train' else 'test' end as part,
        user_id, item_id, start_date from inter where start_date < date '2001-01-01'""",
        "inter",
    ),
)
def s10(spark, d):
    train, test = folds.holdout(I.interactions(spark, d), dt.date(2000, 6, 1), dt.date(2001, 1, 1))
    cols = [USER, ITEM, "start_date"]
    return train.select(F.lit("train").alias("part"), *cols).unionByName(
        test.select(F.lit("test").alias("part"), *cols)
    )


@query(
    "s11_quantile",
    sql(
        """select case when start_date <= b then 'train' else 'test' end as part, user_id, item_id
        from clean, edge where start_date <= b
        or user_id in (select user_id from clean, edge where start_date <= b)""",
        "clean",
        "edge",
        extra={
            "edge": (
                """select start_date as b from (select start_date, row_number() over (order by start_date) - 1 as i
                from clean) where i = (select cast(floor((count(*) - 1) * 0.6 + 0.5) as bigint) from clean)""",
                ("clean",),
            )
        },
    ),
)
def s11(spark, d):
    train, test = folds.quantile_split(I.clean_interactions(spark, d), 0.6)
    return train.select(F.lit("train").alias("part"), USER, ITEM).unionByName(
        test.select(F.lit("test").alias("part"), USER, ITEM)
    )


@query(
    "s12_split_by_user",
    sql(
        """select user_id, item_id, case when b < 0.7 / (0.7 + 0.21 + 0.09) then 'train'
        when b < 0.7 / (0.7 + 0.21 + 0.09) + 0.21 / (0.7 + 0.21 + 0.09) then 'test' else 'early_stop' end as part
        from (select *, ('0x' || substr(md5(user_id || '-244'), 1, 8))::bigint % 10000 / 10000.0::double as b from inter)""",
        "inter",
    ),
)
def s12(spark, d):
    weights = [("train", 0.7), ("test", 0.21), ("early_stop", 0.09)]
    return folds.split_by_user(I.interactions(spark, d), weights, 244).select(USER, ITEM, "part")


@query(
    "s13_take_fold",
    sql(
        """select i.user_id, i.item_id, i.progress, t.fold from inter i join early_test t
        on t.user_id = i.user_id and t.item_id = i.item_id""",
        "inter",
        "early_test",
    ),
)
def s13(spark, d):
    df = stored(I.clean_interactions(spark, d))
    _, test = folds.split(df, early_folds(df))
    index = test.select(USER, ITEM, FOLD)
    return folds.take_fold(I.interactions(spark, d), index).select(USER, ITEM, "progress", FOLD)


@query(
    "s14_restrict_features",
    sql("select * from users where user_id in (select user_id from early_test)", "users", "early_test"),
)
def s14(spark, d):
    df = stored(I.clean_interactions(spark, d))
    _, test = folds.split(df, early_folds(df))
    return folds.restrict_features(I.users(spark, d), test, USER)


# --- labels ------------------------------------------------------------------------------------

LABEL_CTES = {
    "stats": (
        """select user_id, count(*) as n, avg(progress) as mp, coalesce(avg(rating), 0) as mr
        from inter group by user_id""",
        ("inter",),
    ),
    "judged": (
        """select i.*, case when rating is not null then rating < mr else progress < 10 end as neg
        from inter i join stats s on s.user_id = i.user_id""",
        ("inter", "stats"),
    ),
    "lonely": ("select user_id from judged group by user_id having bool_and(neg)", ("judged",)),
    "labelled": (
        """select user_id, item_id, progress, rating, start_date, 0 as target from judged where neg
        union all select user_id, item_id, progress, rating, start_date, 1 as target from judged
        where not neg or user_id in (select user_id from lonely)""",
        ("judged", "lonely"),
    ),
}


def labelled(spark, d) -> DataFrame:
    df = stored(I.interactions(spark, d))
    return labels.label(df, labels.user_stats(df))


@query(
    "n1_user_stats",
    sql(
        f"""select user_id, n as num_interacted_items, {r6('mp')} as mean_user_progress,
        {r6('mr')} as avg_user_rating from stats""",
        "stats",
        extra=LABEL_CTES,
    ),
)
def n1(spark, d):
    return labels.user_stats(I.interactions(spark, d)).withColumns(
        {c: steady(c, 6) for c in ("mean_user_progress", "avg_user_rating")}
    )


@query(
    "n2_negatives_fixed",
    sql(
        """select t.user_id, t.item_id, 0::tinyint as target from inter t join
        (select user_id, coalesce(avg(rating), 0) as mr from inter
         where start_date < date '1996-01-01' group by user_id) s on s.user_id = t.user_id
        where t.start_date >= date '1996-01-01'
        and case when rating is not null then rating < mr else progress < 10 end""",
        "inter",
    ),
)
def n2(spark, d):
    # Later rows judged with the statistics of the earlier ones; users without any are skipped.
    train, test = folds.holdout(I.interactions(spark, d), dt.date(1996, 1, 1), dt.date(2100, 1, 1))
    found = labels.negatives(test, labels.user_stats(train), "fixed")
    return found.select(USER, ITEM, "target")


@query(
    "n3_negatives_user_mean",
    sql(
        """select i.user_id, i.item_id, 0::tinyint as target from inter i join stats s
        on s.user_id = i.user_id
        where case when rating is not null then rating < mr else progress < mp end""",
        "inter",
        "stats",
        extra=LABEL_CTES,
    ),
)
def n3(spark, d):
    df = I.interactions(spark, d)
    found = labels.negatives(df, labels.user_stats(df), "user_mean")
    return found.select(USER, ITEM, "target")


@query(
    "n4_label",
    sql(
        "select user_id, item_id, progress, rating, start_date, target::tinyint as target from labelled",
        "labelled",
        extra=LABEL_CTES,
    ),
)
def n4(spark, d):
    return labelled(spark, d)


@query(
    "n5_select_pos",
    sql("select user_id, item_id from labelled where target > 0", "labelled", extra=LABEL_CTES),
)
def n5(spark, d):
    return labels.select_pos(labelled(spark, d)).select(USER, ITEM)


SAMPLE_CTES = {
    **LABEL_CTES,
    "pos": ("select user_id, item_id from labelled where target = 1", ("labelled",)),
    "plain_neg": (
        "select l.user_id, l.item_id from labelled l anti join pos p on p.user_id = l.user_id and p.item_id = l.item_id",
        ("labelled", "pos"),
    ),
    "lacking": (
        "select distinct user_id from pos where user_id not in (select user_id from plain_neg)",
        ("pos", "plain_neg"),
    ),
    "pos_w": ("select user_id, item_id, 1.0::double as w from pos", ("pos",)),
    "pos_norm": ("select item_id, sqrt(sum(w * w)) as nn from pos_w group by item_id", ("pos_w",)),
    "pos_sim": (
        """select a.item_id as i, b.item_id as j, floor(sum(a.w * b.w) / (any_value(na.nn) * any_value(nb.nn)) * 1e9 + 0.5) / 1e9 as score
        from pos_w a join pos_w b on a.user_id = b.user_id and a.item_id <> b.item_id
        join pos_norm na on na.item_id = a.item_id join pos_norm nb on nb.item_id = b.item_id
        group by a.item_id, b.item_id""",
        ("pos_w", "pos_norm"),
    ),
    "pos_nbr": (
        """select i, j, score from (select *, row_number() over (partition by i order by score desc, j) as rn
        from pos_sim) where rn <= 10""",
        ("pos_sim",),
    ),
    "extra_recs": (
        """select user_id, item_id from (select *, row_number() over (partition by user_id
        order by score desc, item_id) as rn from (select p.user_id, n.j as item_id,
        floor(sum(n.score) * 1e9 + 0.5) / 1e9 as score from pos p join lacking using (user_id)
        join pos_nbr n on n.i = p.item_id group by p.user_id, n.j) s
        anti join pos p on p.user_id = s.user_id and p.item_id = s.item_id) where rn <= 20""",
        ("pos", "lacking", "pos_nbr"),
    ),
    "samples": (
        """select user_id, item_id, 1 as target from pos union all
        select user_id, item_id, 0 as target from plain_neg union all
        select e.user_id, e.item_id, 0 as target from extra_recs e
        anti join labelled l on l.user_id = e.user_id and l.item_id = e.item_id""",
        ("pos", "plain_neg", "extra_recs", "labelled"),
    ),
}


def samples(spark, d) -> DataFrame:
    marked = stored(labelled(spark, d))
    positives = labels.select_pos(marked)
    neighbors = knn.item_knn(positives, "cosine")
    return labels.build_samples(
        marked, lambda lacking: knn.knn_recommend(lacking, positives, neighbors, 20)
    )


@query(
    "n6_samples",
    sql("select user_id, item_id, target::tinyint as target from samples", "samples", extra=SAMPLE_CTES),
)
def n6(spark, d):
    return samples(spark, d)


@query(
    "n8_triplets",
    sql(
        """select p.user_id, p.item_id as pos_item, n.item_id as neg_item from
        (select user_id, item_id, row_number() over (partition by user_id order by item_id) as p
         from labelled where target = 1) p join
        (select user_id, item_id, row_number() over (partition by user_id order by item_id) as n,
         count(*) over (partition by user_id) as total from labelled where target = 0) n
        on n.user_id = p.user_id and (p.p - 1) % n.total = n.n - 1""",
        "labelled",
        extra=LABEL_CTES,
    ),
)
def n8(spark, d):
    return labels.make_triplets(labelled(spark, d))


@query(
    "n9_label_share",
    sql(
        f"""select target::tinyint as target, {r6('count(*) * 1.0 / (select count(*) from labelled)')} as share
        from labelled group by target""",
        "labelled",
        extra=LABEL_CTES,
    ),
)
def n9(spark, d):
    return labels.label_share(labelled(spark, d)).withColumn("share", steady("share", 6))


@query(
    "n10_sample_report",
    sql(
        f"""select count(*) as users, count(*) filter (where negs > 0) as users_with_neg,
        {r6('avg(case when negs > 0 then 1.0 else 0.0 end)')} as ratio,
        {r6('avg(negs) filter (where negs > 0)')} as mean_negatives
        from (select user_id, count(distinct case when target = 0 then item_id end) as negs
        from labelled group by user_id)""",
        "labelled",
        extra=LABEL_CTES,
    ),
)
def n10(spark, d):
    report = labels.sample_report(labelled(spark, d))
    return report.withColumns({c: steady(c, 6) for c in ("ratio", "mean_negatives")})


# --- profiles ----------------------------------------------------------------------------------


@query(
    "p1_profile",
    sql(
        " union all ".join(
            f"""select '{c}' as "column", count(*) as rows, count(*) - count({c}) as nulls,
            {r6(f'avg({c})')} as mean, {r6(f'stddev_samp({c})')} as std,
            cast(min({c}) as double) as min, cast(max({c}) as double) as max from inter"""
            for c in ("progress", "rating")
        ),
        "inter",
    ),
)
def p1(spark, d):
    found = profile.profile(I.interactions(spark, d), ["progress", "rating"])
    return found.withColumns({c: steady(c, 6) for c in ("mean", "std")})


@query(
    "p2_categorical",
    sql(
        " union all ".join(
            f"""select '{c}' as "column", rows, cardinality, {r6('missing')} as missing, rank, value, n from
            (select {c} as value, count(*) as n, row_number() over (order by count(*) desc, {c}) as rank
             from users where {c} is not null group by {c}),
            (select count(*) as rows, count(distinct {c}) as cardinality,
             (count(*) - count({c})) / count(*) as missing from users) where rank <= 10"""
            for c in ("age", "sex")
        ),
        "users",
    ),
)
def p2(spark, d):
    found = profile.profile_categorical(I.users(spark, d), ["age", "sex"])
    return found.withColumn("missing", steady("missing", 6))


@query(
    "p3_histogram",
    sql(
        f"""select cast(floor(progress / 5.0) * 5 as integer) as bin, count(*) as n,
        {r6('100.0 * count(*) / (select count(*) from inter)')} as percent from inter group by 1""",
        "inter",
    ),
)
def p3(spark, d):
    return profile.histogram(I.interactions(spark, d)).withColumn("percent", steady("percent", 6))


_BINS = {
    "bins": (
        """select user_id, cast(floor(progress / 20.0) * 20 as integer) as bin,
        count(*) as num_interactions from inter group by 1, 2""",
        ("inter",),
    )
}


@query("p4_bin_counts", sql("select * from bins", "bins", extra=_BINS))
def p4(spark, d):
    return profile.bin_counts(I.interactions(spark, d))


@query(
    "p4_box_stats",
    sql(
        """select bin, count(*) as users, min(num_interactions) as min,
        quantile_cont(num_interactions, 0.25) as q25, quantile_cont(num_interactions, 0.5) as median,
        quantile_cont(num_interactions, 0.75) as q75, max(num_interactions) as max
        from bins group by bin""",
        "bins",
        extra=_BINS,
    ),
)
def p4_box(spark, d):
    return profile.box_stats(profile.bin_counts(I.interactions(spark, d)))


@query(
    "p5_vocab_size",
    sql(
        """select 'before' as stage, (select count(*) from (select distinct unnest(string_split(genres, ',')) from items where genres is not null)) +
        (select count(*) from (select 1 from items where genres is null limit 1)) as num_genres union all
        select 'after', (select count(*) from (select distinct unnest(string_split(genres, ',')) from kept_items))""",
        "items",
        "kept_items",
        extra=GENRE_CTES,
    ),
)
def p5(spark, d):
    items = I.items(spark, d)
    before = profile.vocab_size(items).select(F.lit("before").alias("stage"), "num_genres")
    after = profile.vocab_size(clean.select_genres(items, 0.95, "unknown"))
    return before.unionByName(after.select(F.lit("after").alias("stage"), "num_genres"))


@query(
    "p6_distinct",
    sql(
        " union all ".join(
            f"select '{c}' as \"column\", count(distinct {c}) as distinct_values from inter"
            for c in ("user_id", "item_id", "rating")
        ),
        "inter",
    ),
)
def p6(spark, d):
    return profile.distinct_counts(I.interactions(spark, d), [USER, ITEM, "rating"])
