"""The three logical tables as views of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.operators.clean import dedupe_interactions, filter_noise
from tastemill.schema import DATE, ITEM, PROGRESS, RATING, USER
from tastemill.sources.tables import read_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def inter_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as readings: a customer reads a part; duplicates are kept."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    stars = (5 - F.round(F.col("l_discount") * 40).cast("int")).cast("double")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias(USER),
        F.col("l_partkey").alias(ITEM),
        F.col("o_orderdate").cast("date").alias(DATE),
        ((F.col("l_quantity") - 1) * 2).cast("int").alias(PROGRESS),
        F.when(F.col("l_returnflag") != "N", stars).alias(RATING),
    )


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe_interactions(inter_raw(spark, folder))


def clean_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_noise(interactions(spark, folder))


def users(spark: SparkSession, folder: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias(USER),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("age"),
        F.when(balance >= 5000, "1").when(balance >= 0, "0").alias("sex"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    words = F.regexp_replace("p_name", " ", ",")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias(ITEM),
        F.col("p_name").alias("title"),
        F.when(F.col("p_brand") != "Brand#13", F.concat_ws(",", "p_type", words)).alias("genres"),
        F.when(F.col("p_size") <= 45, (1970 + F.col("p_size")).cast("string")).alias("year"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, vec) of the embedding table."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias(ITEM), F.col("embedding").alias("vec")
    )


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, vec): the mean vector of each label stands for a user's vector."""
    cells = table(spark, folder, "embeddings").select(
        F.col("label").cast("bigint").alias(USER), F.posexplode("embedding").alias("pos", "x")
    )
    means = cells.groupBy(USER, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy(USER).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_v"))
    return packed.select(USER, F.transform("_v", lambda c: c["x"]).alias("vec"))


# SQL of the same views: name -> (text, names of the views it reads).
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "inter_raw": (
        """select o_custkey as user_id, l_partkey as item_id, cast(o_orderdate as date) as start_date,
        cast((l_quantity - 1) * 2 as integer) as progress,
        case when l_returnflag = 'N' then null
             else cast(5 - cast(round(l_discount * 40) as integer) as double) end as rating
        from lineitem join orders on l_orderkey = o_orderkey""",
        (),
    ),
    "inter": (
        """select user_id, item_id, max(progress) as progress, max(rating) as rating,
        min(start_date) as start_date from inter_raw group by user_id, item_id""",
        ("inter_raw",),
    ),
    "clean": (
        """select * from inter where progress > 0 and user_id in
        (select user_id from inter where progress > 0 group by user_id having count(*) > 4)""",
        ("inter",),
    ),
    "users": (
        """select c_custkey as user_id, nullif(c_mktsegment, 'MACHINERY') as age,
        case when c_acctbal >= 5000 then '1' when c_acctbal >= 0 then '0' end as sex from customer""",
        (),
    ),
    "items": (
        """select p_partkey as item_id, p_name as title,
        case when p_brand <> 'Brand#13' then p_type || ',' || replace(p_name, ' ', ',') end as genres,
        case when p_size <= 45 then cast(1970 + p_size as varchar) end as year from part""",
        (),
    ),
    "bounds": ("select min(start_date) as lo, max(start_date) as hi from clean", ("clean",)),
    "main_points": (
        """select d from (select hi - cast(30 * (8 - j) as integer) as d, lo, hi
        from bounds, range(0, 8) as t(j)) where d >= lo and d <= hi""",
        ("bounds",),
    ),
    "main_folds": (
        """select fold, s, e from (select cast(row_number() over (order by d) as integer) as fold,
        d as s, lead(d) over (order by d) as e from main_points) where e is not null""",
        ("main_points",),
    ),
    "early_points": (
        """select d from (select date '1995-04-01' + cast(30 * j as integer) as d, lo, hi
        from bounds, range(0, 7) as t(j)) where d >= lo and d <= hi""",
        ("bounds",),
    ),
    "early_folds": (
        """select fold, s, e from (select cast(row_number() over (order by d) as integer) as fold,
        d as s, lead(d) over (order by d) as e from early_points) where e is not null""",
        ("early_points",),
    ),
}
for _kind in ("main", "early"):
    CTES |= {
        f"{_kind}_train": (
            f"select f.fold, c.* from clean c join {_kind}_folds f on c.start_date < f.s",
            ("clean", f"{_kind}_folds"),
        ),
        f"{_kind}_test0": (
            f"""select f.fold, c.* from clean c join {_kind}_folds f
            on c.start_date >= f.s and c.start_date < f.e""",
            ("clean", f"{_kind}_folds"),
        ),
        f"{_kind}_test1": (
            f"""select * from {_kind}_test0 where (fold, user_id) in
            (select (fold, user_id) from {_kind}_train)""",
            (f"{_kind}_test0", f"{_kind}_train"),
        ),
        f"{_kind}_test2": (
            f"""select * from {_kind}_test1 where (fold, item_id) in
            (select (fold, item_id) from {_kind}_train)""",
            (f"{_kind}_test1", f"{_kind}_train"),
        ),
        f"{_kind}_test": (
            f"""select t.* from {_kind}_test2 t where not exists (select 1 from {_kind}_train r
            where r.fold = t.fold and r.user_id = t.user_id and r.item_id = t.item_id)""",
            (f"{_kind}_test2", f"{_kind}_train"),
        ),
        f"{_kind}_stats": (
            f"""select fold, user_id, avg(progress) as mp, coalesce(avg(rating), 0) as mr
            from {_kind}_train group by fold, user_id""",
            (f"{_kind}_train",),
        ),
    }
    for _part in ("train", "test"):
        CTES |= {
            f"{_kind}_{_part}_judged": (
                f"""select t.*, case when s.user_id is null then false
                when rating is not null then rating < mr else progress < 10 end as neg
                from {_kind}_{_part} t left join {_kind}_stats s
                on s.fold = t.fold and s.user_id = t.user_id""",
                (f"{_kind}_{_part}", f"{_kind}_stats"),
            ),
            f"{_kind}_{_part}_labels": (
                f"""select fold, user_id, item_id, progress, rating, start_date, 0 as target
                from {_kind}_{_part}_judged where neg union all
                select fold, user_id, item_id, progress, rating, start_date, 1 as target
                from {_kind}_{_part}_judged j where not neg or not exists
                (select 1 from {_kind}_{_part}_judged p where p.fold = j.fold
                 and p.user_id = j.user_id and not p.neg)""",
                (f"{_kind}_{_part}_judged",),
            ),
        }


def sql(body: str, *views: str, extra: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> str:
    """`body` after a WITH clause of the named views and all they read."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for other in known[name][1]:
            need(other)
        order.append(name)

    for view in views:
        need(view)
    if not order:
        return body
    return "with " + ",\n".join(f"{n} as ({known[n][0]})" for n in order) + "\n" + body


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def rounded(expr: str, digits: int) -> str:
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"
