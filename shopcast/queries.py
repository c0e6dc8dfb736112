"""Registered queries: one Spark callable and (where SQL can say it) one DuckDB
oracle per operator of the survey.

Every query runs over the whole input tables: the per-user strategies are
answered for every user, the per-product ones for every product. Parameters
are fixed here and identical on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.operators import clustering, spine
from shopcast.operators import ratings as ratings_op
from shopcast.plans import employees, features, forecast, products, recommend, training
from shopcast.session import compact, materialize, scratch_dir
from shopcast.sources.tables import (ingest_records, mapping_ctes, tpch_employee_records, tpch_product_records, tpch_tables,
                                     user_lookup)

AS_OF = dt.datetime(2001, 8, 1)
DAYS = 30
LIMIT = 50
FORECAST_START = dt.date(2000, 1, 1)
FORECAST_END = dt.date(2000, 12, 31)
SERIES = "priority"
KNN_K = 10
KNN_NEIGHBOURS = 40
MIN_RATING = 3.0
MIN_PURCHASES = 100
MIN_RECENT = 25

QueryFn = Callable[[SparkSession, str], DataFrame]


def _all_users(t) -> DataFrame:
    return t.users.select(F.col("id").alias("user_id"))


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def q_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.popular_products(tpch_tables(spark, sf_dir), limit=LIMIT)


def q_popular_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.popular_products(tpch_tables(spark, sf_dir), limit=LIMIT, semantics="reference")


def q_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.trending_products(tpch_tables(spark, sf_dir), as_of=AS_OF, days=DAYS, limit=LIMIT)


def q_trending_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.trending_products(tpch_tables(spark, sf_dir), as_of=AS_OF, days=DAYS, limit=LIMIT,
                                       semantics="reference")


def q_similar_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch_tables(spark, sf_dir)
    return recommend.similar_users(t, _all_users(t), limit=LIMIT)


def q_personalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch_tables(spark, sf_dir)
    return recommend.personalized(t, _all_users(t), limit=LIMIT)


def _round_log(df: DataFrame) -> DataFrame:
    # DuckDB has no log1p; ln(1 + x) may differ in the last bit, so the
    # check compares price_log at 9 decimals.
    return df.withColumn("price_log", F.round("price_log", 9))


def q_popular_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.popular_products(tpch_tables(spark, sf_dir), MIN_RATING, MIN_PURCHASES, limit=LIMIT)


def q_trending_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.trending_products(tpch_tables(spark, sf_dir), as_of=AS_OF, days=DAYS, min_rating=MIN_RATING,
                                       min_purchases=MIN_RECENT, limit=LIMIT)


def q_similar_users_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch_tables(spark, sf_dir)
    return recommend.similar_users(t, _all_users(t), limit=LIMIT, semantics="reference")


def q_personalized_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch_tables(spark, sf_dir)
    return recommend.personalized(t, _all_users(t), limit=LIMIT, semantics="reference")


def q_monthly_sales_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.monthly_sales(spine.sale_lines(tpch_tables(spark, sf_dir)), "all", series="product_id")


def q_product_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_log(features.product_features(tpch_tables(spark, sf_dir)))


def q_product_features_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_log(features.product_features(tpch_tables(spark, sf_dir), semantics="reference"))


def q_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings_op.ratings(tpch_tables(spark, sf_dir))


def q_known_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch_tables(spark, sf_dir)
    return spine.known_products(t, _all_users(t))


def q_user_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch_tables(spark, sf_dir)
    return user_lookup(t, t.users.select("email"))


def q_monthly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.monthly_sales(tpch_tables(spark, sf_dir).sale, FORECAST_START, FORECAST_END)


def q_monthly_sales_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.monthly_sales(tpch_tables(spark, sf_dir).sale, "all", series=SERIES)


def q_sales_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = forecast.monthly_sales(tpch_tables(spark, sf_dir).sale, FORECAST_START, FORECAST_END)
    return forecast.sales_forecast(monthly)


def q_sales_forecast_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.sales_forecast(forecast.monthly_sales(tpch_tables(spark, sf_dir).sale, "all"))


def q_sales_forecast_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = forecast.monthly_sales(tpch_tables(spark, sf_dir).sale, "all", series=SERIES)
    return forecast.sales_forecast(monthly, series=SERIES)


def q_product_performance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.product_performance(tpch_product_records(spark, sf_dir))


def q_product_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.product_summary(products.product_performance(tpch_product_records(spark, sf_dir)))


def q_product_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.product_tiers(tpch_product_records(spark, sf_dir))


def q_product_tier_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.tier_silhouette(q_product_tiers(spark, sf_dir))


def q_employee_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employees.employee_scores(tpch_employee_records(spark, sf_dir))


def q_employee_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tpch_employee_records(spark, sf_dir)
    out = employees.employee_performance(records, employees.fit(records, parts=("clusters",)))
    return out.select("employee_id", "performance_cluster", "performance_score")


def q_employee_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tpch_employee_records(spark, sf_dir)
    out = employees.employee_performance(records, employees.fit(records, parts=("anomalies",)))
    return out.select("employee_id", "is_anomaly")


def q_employee_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employees.employee_performance(tpch_employee_records(spark, sf_dir))


def q_recommender_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.evaluate(tpch_tables(spark, sf_dir), k=KNN_K)


def q_recommend_by_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch_tables(spark, sf_dir)
    return recommend.recommend(t, "similar_users", emails=t.users.select("email"), limit=LIMIT)


def q_recommend_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.recommend(tpch_tables(spark, sf_dir), limit=LIMIT)


def q_recommend_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.recommend(tpch_tables(spark, sf_dir), "trending", as_of=AS_OF, limit=LIMIT)


def q_recommend_personalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch_tables(spark, sf_dir)
    return recommend.recommend(t, "personalized", emails=t.users.select("email"), limit=LIMIT)


def q_recommend_collaborative(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch_tables(spark, sf_dir)
    return recommend.recommend(t, "collaborative", users=_all_users(t), limit=LIMIT)


def q_recommend_content_based(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch_tables(spark, sf_dir)
    return recommend.recommend(t, "content_based", targets=t.product.select(F.col("id").alias("product_id")), limit=LIMIT)


def q_item_similarity_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities kept up to date: from ratings without fold 1 and with fold 2 at 1.0 to those of folds 1 and 2 as they are."""
    r = compact(ratings_op.ratings(tpch_tables(spark, sf_dir))).withColumn("fold", ratings_op.fold_of(3))
    before = compact(r.where("fold <> 1").select("user_id", "product_id", F.when(F.col("fold") == 2, F.lit(1.0)).otherwise(F.col("rating")).alias("rating")))
    changes = compact(ratings_op.rating_changes(before, r.where("fold <> 0").select("user_id", "product_id", "rating")))
    statistics = compact(ratings_op.pair_statistics(before))
    sim = ratings_op.similarity_of(ratings_op.update_statistics(statistics, before, changes))
    return sim.withColumn("similarity", F.round("similarity", 6))


def q_employee_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employee records written as lines of JSON, some damaged, and read again: records and tasks by outcome."""
    records = tpch_employee_records(spark, sf_dir)
    whole, key = F.to_json(F.struct(*records.columns)), F.col("employee_id")
    line = (F.when(key % 11 == 0, F.substring(whole, 1, 20)).when(key % 7 == 0, F.concat(F.lit('{"employee_id":'), key.cast("string"), F.lit(',"completed_tasks":"n/a"}')))
            .when(key % 5 == 0, F.lit('{"completed_tasks":1}')).otherwise(whole))
    path = scratch_dir(spark, "employee_records")
    records.select(line.alias("value")).write.text(path)
    got = ingest_records(spark, path, "employee_record", "employee_id", multi_line=False)
    out = (got.accepted.select(F.lit("accepted").alias("status"), F.lit("").alias("reason"), "completed_tasks")
           .unionByName(got.rejected.select(F.lit("rejected").alias("status"), "reason", F.lit(0.0).alias("completed_tasks"))))
    read = F.lit(got.counts["accepted"] + got.counts["rejected"]).cast("long")
    return out.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("records"), F.sum(F.coalesce("completed_tasks", F.lit(0.0))).alias("completed_tasks")).withColumn("read", read)


def q_content_based(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch_tables(spark, sf_dir)
    return features.content_based(t, t.product.select(F.col("id").alias("product_id")), limit=LIMIT)


def q_content_holdout_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.holdout_distance(tpch_tables(spark, sf_dir), k=KNN_K)


def q_embedding_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopcast.operators.knn import as_vectors, cosine_topk
    vecs = as_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", array_col="embedding")
    top = cosine_topk(vecs, vecs, KNN_K)
    return top.select(F.col("query_id").alias("vec_id"), F.col("item_id").alias("neighbour_id"), "similarity")


def q_item_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = ratings_op.item_similarity(materialize(ratings_op.ratings(tpch_tables(spark, sf_dir))))
    return sim.withColumn("similarity", F.round("similarity", 9))


def q_collaborative(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tpch_tables(spark, sf_dir)
    return recommend.collaborative(t, _all_users(t), limit=LIMIT)


def q_collaborative_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings_op.cross_validate(ratings_op.ratings(tpch_tables(spark, sf_dir)), folds=3)


QUERIES: dict[str, QueryFn] = {
    "popular": q_popular,
    "popular_reference": q_popular_reference,
    "trending": q_trending,
    "trending_reference": q_trending_reference,
    "similar_users": q_similar_users,
    "personalized": q_personalized,
    "popular_min": q_popular_min,
    "trending_min": q_trending_min,
    "similar_users_reference": q_similar_users_reference,
    "personalized_reference": q_personalized_reference,
    "monthly_sales_by_product": q_monthly_sales_by_product,
    "product_features": q_product_features,
    "product_features_reference": q_product_features_reference,
    "ratings": q_ratings,
    "known_products": q_known_products,
    "user_lookup": q_user_lookup,
    "monthly_sales": q_monthly_sales,
    "monthly_sales_by_priority": q_monthly_sales_by_priority,
    "sales_forecast": q_sales_forecast,
    "sales_forecast_all": q_sales_forecast_all,
    "sales_forecast_by_priority": q_sales_forecast_by_priority,
    "product_performance_score": q_product_performance_score,
    "product_summary": q_product_summary,
    "product_tiers": q_product_tiers,
    "product_tier_silhouette": q_product_tier_silhouette,
    "employee_score": q_employee_score,
    "employee_clusters": q_employee_clusters,
    "employee_anomalies": q_employee_anomalies,
    "employee_performance": q_employee_performance,
    "recommender_evaluation": q_recommender_evaluation,
    "recommend_by_email": q_recommend_by_email,
    "recommend_popular": q_recommend_popular,
    "recommend_trending": q_recommend_trending,
    "recommend_personalized": q_recommend_personalized,
    "recommend_collaborative": q_recommend_collaborative,
    "recommend_content_based": q_recommend_content_based,
    "item_similarity_updated": q_item_similarity_updated,
    "employee_ingest": q_employee_ingest,
    "content_based": q_content_based,
    "content_holdout_distance": q_content_holdout_distance,
    "embedding_knn": q_embedding_knn,
    "item_similarity": q_item_similarity,
    "collaborative": q_collaborative,
    "collaborative_cv": q_collaborative_cv,
}


# --------------------------------------------------------------------------
# DuckDB oracles (written independently, mostly in the reference's literal
# join form; all tables come from the same mapping CTEs)
# --------------------------------------------------------------------------

_SINCE = (AS_OF - dt.timedelta(days=DAYS)).strftime("%Y-%m-%d %H:%M:%S")

_SPINE = """
ok as (select id from sale where status = 'completed'{since}),
per_product as (
  select st.product_id,
         sum(d.quantity) as units_all,
         sum(case when ok.id is not null then d.quantity end) as units_ok,
         count(ok.id) as lines_ok
  from sale_detail d join stock st on st.id = d.stock_id
  left join ok on ok.id = d.sale_id
  group by st.product_id),
rv as (select product_id, avg(rating) as avg_rating, count(id) as n_reviews from review group by product_id)
"""

ORACLES: dict[str, str] = {}

ORACLES["popular"] = mapping_ctes() + "," + _SPINE.format(since="") + f"""
select p.id as product_id, p.name as product_name,
       cast(coalesce(pp.units_ok, 0) as bigint) as total_purchases,
       coalesce(rv.avg_rating, 0) as average_rating
from product p left join per_product pp on pp.product_id = p.id
left join rv on rv.product_id = p.id
order by coalesce(pp.units_ok, 0) desc, p.id
limit {LIMIT}
"""

ORACLES["popular_reference"] = mapping_ctes() + f"""
select p.id as product_id, p.name as product_name,
       cast(coalesce(sum(sd.quantity), 0) as bigint) as total_purchases,
       coalesce(avg(r.rating), 0) as average_rating
from product p
left join stock st on p.id = st.product_id
left join sale_detail sd on st.id = sd.stock_id
left join sale s on sd.sale_id = s.id and s.status = 'completed'
left join review r on p.id = r.product_id
group by p.id, p.name
having coalesce(avg(r.rating), 0) >= 0 and coalesce(sum(sd.quantity), 0) >= 0
order by coalesce(sum(sd.quantity), 0) desc, p.id
limit {LIMIT}
"""

ORACLES["trending"] = mapping_ctes() + "," + _SPINE.format(since=f" and created_at >= timestamp '{_SINCE}'") + f"""
select p.id as product_id, p.name as product_name,
       cast(coalesce(pp.units_ok, 0) as bigint) as total_purchases,
       coalesce(rv.avg_rating, 0) as average_rating,
       coalesce(pp.lines_ok, 0) * coalesce(rv.avg_rating, 0) as trend_score
from product p left join per_product pp on pp.product_id = p.id
left join rv on rv.product_id = p.id
order by trend_score desc, p.id
limit {LIMIT}
"""

ORACLES["trending_reference"] = mapping_ctes() + f"""
select p.id as product_id, p.name as product_name,
       cast(coalesce(sum(sd.quantity), 0) as bigint) as total_purchases,
       coalesce(avg(r.rating), 0) as average_rating,
       coalesce(count(s.id), 0) * coalesce(avg(r.rating), 0) as trend_score
from product p
left join stock st on p.id = st.product_id
left join sale_detail sd on st.id = sd.stock_id
left join sale s on sd.sale_id = s.id and s.status = 'completed' and s.created_at >= timestamp '{_SINCE}'
left join review r on p.id = r.product_id
group by p.id, p.name
having coalesce(avg(r.rating), 0) >= 0 and coalesce(sum(sd.quantity), 0) >= 0
order by coalesce(count(s.id), 0) * coalesce(avg(r.rating), 0) desc, p.id
limit {LIMIT}
"""

_BUY = """
buy as (
  select s.user_id, st.product_id, count(*) as lines
  from sale s join sale_detail d on d.sale_id = s.id join stock st on st.id = d.stock_id
  where s.status = 'completed' and s.user_id is not null
  group by s.user_id, st.product_id)
"""

ORACLES["similar_users"] = mapping_ctes() + "," + _BUY + f""",
mine as (select user_id, product_id from buy where user_id in (select id from users)),
nb as (select distinct m.user_id, b.user_id as other
       from mine m join buy b on b.product_id = m.product_id where b.user_id <> m.user_id),
cnt as (select n.user_id, b.product_id, sum(b.lines) as lines
        from nb n join buy b on b.user_id = n.other
        where not exists (select 1 from mine m where m.user_id = n.user_id and m.product_id = b.product_id)
        group by n.user_id, b.product_id),
rv as (select product_id, avg(rating) as avg_rating from review group by product_id),
scored as (
  select c.user_id, c.product_id, p.name as product_name,
         cast(c.lines as bigint) as purchased_by_similar_users,
         coalesce(rv.avg_rating, 0) as average_rating
  from cnt c join product p on p.id = c.product_id left join rv on rv.product_id = c.product_id),
ranked as (
  select *, row_number() over (partition by user_id order by purchased_by_similar_users desc, product_id) as rn
  from scored)
select user_id, product_id, product_name, purchased_by_similar_users, average_rating
from ranked where rn <= {LIMIT}
"""

# Brute force: every user scored against every product.
ORACLES["personalized"] = mapping_ctes() + "," + _SPINE.format(since="") + "," + _BUY + f""",
stats as (
  select p.id as product_id, p.name as product_name, coalesce(pp.units_ok, 0) as t, coalesce(rv.avg_rating, 0) as a
  from product p left join per_product pp on pp.product_id = p.id left join rv on rv.product_id = p.id),
ua as (
  select u.id as user_id, coalesce(nullif(r.av, 0), 3.0) as user_avg
  from users u left join (select user_id, avg(rating) as av from review group by user_id) r on r.user_id = u.id),
scored as (
  select ua.user_id, s.product_id, s.product_name, cast(s.t as bigint) as total_purchases,
         s.a as average_rating, s.t * (5 - abs(s.a - ua.user_avg)) as score
  from ua cross join stats s
  where not exists (select 1 from buy b where b.user_id = ua.user_id and b.product_id = s.product_id)),
ranked as (select *, row_number() over (partition by user_id order by score desc, product_id) as rn from scored)
select user_id, product_id, product_name, total_purchases, average_rating, score from ranked where rn <= {LIMIT}
"""

ORACLES["product_features"] = mapping_ctes() + f""",
units as (select st.product_id, sum(d.quantity) as units_all
          from sale_detail d join stock st on st.id = d.stock_id group by st.product_id),
rv as (select product_id, avg(rating) as avg_rating, count(id) as n_reviews from review group by product_id)
select p.id as product_id, p.name, cast(p.price as double) as price,
       coalesce(rv.avg_rating, 0) as avg_rating,
       cast(coalesce(rv.n_reviews, 0) as bigint) as review_count,
       coalesce(u.units_all, 0) as total_sales,
       round(ln(1 + cast(p.price as double)), 9) as price_log,
       coalesce(rv.n_reviews, 0) * coalesce(rv.avg_rating, 0) as popularity
from product p left join units u on u.product_id = p.id left join rv on rv.product_id = p.id
"""

ORACLES["product_features_reference"] = mapping_ctes() + f""",
chain as (
  select p.id as product_id, p.name, p.price,
         coalesce(avg(r.rating), 0) as avg_rating,
         coalesce(count(r.id), 0) as review_count,
         coalesce(sum(sd.quantity), 0) as total_sales
  from product p
  left join review r on p.id = r.product_id
  left join stock st on p.id = st.product_id
  left join sale_detail sd on st.id = sd.stock_id
  left join sale s on sd.sale_id = s.id
  group by p.id, p.name, p.price)
select product_id, name, cast(price as double) as price, avg_rating, cast(review_count as bigint) as review_count,
       total_sales, round(ln(1 + cast(price as double)), 9) as price_log, review_count * avg_rating as popularity
from chain
"""

ORACLES["ratings"] = mapping_ctes() + """,
r as (
  select user_id, product_id, rating from review
  where rating is not null and user_id is not null and product_id is not null
  union all
  select s.user_id, st.product_id, 4.0E0 as rating
  from sale s join sale_detail d on d.sale_id = s.id join stock st on st.id = d.stock_id
  where s.status = 'completed' and s.user_id is not null)
select user_id, product_id, avg(rating) as rating from r group by user_id, product_id
"""

ORACLES["known_products"] = mapping_ctes() + """
select distinct st.product_id, s.user_id
from sale s join sale_detail d on d.sale_id = s.id join stock st on st.id = d.stock_id
where s.status = 'completed' and s.user_id in (select id from users)
union
select product_id, user_id from review where product_id is not null and user_id in (select id from users)
"""

ORACLES["user_lookup"] = mapping_ctes() + """
select e.email, min(u.id) as user_id
from (select distinct email from users) e join users u on u.email = e.email
group by e.email
"""

_MONTHLY = """
s as (select * from sale where status = 'completed'{where}),
m as (select {key} as k, date_trunc('month', created_at) as mth,
             cast(sum(cast(grand_total as decimal(18,2))) as double) as total_sales,
             count(id) as transaction_count
      from s group by all),
b as (select k, min(mth) as lo, max(mth) as hi from m group by k),
sp as (select k, unnest(generate_series(lo, hi, interval 1 month)) as mth from b),
g as (select sp.k, sp.mth, coalesce(m.total_sales, 0) as total_sales,
             cast(coalesce(m.transaction_count, 0) as bigint) as transaction_count
      from sp left join m on m.k = sp.k and m.mth = sp.mth)
"""

_RANGE = (" and created_at >= timestamp '2000-01-01 00:00:00'"
          " and created_at < timestamp '2001-01-01 00:00:00'")

ORACLES["monthly_sales"] = mapping_ctes() + "," + _MONTHLY.format(where=_RANGE, key="0") + """
select total_sales, transaction_count, strftime(mth, '%b') as month, strftime(mth, '%Y-%m') as period from g
"""

ORACLES["monthly_sales_by_priority"] = mapping_ctes() + "," + _MONTHLY.format(where="", key="priority") + """
select k as priority, total_sales, transaction_count, strftime(mth, '%b') as month, strftime(mth, '%Y-%m') as period
from g
"""

_FORECAST = """,
x as (select k, total_sales as y,
             (year(mth) - year(min(mth) over w)) * 12 + month(mth) - month(min(mth) over w) as x,
             count(*) over w as n
      from g window w as (partition by k)),
fit as (select k, any_value(n) as n,
               regr_slope(y, x) filter (where x < n - ceil(0.2 * n)) as b1,
               regr_intercept(y, x) filter (where x < n - ceil(0.2 * n)) as b0,
               arg_max(y, x) as cur,
               max(case when x = n - 2 then y end) as prev
        from x group by k),
err as (select x.k, avg(abs(y - (b0 + b1 * x))) as mae, avg(y) as mean_test,
               stddev_pop(y - (b0 + b1 * x)) as sd
        from x join fit on fit.k = x.k where x >= x.n - ceil(0.2 * x.n) group by x.k),
res as (select fit.k, fit.n, b0 + b1 * fit.n as f, coalesce(sd, 0) as sd,
               coalesce(greatest(0, 100 - mae / nullif(mean_test, 0) * 100), 0) as acc,
               case when prev > 0 then (cur - prev) / prev * 100 else 0 end as growth
        from fit left join err on err.k = fit.k)
select {key_out}
       case when n >= 3 then round(f, 2) else 0 end as next_month_forecast,
       case when n >= 3 then round(least(90 + n * 2, 95), 2) else 0 end as confidence_level,
       case when n >= 3 then round(greatest(0, f - 1.5 * sd), 2) else 0 end as expected_range_low,
       case when n >= 3 then round(f + 1.5 * sd, 2) else 0 end as expected_range_high,
       case when n >= 3 then round(growth, 2) else 0 end as growth_rate,
       case when n >= 3 then round(acc, 2) else 0 end as model_accuracy
from res
"""

ORACLES["sales_forecast"] = (mapping_ctes() + "," + _MONTHLY.format(where=_RANGE, key="0")
                             + _FORECAST.format(key_out=""))
ORACLES["sales_forecast_all"] = (mapping_ctes() + "," + _MONTHLY.format(where="", key="0")
                                 + _FORECAST.format(key_out=""))
ORACLES["sales_forecast_by_priority"] = (mapping_ctes() + "," + _MONTHLY.format(where="", key="priority")
                                         + _FORECAST.format(key_out="k as priority,"))

_PRODUCT_SCORE = """,
c as (select * from product_record
      where product_id is not null and name is not null and price is not null
        and units_sold is not null and stock is not null),
f as (select *, price * units_sold as revenue,
             case when stock + units_sold <> 0 then units_sold / (stock + units_sold) end as stock_ratio,
             case when price <> 0 then units_sold / price end as sales_velocity
      from c),
mm as (select min(revenue) as r0, max(revenue) as r1, min(stock_ratio) as s0, max(stock_ratio) as s1,
              min(sales_velocity) as v0, max(sales_velocity) as v1 from f),
sc as (select f.*,
              coalesce(case when r1 > r0 then (revenue - r0) / (r1 - r0) else 0 end, 0) as revenue_scaled,
              coalesce(case when s1 > s0 then (stock_ratio - s0) / (s1 - s0) else 0 end, 0) as stock_ratio_scaled,
              coalesce(case when v1 > v0 then (sales_velocity - v0) / (v1 - v0) else 0 end, 0)
                as sales_velocity_scaled,
              stock_ratio is null or sales_velocity is null as is_degenerate
       from f, mm),
scored as (select *, (0.0E0 + 0.5E0 * revenue_scaled + 0.3E0 * stock_ratio_scaled + 0.2E0 * sales_velocity_scaled)
                     * 100.0E0 as performance_score
           from sc)
"""

ORACLES["product_performance_score"] = mapping_ctes() + _PRODUCT_SCORE + """
select product_id, name, price, units_sold, stock, revenue, stock_ratio, sales_velocity, is_degenerate,
       revenue_scaled, stock_ratio_scaled, sales_velocity_scaled, performance_score
from scored
"""

ORACLES["product_summary"] = mapping_ctes() + _PRODUCT_SCORE + """
select round(avg(performance_score), 1) as avg_score,
       first(name order by performance_score desc, product_id) as top_product,
       round(sum(revenue), 2) as total_revenue
from scored
"""

ORACLES["employee_score"] = mapping_ctes() + """,
f as (select employee_id, coalesce(completed_tasks, 0) as completed_tasks, coalesce(total_tasks, 0) as total_tasks,
             coalesce(avg_task_hours, 0) as avg_task_hours
      from employee_record),
r as (select *, case when total_tasks > 0 then completed_tasks / total_tasks else 0 end as completion_rate from f),
s as (select *, 0.4E0 * completion_rate + 0.3E0 * (1.0E0 - avg_task_hours) + 0.3E0 * completed_tasks as raw from r),
mm as (select min(raw) as lo, max(raw) as hi from s)
select employee_id, completed_tasks, total_tasks, avg_task_hours, completion_rate,
       case when hi > lo then (raw - lo) / (hi - lo) else 0 end * 100.0E0 as performance_score
from s, mm
"""

_FEATURES = """,
units as (select st.product_id, sum(d.quantity) as units_all
          from sale_detail d join stock st on st.id = d.stock_id group by st.product_id),
rv as (select product_id, avg(rating) as avg_rating, count(id) as n_reviews from review group by product_id),
feat as (select p.id as product_id, p.name, cast(p.price as double) as price,
                coalesce(rv.avg_rating, 0) as avg_rating, cast(coalesce(rv.n_reviews, 0) as double) as review_count,
                coalesce(u.units_all, 0) as total_sales, ln(1 + cast(p.price as double)) as price_log,
                coalesce(rv.n_reviews, 0) * coalesce(rv.avg_rating, 0) as popularity
         from product p left join units u on u.product_id = p.id left join rv on rv.product_id = p.id)
"""

# Spark computes price_log with log1p; DuckDB only has ln(1 + x). The two may
# differ in the last bit, which the 9-decimal rounding of similarities absorbs.
_SCALED = """,
mm as (select {stats} from {fit}),
vec as (select product_id, {scaled} from {rows}, mm)
"""

_COLS = ["price", "avg_rating", "review_count", "total_sales", "price_log", "popularity"]


def _scaled(rows: str, fit: str, name: str) -> str:
    stats = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in _COLS)
    scaled = ", ".join(f"case when hi_{c} > lo_{c} then ({c} - lo_{c}) / (hi_{c} - lo_{c}) else 0 end as x_{c}"
                       for c in _COLS)
    return _SCALED.format(stats=stats, fit=fit, scaled=scaled, rows=rows).replace("mm as", f"mm_{name} as") \
        .replace("vec as", f"{name} as").replace(", mm)", f", mm_{name})")


def _cos(a: str, b: str) -> str:
    dot = "0.0E0 + " + " + ".join(f"{a}.x_{c} * {b}.x_{c}" for c in _COLS)
    na = "0.0E0 + " + " + ".join(f"{a}.x_{c} * {a}.x_{c}" for c in _COLS)
    nb = "0.0E0 + " + " + ".join(f"{b}.x_{c} * {b}.x_{c}" for c in _COLS)
    return f"case when ({na}) > 0 and ({nb}) > 0 then ({dot}) / sqrt(({na}) * ({nb})) else 0 end"


ORACLES["content_based"] = mapping_ctes() + _FEATURES + _scaled("feat", "feat", "v") + f""",
pairs as (select a.product_id as target_id, b.product_id, round({_cos("a", "b")}, 9) as similarity_score
          from v a join v b on a.product_id <> b.product_id),
ranked as (select *, row_number() over (partition by target_id order by similarity_score desc, product_id) as rn
           from pairs)
select r.target_id, r.product_id, f.name as product_name, r.similarity_score, f.price, f.avg_rating as average_rating
from ranked r join feat f on f.product_id = r.product_id
where rn <= {LIMIT}
"""

_TRAIN = "(((product_id * 7919 + 13) % 100 + 100) % 100) < 80"

ORACLES["content_holdout_distance"] = (
    mapping_ctes() + _FEATURES
    + f""",
train as (select * from feat where {_TRAIN}),
test as (select * from feat where not ({_TRAIN}))"""
    + _scaled("train", "train", "vtr") + _scaled("test", "train", "vte")
    + f""",
pairs as (select a.product_id as q, b.product_id as i, round({_cos("a", "b")}, 9) as s
          from vte a cross join vtr b),
ranked as (select *, row_number() over (partition by q order by s desc, i) as rn from pairs)
select round(avg(1 - s), 9) as mean_distance, count(distinct q) as test_products, count(*) as neighbours
from ranked where rn <= {KNN_K}
""")

ORACLES["embedding_knn"] = f"""
with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
pairs as (
  select a.vec_id, b.vec_id as neighbour_id,
         round(case when list_dot_product(a.v, a.v) > 0 and list_dot_product(b.v, b.v) > 0
                    then list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))
                    else 0 end, 9) as similarity
  from e a join e b on a.vec_id <> b.vec_id),
ranked as (select *, row_number() over (partition by vec_id order by similarity desc, neighbour_id) as rn from pairs)
select vec_id, neighbour_id, similarity from ranked where rn <= {KNN_K}
"""

_RATINGS = """,
r0 as (
  select user_id, product_id, rating from review
  where rating is not null and user_id is not null and product_id is not null
  union all
  select s.user_id, st.product_id, 4.0E0 as rating
  from sale s join sale_detail d on d.sale_id = s.id join stock st on st.id = d.stock_id
  where s.status = 'completed' and s.user_id is not null),
r as (select user_id, product_id, avg(rating) as rating from r0 group by user_id, product_id)
"""

_SIM = """
select a.product_id as i, b.product_id as j,
       sum(a.rating * b.rating) / sqrt(sum(a.rating * a.rating) * sum(b.rating * b.rating)) as s
from r a join r b on a.user_id = b.user_id and a.product_id <> b.product_id
group by a.product_id, b.product_id
"""

ORACLES["item_similarity"] = mapping_ctes() + _RATINGS + f""",
sim as ({_SIM})
select i as item_i, j as item_j, round(s, 9) as similarity from sim
"""

ORACLES["collaborative"] = mapping_ctes() + _RATINGS + f""",
sim as ({_SIM}),
mu as (select avg(rating) as m from r),
known as (
  select distinct s.user_id, st.product_id
  from sale s join sale_detail d on d.sale_id = s.id join stock st on st.id = d.stock_id
  where s.status = 'completed' and s.user_id is not null
  union
  select user_id, product_id from review where product_id is not null and user_id is not null),
nb as (
  select r.user_id, sim.i as product_id, round(sim.s, 9) as s, r.rating as rj, r.product_id as j
  from r join sim on sim.j = r.product_id
  where sim.s > 0 and r.user_id in (select id from users)
    and not exists (select 1 from known k where k.user_id = r.user_id and k.product_id = sim.i)),
top as (select *, row_number() over (partition by user_id, product_id order by s desc, j) as rn from nb),
est as (select user_id, product_id, sum(s * rj) / sum(s) as e from top where rn <= {KNN_NEIGHBOURS}
        group by user_id, product_id),
cand as (
  select u.id as user_id, p.id as product_id from users u cross join product p
  where not exists (select 1 from known k where k.user_id = u.id and k.product_id = p.id)),
pred as (
  select c.user_id, c.product_id,
         round(least(5, greatest(1, coalesce(est.e, (select m from mu)))), 9) as prediction
  from cand c left join est on est.user_id = c.user_id and est.product_id = c.product_id),
ranked as (select *, row_number() over (partition by user_id order by prediction desc, product_id) as rn from pred)
select x.user_id, x.product_id, p.name as product_name, x.prediction as predicted_rating,
       cast(p.price as double) as price
from ranked x join product p on p.id = x.product_id
where x.rn <= {LIMIT}
"""

ORACLES["collaborative_cv"] = mapping_ctes() + _RATINGS + f""",
rf as (select *, ((user_id * 31 + product_id) % 3 + 3) % 3 as fold from r),
folds as (select unnest([0, 1, 2]) as f),
train as (select folds.f, rf.user_id, rf.product_id, rf.rating from folds join rf on rf.fold <> folds.f),
test as (select folds.f, rf.user_id, rf.product_id, rf.rating from folds join rf on rf.fold = folds.f),
sim as (
  select a.f, a.product_id as i, b.product_id as j,
         sum(a.rating * b.rating) / sqrt(sum(a.rating * a.rating) * sum(b.rating * b.rating)) as s
  from train a join train b on a.f = b.f and a.user_id = b.user_id and a.product_id <> b.product_id
  group by a.f, a.product_id, b.product_id),
mu as (select f, avg(rating) as m from train group by f),
nb as (
  select t.f, t.user_id, t.product_id, round(sim.s, 9) as s, tr.rating as rj, tr.product_id as j
  from test t join train tr on tr.f = t.f and tr.user_id = t.user_id
  join sim on sim.f = t.f and sim.i = t.product_id and sim.j = tr.product_id
  where sim.s > 0),
top as (select *, row_number() over (partition by f, user_id, product_id order by s desc, j) as rn from nb),
est as (select f, user_id, product_id, sum(s * rj) / sum(s) as e from top where rn <= {KNN_NEIGHBOURS}
        group by f, user_id, product_id),
pred as (
  select t.f, t.rating, round(least(5, greatest(1, coalesce(est.e, mu.m))), 9) as p
  from test t left join est on est.f = t.f and est.user_id = t.user_id and est.product_id = t.product_id
  join mu on mu.f = t.f)
select f as fold, round(sqrt(avg((p - rating) * (p - rating))), 6) as rmse, round(avg(abs(p - rating)), 6) as mae,
       count(*) as n
from pred group by f
"""


ORACLES["popular_min"] = mapping_ctes() + "," + _SPINE.format(since="") + f"""
select p.id as product_id, p.name as product_name, cast(pp.units_ok as bigint) as total_purchases,
       rv.avg_rating as average_rating
from product p join per_product pp on pp.product_id = p.id join rv on rv.product_id = p.id
where rv.avg_rating >= {MIN_RATING} and pp.units_ok >= {MIN_PURCHASES}
order by pp.units_ok desc, p.id
limit {LIMIT}
"""

ORACLES["trending_min"] = mapping_ctes() + "," + _SPINE.format(since=f" and created_at >= timestamp '{_SINCE}'") + f"""
select p.id as product_id, p.name as product_name, cast(pp.units_ok as bigint) as total_purchases,
       rv.avg_rating as average_rating, pp.lines_ok * rv.avg_rating as trend_score
from product p join per_product pp on pp.product_id = p.id join rv on rv.product_id = p.id
where rv.avg_rating >= {MIN_RATING} and pp.units_ok >= {MIN_RECENT}
order by trend_score desc, p.id
limit {LIMIT}
"""

# The literal chain: details of the neighbours' completed sales times reviews.
ORACLES["similar_users_reference"] = mapping_ctes() + "," + _BUY + f""",
nb as (select distinct m.user_id, b.user_id as other
       from buy m join buy b on b.product_id = m.product_id
       where b.user_id <> m.user_id and m.user_id in (select id from users)),
per_other as (
  select s.user_id as other, st.product_id, count(s.id) as n, sum(r.rating) as rating_sum, count(r.rating) as rating_n
  from sale s join sale_detail d on d.sale_id = s.id join stock st on st.id = d.stock_id
  left join review r on r.product_id = st.product_id
  where s.status = 'completed' and s.user_id is not null
  group by s.user_id, st.product_id),
scored as (
  select nb.user_id, o.product_id, cast(sum(o.n) as bigint) as purchased_by_similar_users
  from nb join per_other o on o.other = nb.other
  where not exists (select 1 from buy m where m.user_id = nb.user_id and m.product_id = o.product_id)
  group by nb.user_id, o.product_id),
rv as (select product_id, avg(rating) as avg_rating from review group by product_id),
ranked as (
  select s.*, p.name as product_name, coalesce(rv.avg_rating, 0) as average_rating,
         row_number() over (partition by s.user_id order by s.purchased_by_similar_users desc, s.product_id) as rn
  from scored s join product p on p.id = s.product_id left join rv on rv.product_id = s.product_id)
select user_id, product_id, product_name, purchased_by_similar_users, average_rating from ranked where rn <= {LIMIT}
"""

ORACLES["personalized_reference"] = mapping_ctes() + "," + _BUY + f""",
stats as (
  select p.id as product_id, p.name as product_name, coalesce(sum(sd.quantity), 0) as t, coalesce(avg(r.rating), 0) as a
  from product p
  left join stock st on p.id = st.product_id
  left join sale_detail sd on st.id = sd.stock_id
  left join sale s on sd.sale_id = s.id and s.status = 'completed'
  left join review r on p.id = r.product_id
  group by p.id, p.name),
ua as (
  select u.id as user_id, coalesce(nullif(r.av, 0), 3.0) as user_avg
  from users u left join (select user_id, avg(rating) as av from review group by user_id) r on r.user_id = u.id),
scored as (
  select ua.user_id, s.product_id, s.product_name, cast(s.t as bigint) as total_purchases,
         s.a as average_rating, s.t * (5 - abs(s.a - ua.user_avg)) as score
  from ua cross join stats s
  where not exists (select 1 from buy b where b.user_id = ua.user_id and b.product_id = s.product_id)),
ranked as (select *, row_number() over (partition by user_id order by score desc, product_id) as rn from scored)
select user_id, product_id, product_name, total_purchases, average_rating, score from ranked where rn <= {LIMIT}
"""

ORACLES["monthly_sales_by_product"] = mapping_ctes() + """,
sale_line as (select s.id, s.status, s.created_at, st.product_id, d.quantity * p.price as grand_total
              from sale s join sale_detail d on d.sale_id = s.id join stock st on st.id = d.stock_id
              join product p on p.id = st.product_id),""" + _MONTHLY.format(where="", key="product_id").replace("from sale ", "from sale_line ") + """
select k as product_id, total_sales, transaction_count, strftime(mth, '%b') as month, strftime(mth, '%Y-%m') as period
from g
"""


def _hash(x: str, salt: str) -> str:
    """``operators.iforest.mixed`` in SQL."""
    one = f"((({x}) % 2147483647 + 1) * ((({salt}) * 7919 + 104729) % 2147483647) % 2147483647)"
    two = f"(xor({one}, {one} >> 15) * 48271 % 2147483647)"
    return f"(xor({two}, {two} >> 13) * 69621 % 2147483647)"


def _kmeans(src: str, cols: list[str], k: int = 3) -> str:
    """CTEs that cluster the rows of ``src``: ``km`` has its columns and ``g``, the number of the cluster.

    The steps of ``operators.clustering``, the Lloyd steps as a recursive CTE.
    """
    row, centre = ", ".join(cols), [f"c{i}" for i in range(len(cols))]
    apart = lambda p, q: " + ".join(["0.0E0", *(f"({p}.{c} - {q}.{c}) * ({p}.{c} - {q}.{c})" for c in cols)])
    draw = lambda salt: f"({_hash('h', str(salt))} / 2147483647.0E0)"
    of = lambda t: ", ".join(f"{t}.{c}" for c in cols)
    steps = [f"km_rows as materialized (select * from {src})",
             f"km_h as materialized (select {row}, count(*) as m, 0::bigint as h from km_rows group by {row})"]
    for j, c in enumerate(cols):
        value = f"((cast(floor({c} * 1e6 + 0.5E0) as bigint) % 2147483647 + 2147483647) % 2147483647)"
        steps.append(f"km_h{j} as materialized (select * replace ({_hash(f'(h + {value})', str(j))} as h) from km_h{j - 1 if j else ''})")
    points = f"km_h{len(cols) - 1}"
    steps.append(f"km_d0 as materialized (select {row} from {points} order by {draw(100)}, {row} limit 1)")
    for r in range(1, clustering.ROUNDS + 1):
        steps.append(f"km_n{r} as materialized (select {of('p')}, any_value(p.m) as m, any_value(p.h) as h, min({apart('p', 'c')}) as d2 from {points} p, km_d{r - 1} c group by {of('p')})")
        steps.append(f"km_d{r} as materialized (select {row} from km_d{r - 1} union select {row} from km_n{r}, (select sum(m * d2) as total from km_n{r}) where {draw(100 + r)} * total < {2 * k} * m * d2)")
    last = f"km_d{clustering.ROUNDS}"
    steps.append(f"km_w as materialized (select {row}, sum(m) as w from (select {of('c')}, p.m from {points} p, {last} c "
                 f"qualify row_number() over (partition by {of('p')} order by {apart('p', 'c')}, {of('c')}) = 1) group by {row})")
    firsts = []
    for j in range(k):
        taken = " union all ".join(f"select {', '.join(f'{x} as {c}' for c, x in zip(cols, centre))} from km{i}" for i in range(j))
        order = f"f.w * (select min({apart('f', 'o')}) from ({taken}) o) desc" if j else "f.w desc"
        firsts.append(f"km{j} as materialized (select {', '.join(f'f.{c} as {x}' for c, x in zip(cols, centre))} from km_w f order by {order}, {of('f')} limit 1)")
    d = [" + ".join(["0.0E0", *(f"(f.{c} - r.c[{n}][{m}]) * (f.{c} - r.c[{n}][{m}])" for m, c in enumerate(cols, 1))]) for n in range(1, k + 1)]
    near = f"list_position([{', '.join(d)}], least({', '.join(d)}))"
    start = ", ".join(f"[{', '.join(f'km{j}.{x}' for x in centre)}]" for j in range(k))
    means = ", ".join(f"round(avg({c}), 9)" for c in cols)
    return f"""
{", ".join(steps)},
{", ".join(firsts)},
km_steps(i, c, done) as (
  select 0, [{start}], false from {", ".join(f"km{j}" for j in range(k))}
  union all
  select i + 1, list(m order by g), list(m order by g) = any_value(c)
  from (select i, any_value(c) as c, g, [{means}] as m
        from (select r.i, r.c, f.*, {near} as g from km_steps r, km_rows f where not r.done) group by i, g)
  group by i),
km_last as (select c from km_steps order by i desc limit 1),
km as (select f.*, {near} as g from km_rows f, km_last r)"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


ORACLES["product_tiers"] = _recursive(mapping_ctes() + _PRODUCT_SCORE + "," + _kmeans(
    "scored", ["revenue_scaled", "stock_ratio_scaled", "sales_velocity_scaled"]) + """,
ranks as (select g, row_number() over (order by round(avg(performance_score), 9), g) as r from km group by g)
select product_id, name, price, units_sold, stock, revenue, stock_ratio, sales_velocity, is_degenerate,
       revenue_scaled, stock_ratio_scaled, sales_velocity_scaled, performance_score,
       ['Low', 'Medium', 'High'][r] as performance_tier
from km join ranks using (g)
""")

ORACLES["product_tier_silhouette"] = "with tier as (" + ORACLES["product_tiers"] + """),
d as (
  select a.product_id, a.performance_tier as g, b.performance_tier as o,
         avg((a.revenue_scaled - b.revenue_scaled) ** 2 + (a.stock_ratio_scaled - b.stock_ratio_scaled) ** 2
             + (a.sales_velocity_scaled - b.sales_velocity_scaled) ** 2) as d
  from tier a join tier b on a.product_id <> b.product_id group by all),
ab as (select product_id, g, max(d) filter (where o = g) as a, min(d) filter (where o <> g) as b from d group by product_id, g)
select g as performance_tier, count(*) as products,
       round(avg(case when a is null or b is null or greatest(a, b) = 0 then 0.0E0 else (b - a) / greatest(a, b) end), 6) as silhouette
from ab group by g
"""

_EMPLOYEE = """,
f as (select employee_id, coalesce(completed_tasks, 0) as completed_tasks, coalesce(total_tasks, 0) as total_tasks,
             coalesce(avg_task_hours, 0) as avg_task_hours
      from employee_record),
r as (select *, case when total_tasks > 0 then completed_tasks / total_tasks else 0 end as completion_rate from f),
s as (select *, 0.4E0 * completion_rate + 0.3E0 * (1.0E0 - avg_task_hours) + 0.3E0 * completed_tasks as raw from r),
mm as (select min(raw) as lo, max(raw) as hi,
              avg(completed_tasks) as m1, avg(total_tasks) as m2, avg(avg_task_hours) as m3, avg(completion_rate) as m4,
              stddev_pop(completed_tasks) as s1, stddev_pop(total_tasks) as s2, stddev_pop(avg_task_hours) as s3,
              stddev_pop(completion_rate) as s4 from s),
z as (select employee_id, case when hi > lo then (raw - lo) / (hi - lo) else 0 end * 100.0E0 as performance_score,
             case when s1 > 0 then round((completed_tasks - m1) / s1, 9) else 0.0E0 end as z1,
             case when s2 > 0 then round((total_tasks - m2) / s2, 9) else 0.0E0 end as z2,
             case when s3 > 0 then round((avg_task_hours - m3) / s3, 9) else 0.0E0 end as z3,
             case when s4 > 0 then round((completion_rate - m4) / s4, 9) else 0.0E0 end as z4
      from s, mm)"""

ORACLES["employee_clusters"] = _recursive(mapping_ctes() + _EMPLOYEE + "," + _kmeans("z", ["z1", "z2", "z3", "z4"]) + """,
ranks as (select g, cast(row_number() over (order by round(avg(performance_score), 9), g) - 1 as integer) as r from km group by g)
select employee_id, r as performance_cluster, performance_score from km join ranks using (g)
""")


def _forest(src: str, key: str, cols: list[str], trees: int = 100, psi: int = 256) -> str:
    """CTEs of an isolation forest over ``src``: ``anomaly`` has ``key`` and ``anomaly_score``. A level of all trees per CTE."""
    levels = psi.bit_length() - 1
    xs = ", ".join(cols)
    usable = ", ".join(f"case when hi_{c} > lo_{c} then {i} end" for i, c in enumerate(cols))
    pick = lambda what: "case f " + " ".join(f"when {i} then {what.format(c)}" for i, c in enumerate(cols)) + " end"
    out = [f"""
fo_n as (select count(*) as n, least({psi}, count(*)) as psi from {src}),
fo_depth as (select psi, cast(ceil(log2(greatest(psi, 2))) as integer) as depth from fo_n),
fo_rows0 as materialized (
  select t, 1 as node, {key}, {xs} from (
    select t, {key}, {xs}, row_number() over (partition by t order by {_hash(key, 't')}, {key}) as rn
    from {src}, (select unnest(range({trees})) as t)), fo_depth where rn <= psi)"""]
    for level in range(levels + 1):
        stats = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in cols)
        out.append(f"""
fo_nodes{level} as materialized (
  select *, case when f is not null then {pick('lo_{0}')} + ({pick('hi_{0}')} - {pick('lo_{0}')})
                 * (({_hash('node', 't + 2000')} % 1048576 + 0.5E0) / 1048576.0E0) end as split,
         {level} + case when n <= 1 then 0.0E0 when n = 2 then 1.0E0
                   else 2.0E0 * (ln(n - 1.0E0) + 0.5772156649015329E0) - 2.0E0 * (n - 1.0E0) / n end as path
  from (select *, case when {level} < (select depth from fo_depth) and n > 1 and len(us) > 0 then us[{_hash('node', 't + 1000')} % len(us) + 1] end as f
        from (select t, node, n, list_filter([{usable}], lambda u: u is not null) as us, {", ".join(f"lo_{c}, hi_{c}" for c in cols)}
              from (select t, node, count(*) as n, {stats} from fo_rows{level} group by t, node))))""")
        if level < levels:
            out.append(f"""
fo_rows{level + 1} as materialized (
  select r.t, 2 * r.node + case when {pick('r.{0}')} < k.split then 0 else 1 end as node, {key}, {", ".join(f"r.{c}" for c in cols)}
  from fo_rows{level} r join fo_nodes{level} k on k.t = r.t and k.node = r.node where k.f is not null)""")
    out.append(f"""
fo_walk0 as (select t, 1 as node, {key}, {xs} from {src}, (select unnest(range({trees})) as t))""")
    for level in range(levels):
        out.append(f"""
fo_walk{level + 1} as materialized (
  select r.t, 2 * r.node + case when {pick('r.{0}')} < k.split then 0 else 1 end as node, {key}, {", ".join(f"r.{c}" for c in cols)}
  from fo_walk{level} r join fo_nodes{level} k on k.t = r.t and k.node = r.node where k.f is not null)""")
    ends = "\n  union all ".join(f"select w.{key}, k.path from fo_walk{i} w join fo_nodes{i} k on k.t = w.t and k.node = w.node where k.f is null" for i in range(levels + 1))
    out.append(f"""
fo_paths as ({ends}),
anomaly as (
  select {key}, round(power(2.0E0, -avg(path) / case when psi <= 1 then null when psi = 2 then 1.0E0
              else 2.0E0 * (ln(psi - 1.0E0) + 0.5772156649015329E0) - 2.0E0 * (psi - 1.0E0) / psi end), 6) as anomaly_score
  from fo_paths, fo_depth group by {key}, psi)""")
    return ",".join(out)


ORACLES["employee_anomalies"] = mapping_ctes() + _EMPLOYEE + "," + _forest("z", "employee_id", ["z1", "z2", "z3", "z4"]) + """
select employee_id, anomaly_score > (select quantile_cont(anomaly_score, 0.95) from anomaly) as is_anomaly from anomaly
"""


ORACLES["employee_performance"] = f"""
select * from ({ORACLES["employee_score"]})
join (select employee_id, performance_cluster from ({ORACLES["employee_clusters"]})) using (employee_id)
join ({ORACLES["employee_anomalies"]}) using (employee_id)
"""

ORACLES["recommender_evaluation"] = f"""
with hold as ({ORACLES["content_holdout_distance"]}), cv as ({ORACLES["collaborative_cv"]})
select 'knn_test_mean_distance' as metric, mean_distance as value from hold
union all select 'cv_rmse_fold' || fold, rmse from cv
union all select 'cv_mae_fold' || fold, mae from cv
union all select 'cv_rmse_mean', round(avg(rmse), 6) from cv
union all select 'cv_mae_mean', round(avg(mae), 6) from cv
"""

for _name in ("popular", "trending", "personalized", "collaborative", "content_based"):
    ORACLES[f"recommend_{_name}"] = ORACLES[_name]

ORACLES["item_similarity_updated"] = (mapping_ctes() + _RATINGS.replace("r as (", "rr as (") + f""",
r as (select * from rr where (user_id * 31 + product_id) % 3 <> 0),
sim as ({_SIM})
select i as item_i, j as item_j, round(s, 6) as similarity from sim
""")

ORACLES["employee_ingest"] = mapping_ctes() + """,
e as (select case when employee_id % 11 = 0 then 'unreadable' when employee_id % 7 = 0 then 'completed_tasks is no double'
                  when employee_id % 5 = 0 then 'no employee_id' else '' end as reason, completed_tasks from employee_record)
select case when reason = '' then 'accepted' else 'rejected' end as status, reason, count(*) as records,
       sum(case when reason = '' then coalesce(completed_tasks, 0) else 0 end) as completed_tasks, (select count(*) from e) as read
from e group by all
"""

ORACLES["recommend_by_email"] = ORACLES["similar_users"]


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
