"""Product recommendation strategies (popular, trending, similar users,
personalized, content-based, collaborative) and the routing between them.

Every strategy returns a DataFrame. Popular and trending are lazy; the per-user
strategies take a DataFrame of requested users (column ``user_id``), write
intermediate results as they are called, and answer all users in one plan; results are ranked per user with ``row_number`` (WindowGroupLimit), the
global ones with ``orderBy().limit()`` (TakeOrderedAndProject). Ties are
broken by ``product_id`` so the kept rows are deterministic.
"""

from __future__ import annotations

import datetime as dt
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.expr import top_n
from shopcast.operators import ratings as rt
from shopcast.operators import spine
from shopcast.operators.blocked import attach
from shopcast.operators.shared_buyers import shared_buyer_counts
from shopcast.session import compact, materialize
from shopcast.sources.tables import Tables, unknown_emails, user_lookup

if TYPE_CHECKING:
    from shopcast.plans.training import RecommenderModel

DEFAULT_LIMIT = 50
DEFAULT_DAYS = 30


def _having(df: DataFrame, rating_col: str, count_col: str, min_rating: float, min_purchases: float) -> DataFrame:
    return df.where((F.col(rating_col) >= F.lit(float(min_rating))) & (F.col(count_col) >= F.lit(min_purchases)))


def popular_products(t: Tables, min_rating: float = 0, min_purchases: int = 0, limit: int = DEFAULT_LIMIT,
                     semantics: str = "corrected") -> DataFrame:
    """Best-selling products: completed units, average rating, top ``limit``."""
    p = spine.product_stats(t, semantics=semantics)
    p = _having(p, "average_rating", "total", min_rating, min_purchases)
    out = p.select(
        "product_id", "product_name",
        F.col("total").cast("long").alias("total_purchases"),
        F.col("average_rating"),
        F.col("total").alias("__order"),
    )
    return top_n(out, [], [F.col("__order").desc(), F.col("product_id")], limit).drop("__order")


def trending_products(t: Tables, as_of: dt.datetime | None = None, days: int = DEFAULT_DAYS,
                      min_rating: float = 0, min_purchases: int = 0, limit: int = DEFAULT_LIMIT,
                      semantics: str = "corrected") -> DataFrame:
    """Products ranked by recent completed sale lines × average rating."""
    as_of = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    since = as_of - dt.timedelta(days=days)
    p = spine.product_stats(t, since=since, semantics=semantics)
    p = _having(p, "average_rating", "total", min_rating, min_purchases)
    trend = (F.col("lines") * F.col("average_rating")).alias("trend_score")
    out = p.select(
        "product_id", "product_name",
        F.col("total").cast("long").alias("total_purchases"),
        "average_rating", trend,
    )
    return top_n(out, [], [F.col("trend_score").desc(), F.col("product_id")], limit)


#: Buyers of a product from which on they are not paired, but found by packed bits.
HOT = 512


def similar_users(t: Tables, users: DataFrame, min_rating: float = 0, min_purchases: int = 0,
                  limit: int = DEFAULT_LIMIT, semantics: str = "corrected") -> DataFrame:
    """Products bought by users who share a purchase with the requested user.

    Output per requested user: ``user_id, product_id, product_name,
    purchased_by_similar_users, average_rating`` (top ``limit``). A user
    without purchases, or without similar users, gets no rows. Products with more than
    ``HOT`` buyers don't pair them, see ``operators.shared_buyers``.
    """
    spine.check_semantics(semantics)
    buy = compact(spine.purchases(t).where(F.col("product_id").isNotNull()).select("user_id", "product_id", "lines"))
    req = users.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    mine = compact(buy.join(req, "user_id", "left_semi"))

    # What a product needs to be listed: its name, rating and factor of the count.
    reviews = spine.product_reviews(t)
    factor = F.lit(1) if semantics == "corrected" else F.greatest(F.coalesce(F.col("n_reviews"), F.lit(0)), F.lit(1))
    info = materialize(
        t.product.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
        .join(reviews, "product_id", "left")
        .select("product_id", "product_name", F.coalesce(F.col("avg_rating"), F.lit(0.0)).alias("average_rating"),
                factor.cast("long").alias("factor"))
        .where(F.col("average_rating") >= F.lit(float(min_rating))))
    best = shared_buyer_counts(buy, mine, info.select("product_id", "factor"), limit, HOT, float(min_purchases), info=info.drop("factor"))
    return best.select("user_id", "product_id", "product_name", F.col("n").alias("purchased_by_similar_users"), "average_rating")


def user_average_rating(t: Tables, users: DataFrame, default: float = 3.0) -> DataFrame:
    """Mean review rating per requested user; no reviews (or a 0 mean) → ``default``."""
    req = users.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    avg = t.review.groupBy("user_id").agg(F.avg("rating").alias("__avg"))
    return req.join(avg, "user_id", "left").select(
        "user_id", F.coalesce(F.nullif(F.col("__avg"), F.lit(0.0)), F.lit(float(default))).alias("user_avg")
    )


def personalized(t: Tables, users: DataFrame, min_rating: float = 0, min_purchases: int = 0,
                 limit: int = DEFAULT_LIMIT, semantics: str = "corrected", bands: int = 32) -> DataFrame:
    """Unbought products scored ``total × (5 − |avg_rating − user_avg|)``, top ``limit`` per user.

    Output: ``user_id, product_id, product_name, total_purchases,
    average_rating, score``. The exact answer is computed without pairing
    every user with every product; see ``operators.banded_topk``.
    """
    from shopcast.operators.banded_topk import banded_topk

    stats = spine.product_stats(t, semantics=semantics)
    stats = _having(stats, "average_rating", "total", min_rating, min_purchases).select(
        "product_id", "product_name", F.col("total").alias("__t"), F.col("average_rating").alias("__a"))
    req = users.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    uavg = user_average_rating(t, req)
    mine = spine.purchases(t).select("user_id", "product_id").join(req, "user_id", "left_semi")
    top = banded_topk(stats, uavg, mine, weight="__t", centre="__a", user_value="user_avg", k=limit, bands=bands)
    return top.select(
        "user_id", "product_id", "product_name",
        F.col("__t").cast("long").alias("total_purchases"),
        F.col("__a").alias("average_rating"),
        "score",
    )


def collaborative(t: Tables, users: DataFrame, limit: int = DEFAULT_LIMIT, k: int = 40,
                  similarity: DataFrame | None = None, few_users: bool = False) -> DataFrame:
    """Item-based collaborative filtering: unknown products by predicted rating.

    Output per requested user: ``user_id, product_id, product_name,
    predicted_rating, price`` (top ``limit``, ties by ``product_id``).
    Known products (completed purchases and any review) are excluded.

    The product of the users' ratings with the similarities is made in blocks: with a trained table, ``similarity``,
    see ``ratings.predict_all``, else with those of the ratings (with ``few_users`` only those of items that the users
    rated), see ``ratings.best_from_ratings``. Every other unknown product has the global mean as its prediction.
    Intermediate results are written as this is called.
    """
    r = compact(rt.ratings(t))
    req = materialize(users.select("user_id").where(F.col("user_id").isNotNull()).distinct())
    mine = compact(r.join(req, "user_id", "left_semi"))
    known = compact(spine.known_products(t, req))
    mean = r.agg(F.avg("rating").alias("m")).first()["m"]
    fallback = float(rt.clipped(rt.RATING_MIN if mean is None else mean))
    products = materialize(t.product.select(F.col("id").alias("product_id")).where(F.col("product_id").isNotNull()).distinct())
    info = t.product.select(F.col("id").cast("long").alias("product_id"), F.col("name").alias("product_name"), "price")
    if similarity is None:
        best = rt.best_from_ratings(r, mine, known, products, req, fallback, limit, k, few_users)
        top = attach(best, info, "product_id", "prediction", rt.predicted)
    else:
        top = rt.predict_all(mine, materialize(similarity), known, products, req, fallback, limit, k).join(info, "product_id")
    return top.select(
        "user_id", "product_id", "product_name", F.col("prediction").alias("predicted_rating"),
        F.col("price").cast("double").alias("price"))


STRATEGIES = ("popular", "trending", "content_based", "similar_users", "personalized", "collaborative")
USER_STRATEGIES = ("similar_users", "personalized", "collaborative")


def recommend(t: Tables, strategy: str = "popular", users: DataFrame | None = None,
              emails: DataFrame | None = None, targets: DataFrame | None = None, min_rating: float = 0,
              min_purchases: int = 0, limit: int = DEFAULT_LIMIT, as_of: dt.datetime | None = None,
              semantics: str = "corrected", model: RecommenderModel | None = None) -> DataFrame:
    """Route to one strategy.

    The user strategies need ``users`` (``user_id``) or ``emails`` (``email``; one
    that no user has is an error), content_based needs ``targets``
    (``product_id``). ``model`` (see ``plans.training``) serves content_based with
    its scaler and collaborative with its similarities. An unknown strategy
    raises ``ValueError``.
    """
    from shopcast.plans.features import content_based

    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
    if strategy == "popular":
        return popular_products(t, min_rating, min_purchases, limit, semantics)
    if strategy == "trending":
        return trending_products(t, as_of, DEFAULT_DAYS, min_rating, min_purchases, limit, semantics)
    if strategy == "content_based":
        if targets is None:
            raise ValueError("content_based needs the products (targets) to compare with")
        return content_based(t, targets, limit, scaler=model.scaler if model else None)
    if users is None:
        if emails is None:
            raise ValueError(f"{strategy} needs users or their e-mail addresses")
        unknown = unknown_emails(t, emails).limit(5).collect()
        if unknown:
            raise ValueError(f"no user has the address {', '.join(str(r['email']) for r in unknown)}")
        users = user_lookup(t, emails).select("user_id")
    if strategy == "similar_users":
        return similar_users(t, users, min_rating, min_purchases, limit, semantics)
    if strategy == "personalized":
        return personalized(t, users, min_rating, min_purchases, limit, semantics)
    return collaborative(t, users, limit, similarity=model.similarity if model else None, few_users=True)
