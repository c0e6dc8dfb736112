"""Per-product and per-user aggregates shared by the recommendation jobs.

The reference joins product, stock, sale_detail, sale and review in one chain
and groups by product. Details and reviews are independent many-sides of the
same product, so that chain multiplies counts (fan-out). Here every side is
aggregated on its own key first and only per-product rows are joined:

* ``semantics="corrected"``: each side counted once.
* ``semantics="reference"``: the same numbers the literal chain produces,
  obtained by multiplying the pre-aggregates with the other side's row
  factor — the big join is never materialized.

Shuffles: sale_detail is the fact table; it is joined to the (filtered) sale
table on ``sale_id`` and pre-aggregated per ``stock_id`` before the stock
dimension is joined, then rolled up per product. Both group-bys run a partial
(map-side) aggregate before their exchange.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.sources.tables import COMPLETED, SALE_MONTH, Tables

SEMANTICS = ("corrected", "reference")


def check_semantics(semantics: str) -> None:
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}, got {semantics!r}")


def qualifying_sales(t: Tables, since: dt.datetime | None = None) -> DataFrame:
    """Completed sales, optionally created at or after ``since`` (pushed to the scan)."""
    s = t.sale.where(F.col("status") == COMPLETED)
    if since is not None:
        s = s.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
        if SALE_MONTH in s.columns:  # a stored table: months before are not read
            s = s.where(F.col(SALE_MONTH) >= F.lit(since.date().replace(day=1)))
    return s


def product_sales(t: Tables, since: dt.datetime | None = None, semantics: str = "corrected") -> DataFrame:
    """Per product: ``units_all``, ``units_ok``, ``lines_ok``, ``n_rows``.

    ``units_ok`` / ``lines_ok`` sum the detail lines whose sale is completed (and
    recent when ``since`` is given). Corrected mode needs only these, so the
    filtered sale is an inner join: lines of other sales are dropped before the
    aggregate, and a runtime filter can prune the detail scan; ``units_all`` and
    ``n_rows`` are NULL. Reference mode keeps every line: ``units_all`` sums them
    and ``n_rows`` counts the rows of the product ⟕ stock ⟕ sale_detail chain (a
    stock without details counts 1, a product without stock counts 1).
    """
    ok = qualifying_sales(t, since).select(F.col("id").alias("sale_id"), F.lit(True).alias("ok"))
    detail = t.sale_detail.select("sale_id", "stock_id", "quantity")
    stock = t.stock.select(F.col("id").alias("stock_id"), "product_id")
    if semantics == "corrected":
        per_stock = detail.join(ok, "sale_id").groupBy("stock_id").agg(
            F.sum("quantity").alias("units_ok"), F.count(F.lit(1)).alias("lines_ok"))
        return per_stock.join(stock, "stock_id").groupBy("product_id").agg(
            F.lit(None).cast("double").alias("units_all"), F.sum("units_ok").alias("units_ok"),
            F.sum("lines_ok").alias("lines_ok"), F.lit(None).cast("long").alias("n_rows"))
    per_stock = (
        detail.join(ok, "sale_id", "left")
        .groupBy("stock_id")
        .agg(
            F.sum("quantity").alias("units_all"),
            F.sum(F.when(F.col("ok"), F.col("quantity"))).alias("units_ok"),
            F.count("ok").alias("lines_ok"),
            F.count(F.lit(1)).alias("n_details"),
        )
    )
    return (
        stock.join(per_stock, "stock_id", "left")
        .groupBy("product_id")
        .agg(
            F.sum("units_all").alias("units_all"),
            F.sum("units_ok").alias("units_ok"),
            F.coalesce(F.sum("lines_ok"), F.lit(0)).alias("lines_ok"),
            F.sum(F.greatest(F.coalesce(F.col("n_details"), F.lit(0)), F.lit(1))).alias("n_rows"),
        )
    )


def product_units(t: Tables) -> DataFrame:
    """Per product: ``units_all`` over every detail line and ``n_rows`` (no sale join)."""
    per_stock = t.sale_detail.groupBy("stock_id").agg(
        F.sum("quantity").alias("units_all"), F.count(F.lit(1)).alias("n_details"))
    return (
        t.stock.select(F.col("id").alias("stock_id"), "product_id")
        .join(per_stock, "stock_id", "left")
        .groupBy("product_id")
        .agg(
            F.sum("units_all").alias("units_all"),
            F.sum(F.greatest(F.coalesce(F.col("n_details"), F.lit(0)), F.lit(1))).alias("n_rows"),
        )
    )


def product_reviews(t: Tables) -> DataFrame:
    """Per product: ``avg_rating`` (NULL ratings ignored) and ``n_reviews``."""
    return t.review.groupBy("product_id").agg(
        F.avg("rating").alias("avg_rating"),
        F.count("id").alias("n_reviews"),
    )


def product_stats(t: Tables, since: dt.datetime | None = None, semantics: str = "corrected") -> DataFrame:
    """One row per product: id, name, price and the spine measures.

    Output: ``product_id, product_name, price, total, lines, avg_rating,
    average_rating, review_count`` where ``total``/``lines`` follow
    ``semantics`` (see module doc) and ``average_rating`` is ``avg`` or 0.
    """
    check_semantics(semantics)
    sales = product_sales(t, since, semantics)
    reviews = product_reviews(t)
    base = (
        t.product.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "price")
        .join(sales, "product_id", "left")
        .join(reviews, "product_id", "left")
    )
    n_rev = F.coalesce(F.col("n_reviews"), F.lit(0))
    n_rows = F.coalesce(F.col("n_rows"), F.lit(1))
    review_factor = F.greatest(n_rev, F.lit(1))
    if semantics == "corrected":
        total = F.coalesce(F.col("units_ok"), F.lit(0.0))
        lines = F.col("lines_ok")
        review_count = n_rev
    else:
        total = F.coalesce(F.col("units_all"), F.lit(0.0)) * review_factor
        lines = F.coalesce(F.col("lines_ok"), F.lit(0)) * review_factor
        review_count = n_rev * n_rows
    return base.select(
        "product_id",
        "product_name",
        "price",
        total.alias("total"),
        F.coalesce(lines, F.lit(0)).cast("long").alias("lines"),
        F.col("avg_rating"),
        F.coalesce(F.col("avg_rating"), F.lit(0.0)).alias("average_rating"),
        review_count.cast("long").alias("review_count"),
    )


def purchases(t: Tables) -> DataFrame:
    """Completed purchase lines per (user, product): ``user_id, product_id, lines, units``.

    Guest sales (NULL user) are dropped. One partial+final aggregate on
    (user, product) after the fact join, so later joins see one row per pair.
    """
    s = qualifying_sales(t).where(F.col("user_id").isNotNull()).select(F.col("id").alias("sale_id"), "user_id")
    return (
        t.sale_detail.select("sale_id", "stock_id", "quantity")
        .join(s, "sale_id")
        .join(t.stock.select(F.col("id").alias("stock_id"), "product_id"), "stock_id")
        .groupBy("user_id", "product_id")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))
    )


def sale_lines(t: Tables) -> DataFrame:
    """One row per detail line in the shape of ``sale`` with its ``product_id``; ``grand_total`` is quantity times price."""
    product = t.product.select(F.col("id").alias("product_id"), "price")
    return (t.sale_detail.select(F.col("sale_id").alias("id"), "stock_id", "quantity")
            .join(t.sale.select("id", "user_id", "status", "created_at"), "id")
            .join(t.stock.select(F.col("id").alias("stock_id"), "product_id"), "stock_id")
            .join(product, "product_id")
            .select("id", "user_id", "status", "created_at", "product_id", (F.col("quantity") * F.col("price")).alias("grand_total")))


def known_products(t: Tables, users: DataFrame) -> DataFrame:
    """Products each requested user bought (completed) or reviewed (any rating).

    ``users`` has a ``user_id`` column; output ``user_id, product_id``
    distinct.
    """
    u = users.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    bought = purchases(t).select("user_id", "product_id").join(u, "user_id", "left_semi")
    rated = t.review.select("user_id", "product_id").where(F.col("product_id").isNotNull()).join(u, "user_id", "left_semi")
    return bought.unionByName(rated).distinct()
