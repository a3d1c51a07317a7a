"""Retail views on the given tables: sell-out lines, series, promotions, masters."""

from __future__ import annotations

import os
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aisle.functions import weeks
from aisle.session import dealt, spread
from aisle.sources.readers import read_parquet


class Tables:
    """The given tables of one folder and the retail views derived from them.

    Everything is lazy. Facts are reduced to the columns a view needs before the
    first join, and masters are joined without a broadcast hint: Spark
    broadcasts one when its measured size is under the session's threshold and
    shuffles it otherwise.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        path = os.path.join(self.__dict__["folder"], f"{name}.parquet")
        if name.startswith("_"):
            raise AttributeError(name)
        frame = read_parquet(self.__dict__["spark"], path)
        self.__dict__[name] = frame
        return frame

    @cached_property
    def span(self) -> tuple[date, date]:
        """First day of the first year and last day of the last year with an order, a shipment or a promotion.

        One small aggregate over two columns; without any order or shipment it is the current year.
        """
        shipped = self.lineitem.agg(F.min("l_shipdate").cast("date").alias("low"), F.max("l_shipdate").cast("date").alias("high"))
        # A promotion ends at most 20 days after its order.
        ordered = self.orders.agg(
            F.min("o_orderdate").cast("date").alias("low"), F.date_add(F.max("o_orderdate").cast("date"), 20).alias("high"))
        low, high = shipped.unionByName(ordered).agg(F.min("low"), F.max("high")).first()
        return date((low or date.today()).year, 1, 1), date((high or date.today()).year, 12, 31)

    @property
    def mondays(self) -> Column:
        """Mondays of all weeks with a day in ``span``, as an array."""
        first, last = self.span
        return F.sequence(F.trunc(F.lit(first), "week"), F.lit(last), F.expr("interval 7 days"))

    @cached_property
    def texts(self) -> DataFrame:
        """Documents for work on their text, spread over the cores."""
        return spread(self.documents, "doc_id")

    @cached_property
    def line_count(self) -> int:
        """Number of lines, from the files' footers."""
        return self.lineitem.count()

    def dealt(self, lines: DataFrame, *keys: str) -> DataFrame:
        """One row a line, or fewer, in parts of bounded size by ``keys``."""
        return dealt(lines, self.line_count, *keys)

    @cached_property
    def sites(self) -> DataFrame:
        """Distributor sites with their region."""
        return (
            self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("site"),
                F.col("s_nationkey").alias("distributor"),
                F.col("r_name").alias("region"),
            )
        )

    @cached_property
    def products(self) -> DataFrame:
        """Product master."""
        return self.part.select(
            F.col("p_partkey").alias("product"),
            F.col("p_name").alias("dp_name"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category"),
            F.col("p_size").alias("pack_size"),
            F.col("p_retailprice").alias("price"),
        )

    @cached_property
    def outlets(self) -> DataFrame:
        """Outlet master."""
        return self.customer.select(
            F.col("c_custkey").alias("outlet"),
            F.col("c_name").alias("outlet_name"),
            F.col("c_mktsegment").alias("channel"),
            F.col("c_nationkey").alias("nation_key"),
            F.col("c_acctbal").alias("balance"),
        )

    @cached_property
    def migration(self) -> DataFrame:
        """Closed outlets (negative balance) and the outlet code that follows them."""
        return self.customer.where("c_acctbal < 0").select(
            F.col("c_custkey").alias("prev_outlet"), (F.col("c_custkey") + 1).alias("new_outlet")
        )

    @cached_property
    def primary_lines(self) -> DataFrame:
        """Lines dated by shipment; needs no order join."""
        return self.lineitem.select(
            F.to_date("l_shipdate").alias("date"),
            F.col("l_partkey").alias("product"),
            F.col("l_suppkey").alias("site"),
            F.col("l_quantity").alias("qty"),
            F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("gsv"),
            F.col("l_discount").alias("discount"),
            F.col("l_returnflag").alias("return_flag"),
            F.col("l_orderkey").alias("invoice"),
        )

    @cached_property
    def sales(self) -> DataFrame:
        """Sell-out lines dated by order, with outlet and invoice attributes."""
        orders = self.orders.select(
            "o_orderkey",
            F.to_date("o_orderdate").alias("date"),
            F.col("o_custkey").alias("outlet"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
        )
        lines = self.primary_lines.withColumnRenamed("date", "ship_date")
        # Both sides in the same number of parts, so that the join takes them as they are.
        return self.dealt(lines, "invoice").join(
            self.dealt(orders, "o_orderkey"), F.col("invoice") == F.col("o_orderkey")
        ).drop("o_orderkey")

    def _weekly(self, lines: DataFrame) -> DataFrame:
        promo = F.when(F.col("discount") >= 0.08, F.col("qty")).otherwise(0.0)
        returned = F.when(F.col("return_flag") == "R", F.col("qty")).otherwise(0.0)
        return (
            lines.join(self.products.select("product", "brand"), "product")
            .join(self.sites.select("site", "region"), "site")
            .groupBy("brand", "region", weeks.week_start("date").alias("week"))
            .agg(
                F.sum("qty").alias("qty"),
                F.round(F.sum("gsv"), 4).alias("gsv"),
                F.count("*").alias("lines"),
                F.sum(promo).alias("promo_qty"),
                F.sum(returned).alias("return_qty"),
            )
            .withColumn("week_no", weeks.week_index("week"))
            .withColumn("yearweek", weeks.iso_yearweek("week"))
        )

    @cached_property
    def weekly(self) -> DataFrame:
        """Primary demand series: brand and region by ISO week."""
        return self._weekly(self.primary_lines)

    @cached_property
    def weekly_secondary(self) -> DataFrame:
        """Secondary demand series: brand and region by ISO week of the order."""
        return self._weekly(self.sales)

    @cached_property
    def daily(self) -> DataFrame:
        """Primary demand by brand and day."""
        return (
            self.primary_lines.join(self.products.select("product", "brand"), "product")
            .groupBy("brand", "date")
            .agg(F.sum("qty").alias("qty"), F.round(F.sum("gsv"), 4).alias("gsv"), F.count("*").alias("lines"))
        )

    @cached_property
    def promotions(self) -> DataFrame:
        """Promotion intervals: urgent and high-priority orders are schemes of up to three weeks."""
        best = self.lineitem.groupBy(F.col("l_orderkey").alias("scheme")).agg(
            F.max("l_discount").alias("discount"), F.min("l_partkey").alias("product")
        )
        start = F.to_date("o_orderdate")
        return (
            self.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            .select(
                F.col("o_orderkey").alias("scheme"),
                F.col("o_orderpriority").alias("mechanic"),
                F.col("o_orderstatus").alias("status"),
                F.col("o_custkey").alias("outlet"),
                start.alias("start_date"),
                F.date_add(start, (F.col("o_orderkey") % 21).cast("int")).alias("end_date"),
            )
            .join(best, "scheme")
        )

    @cached_property
    def traffic(self) -> DataFrame:
        """Shop traffic by day: events moved back 286 months onto the order calendar; shop is ``props.k``."""
        kind = F.col("event_type")
        return (
            self.events.select(
                F.add_months(F.to_date("ts"), -286).alias("date"),
                F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("site"),
                "user_id", "event_type", "value",
            )
            .groupBy("date", "site")
            .agg(
                F.count_distinct(F.when(kind == "view", F.col("user_id"))).alias("visitors"),
                F.count_if(kind == "view").alias("views"),
                F.count_distinct(F.when(kind == "click", F.col("user_id"))).alias("cart_users"),
                F.count_distinct(F.when(kind == "purchase", F.col("user_id"))).alias("buyers"),
                F.round(F.sum(F.when(kind == "purchase", F.col("value")).otherwise(0.0)), 4).alias("web_gmv"),
            )
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        """Weekly actuals with three simple forecasts, where all of them exist."""
        spec = Window.partitionBy("brand", "region").orderBy("week_no")
        return self.weekly.select(
            "brand", "region", "week_no", "yearweek", F.col("qty").alias("actual"),
            F.round(F.max("qty").over(spec.rangeBetween(-52, -52)) * 1.05, 2).alias("fc_year"),
            F.max("qty").over(spec.rangeBetween(-1, -1)).alias("fc_week"),
            F.round(F.avg("qty").over(spec.rangeBetween(-4, -1)), 2).alias("fc_mean"),
        ).where("fc_year is not null and fc_week is not null and fc_mean is not null")

    @cached_property
    def product_weekly(self) -> DataFrame:
        """Primary demand by product and ISO week."""
        lines = self.primary_lines.select("product", weeks.week_index("date").alias("week_no"), "qty")
        return self.dealt(lines, "product", "week_no").groupBy("product", "week_no").agg(F.sum("qty").alias("qty"))

    @cached_property
    def scores(self) -> DataFrame:
        """Labelled documents with a score that falls with their length."""
        score = F.round(F.lit(1000.0) / (F.lit(1000.0) + F.col("n_chars")), 3)
        return self.documents.select("doc_id", "source", "lang", score.alias("score")).join(self.labels, "doc_id")

    @cached_property
    def plan(self) -> DataFrame:
        """Weekly series with working days, daily average, promotion flag and Thursday anchor."""
        series = self.weekly.withColumn("working_days", weeks.working_days("week"))
        daily = F.when(F.col("working_days") != 0, F.col("qty") / F.col("working_days")).otherwise(0.0)
        return series.select(
            "brand", "region", "week", "week_no", "yearweek", "qty", "working_days", daily.alias("daily"),
            (F.col("promo_qty") > F.col("qty") * 0.35).cast("int").alias("green"),
            F.date_add("week", 3).alias("anchor"),
        )

    @cached_property
    def banded(self) -> DataFrame:
        """Promoted material by week: primary and secondary sales, product sales and product baseline.

        One scan of the lines: each is booked on the week of its shipment and on
        that of its order. Product sales and their median over the weeks follow
        from the sums, which have one row per material and week.
        """
        orders = self.orders.select(F.col("o_orderkey").alias("invoice"), F.to_date("o_orderdate").alias("order_date"))
        booked = self.primary_lines.select("date", "product", "site", "invoice", "qty", "discount").join(
            orders, "invoice", "left").withColumn("_booking", F.explode(F.array(
                F.struct(F.lit(True).alias("shipped"), F.col("date").alias("day")),
                F.struct(F.lit(False).alias("shipped"), F.col("order_date").alias("day"))))).where("_booking.day IS NOT NULL")
        shipped, promoted = F.col("_booking.shipped"), F.col("discount") >= 0.08
        sums = (
            booked.join(self.products.select("product", "brand", F.col("category").alias("material")), "product")
            .join(self.sites.select("site", "region"), "site")
            .groupBy(F.col("region").alias("category"), F.col("brand").alias("dp"), "material",
                     weeks.week_start("_booking.day").alias("week"))
            .agg(F.sum(F.when(shipped & promoted, F.col("qty")).otherwise(0.0)).alias("pri_sales"),
                 F.sum(F.when(~shipped & promoted, F.col("qty")).otherwise(0.0)).alias("sec_sales"),
                 F.sum(F.when(shipped, F.col("qty"))).alias("_all"), F.count_if(promoted).alias("_promoted")))
        product = Window.partitionBy("category", "dp")
        week = Window.partitionBy("category", "dp", "week")
        first = F.row_number().over(week.orderBy("material")) == 1
        weekly = sums.withColumn("_week", F.sum("_all").over(week)).withColumn("_once", F.when(first, F.col("_week")))
        return (
            weekly.withColumn("baseline", F.percentile("_once", 0.5).over(product))
            .where("_promoted > 0 AND baseline IS NOT NULL")
            .select("category", "dp", "week", "material", "pri_sales", "sec_sales",
                    F.coalesce("_week", F.lit(0.0)).alias("pri_sales_dp"), "baseline", weeks.week_index("week").alias("week_no"))
        )

    @cached_property
    def deals(self) -> DataFrame:
        """Price promotion deals with mechanic, minimum buy, discounts, gifts and unit prices."""
        urgent, high = F.col("mechanic") == "1-URGENT", F.col("discount") >= 0.08
        as_int = lambda d: F.date_format(d, "yyyyMMdd").cast("int")
        price = F.col("price")
        return self.promotions.join(self.products, "product").select(
            "scheme", "product", "brand", as_int("start_date").alias("start_date"),
            as_int("end_date").alias("orig_end_date"),
            F.when(F.col("status") == "P", as_int(F.date_sub("end_date", 3))).otherwise(0).alias("stop_date"),
            F.when(F.col("status") == "O", "CANCELLED").otherwise("OPEN").alias("deal_status"),
            F.when(urgent & high, "PERCENTAGE").when(urgent, "VALUE").when(high, "U GIFT").otherwise("NON-U GIFT").alias(
                "mechanic_type"),
            F.when(F.col("category") == "PROMO", "VND").when(F.col("category") == "SMALL", "SU")
            .when(F.col("category") == "LARGE", "CS").otherwise("PC").alias("min_buy_uom"),
            F.when(F.col("category") == "ECONOMY", "SU").when(F.col("category") == "MEDIUM", "CS").otherwise("PC").alias(
                "gift_uom"),
            F.col("pack_size").cast("double").alias("min_buy"), (F.col("discount") * 100).alias("pct_discount"),
            (price * F.col("discount")).alias("val_discount"), (F.col("discount") * 100).alias("gift_qty"),
            price.alias("price_pc"), (price * 6).alias("price_su"), (price * 24).alias("price_cs"),
            (price / 2).alias("gift_price_pc"), (price * 3).alias("gift_price_su"), (price * 12).alias("gift_price_cs"),
        )
