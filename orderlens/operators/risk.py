"""From two probabilities per order to levels, actions, queues and aggregates.

A scored order carries ``delay_probability`` and ``low_review_probability``; all
rules are row-local expressions, all aggregates single-pass conditional ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions import scalar as S
from orderlens.schemas import (
    DELAY_THRESHOLD,
    LOW_REVIEW_THRESHOLD,
    QUEUE_LENGTH,
    TOP_AT_RISK,
)
from orderlens.session import checkpointed

DELAY_P, REVIEW_P = "delay_probability", "low_review_probability"

# Wording shown to the team and sent to customers.
PLAY_EXPEDITE = "Expedite shipping + notify the customer"
PLAY_APOLOGY = "Proactive apology + support outreach"
PLAY_CONFIRM = "Confirm the delivery ETA with the carrier"
PLAY_CHECK_IN = "Schedule a post-delivery check-in"
ACTION_EXPEDITE = "Expedite shipping"
ACTION_SUPPORT = "Proactive support outreach"
ACTION_CONFIRM = "Confirm the delivery ETA"
ACTION_CHECK_IN = "Check in after delivery"
ACTION_NONE = "No action needed"
DESTINATION_NAMES = {
    "email": "Gmail / Outlook", "slack": "Slack", "sheets": "Google Sheets",
    "support": "Zendesk / Gorgias", "crm": "HubSpot / Salesforce",
}
DETAILED_TEXTS = {
    "delay": (
        "Hi! We're keeping a close eye on your recent order{what} to make sure it reaches "
        "you{where} as quickly as possible. If the delivery timeline shifts we'll let you know "
        "right away — and you can reply here any time. Thanks so much for your patience!"
    ),
    "review": (
        "Hi! Thank you for your order{what}. We want to be sure you're completely happy with "
        "it — if anything isn't quite right, just reply and we'll put it right straight away. "
        "We really appreciate your business!"
    ),
    "none": (
        "Hi! Thanks for your order{what} — it's on track. We're here if you need anything at "
        "all, so don't hesitate to reach out. We appreciate you!"
    ),
}
PLAIN_TEXTS = {
    "delay": (
        "Hi! We're keeping a close eye on your recent order to make sure it reaches you as "
        "quickly as possible. If anything changes we'll let you know right away — and you can "
        "reply here any time. Thanks so much for your patience!"
    ),
    "review": (
        "Hi! Thank you for your order — we want to be sure you're completely happy with it. If "
        "anything isn't quite right, just reply and we'll make it right straight away. We "
        "really appreciate your business!"
    ),
    "none": (
        "Hi! Thanks for your order — it's on track. We're here if you need anything at all, so "
        "don't hesitate to reach out. We appreciate you!"
    ),
}
RISK_BINS = [(0.1, "0–10%"), (0.2, "10–20%"), (0.3, "20–30%"), (0.5, "30–50%"), (1.01, "50%+")]

ELEVATED = ("high", "medium")


def with_risk(
    scored: DataFrame,
    delay_threshold: float = DELAY_THRESHOLD,
    low_review_threshold: float = LOW_REVIEW_THRESHOLD,
) -> DataFrame:
    """Add flag and level of both models."""
    return scored.withColumns({
        "delay_risk": S.risk_level(F.col(DELAY_P), delay_threshold),
        "delay_flag": F.col(DELAY_P) >= delay_threshold,
        "low_review_risk": S.risk_level(F.col(REVIEW_P), low_review_threshold),
        "low_review_flag": F.col(REVIEW_P) >= low_review_threshold,
    })


def top_probability() -> Column:
    """The larger of the two probabilities; an unknown one is skipped."""
    return F.greatest(DELAY_P, REVIEW_P)


def _either(level: str) -> Column:
    return (F.col("delay_risk") == level) | (F.col("low_review_risk") == level)


def at_risk() -> Column:
    """Either level above low."""
    return (F.col("delay_risk") != "low") | (F.col("low_review_risk") != "low")


def priority() -> Column:
    """high if either level is high, medium if either is medium, else null."""
    return F.when(_either("high"), "high").when(_either("medium"), "medium")


def playbook() -> Column:
    """The play for a queued order."""
    return (
        F.when(F.col("delay_risk") == "high", PLAY_EXPEDITE)
        .when(F.col("low_review_risk") == "high", PLAY_APOLOGY)
        .when(F.col("delay_risk") == "medium", PLAY_CONFIRM)
        .otherwise(PLAY_CHECK_IN)
    )


def recommended_action() -> Column:
    """The next step shown for every uploaded order."""
    return (
        F.when(F.col("delay_risk") == "high", ACTION_EXPEDITE)
        .when(F.col("low_review_risk") == "high", ACTION_SUPPORT)
        .when(F.col("delay_risk") == "medium", ACTION_CONFIRM)
        .when(F.col("low_review_risk") == "medium", ACTION_CHECK_IN)
        .otherwise(ACTION_NONE)
    )


def routes() -> Column:
    """Destination ids in order: support first, then e-mail and tracker, then alert."""
    return F.array_distinct(F.array_compact(F.array(
        F.when(F.col("low_review_risk").isin(*ELEVATED), "support"),
        F.lit("email"),
        F.lit("sheets"),
        F.when(_either("high"), "slack"),
    )))


def route_names() -> Column:
    """The destinations' display names."""
    names = F.create_map(*[F.lit(x) for pair in DESTINATION_NAMES.items() for x in pair])
    return F.transform(routes(), lambda route: names[route])


def _by_risk(texts: dict[str, Column]) -> Column:
    return (
        F.when(F.col("delay_risk").isin(*ELEVATED), texts["delay"])
        .when(F.col("low_review_risk").isin(*ELEVATED), texts["review"])
        .otherwise(texts["none"])
    )


def outreach_text() -> Column:
    """Customer message with the category and the state where they are known."""
    known_state = F.nullif(F.col("customer_state"), F.lit(""))
    known_category = F.nullif(F.col("main_category"), F.lit(""))
    where = F.coalesce(F.concat(F.lit(" in "), known_state), F.lit(""))
    what = F.coalesce(
        F.concat(F.lit(" of "), F.translate(known_category, "_", " ")), F.lit("")
    )

    def fill(text: str) -> Column:
        filled = F.replace(F.lit(text), F.lit("{what}"), what)
        return F.replace(filled, F.lit("{where}"), where)

    return _by_risk({tier: fill(text) for tier, text in DETAILED_TEXTS.items()})


def outreach_template() -> Column:
    """Customer message without order details."""
    return _by_risk({tier: F.lit(text) for tier, text in PLAIN_TEXTS.items()})


def with_row_ids(orders: DataFrame) -> DataFrame:
    """order_id, else id, else ``row-N`` by ingest position (1-based).

    Positions come from the serial of each row in its partition plus the rows of
    earlier partitions; the checkpoint holds both readings to the same partitions.
    """
    present = set(orders.columns)
    named = F.coalesce(*[
        S.blank_to_null(F.col(c)) if c in present else F.lit(None).cast("string")
        for c in ("order_id", "id")
    ])
    numbered = checkpointed(orders).withColumns({
        "_named": named,
        "_part": F.spark_partition_id(),
        "_serial": F.monotonically_increasing_id(),
    })
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    place = F.col("_before") + F.col("_serial").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    # one row per partition, whatever the upload's size
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn("order_id", F.coalesce("_named", F.concat(F.lit("row-"), place.cast("string"))))
        .drop("_named", "_part", "_serial", "_before")
    )


def late_indicator(lateness_days: Column) -> Column:
    """1 for a positive lateness, 0 otherwise, null when it was not given."""
    return F.when(lateness_days.isNotNull(), (lateness_days > 0).cast("int"))


def display_row(scored: DataFrame) -> DataFrame:
    """The presentation form: two decimals, text or null, ISO date."""

    def number(name: str) -> Column:
        return F.round(S.safe_double(F.col(name)), 2).alias(name)

    return scored.select(
        F.col("order_id").cast("string").alias("order_id"),
        F.col("customer_state").cast("string").alias("customer_state"),
        F.col("main_category").cast("string").alias("main_category"),
        *[number(c) for c in (
            "total_price", "n_items", "estimated_delivery_days", "actual_delivery_days",
            "review_score",
        )],
        F.date_format("order_purchase_timestamp", "yyyy-MM-dd").alias("purchase_date"),
        F.round(DELAY_P, 4).alias(DELAY_P), "delay_risk", "delay_flag",
        F.round(REVIEW_P, 4).alias(REVIEW_P), "low_review_risk", "low_review_flag",
    )


# ---- aggregates ---------------------------------------------------------------


def _bucket(probability: Column) -> Column:
    expr = F.when(probability <= RISK_BINS[0][0], RISK_BINS[0][1])
    for edge, label in RISK_BINS[1:]:
        expr = expr.when(probability <= edge, label)
    return expr


def risk_distribution(scored: DataFrame) -> DataFrame:
    """Orders per right-closed probability bin and model; empty bins are shown."""
    spark = scored.sparkSession
    counted = (
        scored.select(F.inline(F.array(
            F.struct(_bucket(F.col(DELAY_P)).alias("bucket"), F.lit(1).alias("d"),
                     F.lit(0).alias("r")),
            F.struct(_bucket(F.col(REVIEW_P)).alias("bucket"), F.lit(0).alias("d"),
                     F.lit(1).alias("r")),
        )))
        .groupBy("bucket").agg(F.sum("d").alias("delay"), F.sum("r").alias("low_review"))
    )
    bins = spark.createDataFrame([(label,) for _, label in RISK_BINS], "bucket string")
    zero = F.lit(0).cast("bigint")
    return bins.join(counted, "bucket", "left").select(
        "bucket", F.coalesce("delay", zero).alias("delay"),
        F.coalesce("low_review", zero).alias("low_review"),
    )


def dashboard_summary(
    scored: DataFrame, orders: DataFrame,
    delay_threshold: float = DELAY_THRESHOLD, low_review_threshold: float = LOW_REVIEW_THRESHOLD,
) -> DataFrame:
    """Headline counts; the scored side covers every delivered order."""
    book = orders.agg(F.struct(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("order_status") == "delivered").alias("delivered"),
    ).alias("b")).scalar()
    n = F.count(F.lit(1))
    return scored.agg(
        n.alias("scored_orders"),
        S.percent(F.count_if("delay_flag"), n).alias("delay_at_risk_pct"),
        S.percent(F.count_if("low_review_flag"), n).alias("low_review_at_risk_pct"),
        F.count_if(_either("high")).alias("high_risk_orders"),
        F.avg(DELAY_P).alias("avg_delay_probability"),
    ).select(
        book["total"].alias("total_orders"), book["delivered"].alias("delivered_orders"), "*",
        F.lit(delay_threshold).alias("delay_threshold"),
        F.lit(low_review_threshold).alias("low_review_threshold"),
    )


def batch_summary(scored: DataFrame) -> DataFrame:
    """Counts and shares by flag; zeros for an empty batch."""
    n = F.count(F.lit(1))
    delay, low = F.count_if("delay_flag"), F.count_if("low_review_flag")
    return scored.agg(
        n.alias("orders"), delay.alias("delay_at_risk"), low.alias("low_review_at_risk"),
        F.count_if(_either("high")).alias("high_risk"),
        S.percent(delay, n).alias("delay_at_risk_pct"),
        S.percent(low, n).alias("low_review_at_risk_pct"),
    )


def digest_counts(orders: DataFrame, scored: DataFrame) -> DataFrame:
    """Observed counts over all orders beside predicted ones over delivered orders."""
    predicted = scored.agg(F.struct(
        F.count_if("delay_flag").alias("delay"),
        F.count_if("low_review_flag").alias("low"),
        F.count_if(top_probability() >= 0.5).alias("high"),
        F.count(F.lit(1)).alias("n"),
    ).alias("p")).scalar()
    return orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(F.col("order_status") == "delivered").alias("delivered_orders"),
        F.count_if(S.tri_state(F.col("is_late"))).alias("late_deliveries"),
        F.count_if(S.tri_state(F.col("low_review"))).alias("low_reviews"),
    ).select(
        "*", predicted["delay"].alias("delay_at_risk"),
        S.percent(predicted["delay"], predicted["n"]).alias("delay_at_risk_pct"),
        predicted["low"].alias("low_review_at_risk"),
        S.percent(predicted["low"], predicted["n"]).alias("low_review_at_risk_pct"),
        predicted["high"].alias("high_risk_orders"),
    )


def risk_by_group(scored: DataFrame, group: str, k: int | None = 5) -> DataFrame:
    """At-risk and total orders per group, most at-risk first; unknown left out."""
    known = F.coalesce(F.col(group), F.lit("unknown"))
    counted = (
        scored.groupBy(known.alias("group"))
        .agg(F.count(F.lit(1)).alias("orders"), F.count_if(at_risk()).alias("at_risk"))
        .where(F.col("group") != "unknown")
        .orderBy(F.col("at_risk").desc(), "group")
    )
    return counted.limit(k) if k else counted


def roi(
    scored: DataFrame, success_pct: float = 35, lost_orders_tenths: float = 15,
    delay_cost: float = 18, scale: Column | None = None, order_value: float | None = None,
) -> DataFrame:
    """What acting on the at-risk orders is worth.

    All orders are scored, so the extrapolation factor is 1 unless one is given.
    The average order value is the rounded mean of positive prices.
    """
    factor = scale if scale is not None else F.lit(1.0)
    price = F.col("total_price")
    value = (
        F.lit(float(order_value)) if order_value is not None
        else F.coalesce(F.round(F.avg(F.when(price > 0, price))), F.lit(160.0))
    )
    rate = success_pct / 100.0
    base = scored.agg(
        value.alias("order_value"),
        F.count_if(F.col("delay_risk") != "low").alias("delay"),
        F.count_if(F.col("low_review_risk") != "low").alias("review"),
    )
    return (
        base.select(
            "order_value",
            F.round(F.col("delay") * factor).cast("bigint").alias("delay_at_risk"),
            F.round(F.col("review") * factor).cast("bigint").alias("review_at_risk"),
        )
        .withColumns({
            "reviews_prevented": F.round(F.col("review_at_risk") * rate).cast("bigint"),
            "delays_caught": F.round(F.col("delay_at_risk") * rate).cast("bigint"),
        })
        .withColumns({
            "review_value": F.col("reviews_prevented") * F.col("order_value")
            * (lost_orders_tenths / 10.0),
            "delay_value": F.col("delays_caught") * float(delay_cost),
        })
        .withColumn("total_value", F.col("review_value") + F.col("delay_value"))
    )


# ---- queues and top lists -------------------------------------------------------


def top_at_risk(scored: DataFrame, k: int = TOP_AT_RISK) -> DataFrame:
    """The k delivered orders with the highest combined risk."""
    return (
        scored.withColumn("combined_risk", top_probability())
        .orderBy(F.col("combined_risk").desc(), "order_id").limit(k)
        .select(
            "order_id", "customer_state", "main_category",
            F.round("total_price", 2).alias("total_price"),
            F.round(DELAY_P, 4).alias(DELAY_P), F.round(REVIEW_P, 4).alias(REVIEW_P),
            F.round("combined_risk", 4).alias("combined_risk"),
        )
    )


def recent_late_orders(order_level: DataFrame, k: int = TOP_AT_RISK) -> DataFrame:
    """Without models: the k most recent orders known to be late."""
    return (
        order_level.where(S.tri_state(F.col("is_late")))
        .orderBy(F.col("order_purchase_timestamp").desc_nulls_last(), "order_id").limit(k)
        .select(
            "order_id", "customer_state", "main_category",
            F.round("total_price", 2).alias("total_price"),
            F.date_format("order_purchase_timestamp", "yyyy-MM-dd").alias("purchase_date"),
        )
    )


def action_queue(scored: DataFrame, k: int = QUEUE_LENGTH) -> DataFrame:
    """The k most urgent orders: high priority first, then the larger probability."""
    urgency = F.when(F.col("priority") == "high", F.lit(1000)).otherwise(F.lit(0)) + top_probability()
    return (
        scored.withColumn("priority", priority()).where(F.col("priority").isNotNull())
        .withColumn("urgency", urgency)
        .orderBy(F.col("urgency").desc(), "order_id").limit(k)
    )


def open_queue(queue: DataFrame, resolved: DataFrame) -> DataFrame:
    """Queued orders nobody has resolved yet."""
    return queue.join(resolved.select("order_id").distinct(), "order_id", "left_anti")


def coverage(queue: DataFrame, resolved: DataFrame) -> DataFrame:
    """How much of the queue is resolved, in whole percent; 0 for an empty queue."""
    done = resolved.select("order_id").distinct().withColumn("done", F.lit(True))
    return queue.join(done, "order_id", "left").agg(
        F.count(F.lit(1)).alias("queued"),
        F.count_if(F.col("done")).alias("resolved"),
        F.round(S.percent(F.count_if(F.col("done")), F.count(F.lit(1)))).cast("bigint")
        .alias("coverage_pct"),
    )


def funnel(scored: DataFrame, orders: DataFrame, queue: DataFrame) -> DataFrame:
    """Scanned, flagged (never fewer than queued) and queued orders."""
    scanned = orders.agg(F.count(F.lit(1))).scalar()
    queued = queue.agg(F.count(F.lit(1))).scalar()
    rate = F.count_if(at_risk()) / F.greatest(F.count(F.lit(1)), F.lit(1))
    return scored.agg(rate.alias("rate")).select(
        scanned.alias("scanned"),
        F.greatest(queued, F.round(F.col("rate") * scanned).cast("bigint")).alias("flagged"),
        queued.alias("queued"),
    )


def sorted_orders(scored: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """All orders by one column; an unknown value sorts as minus infinity."""
    key = F.col(column)
    return scored.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "order_id")


def ranked_uploads(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Uploaded orders by the larger risk, with the recommended action."""
    ranked = scored.withColumns({
        "top_probability": top_probability(), "recommended_action": recommended_action(),
    }).orderBy(F.col("top_probability").desc(), "order_id")
    return ranked.limit(k) if k else ranked


def join_uploads(scored: DataFrame, uploads: DataFrame, position: str) -> DataFrame:
    """Scored rows beside the uploaded row of the same id; the last upload wins."""
    last = uploads.groupBy("order_id").agg(
        F.max_by(F.struct("main_category", "customer_state"), position).alias("row")
    )
    return scored.drop("main_category", "customer_state").join(last, "order_id", "left").select(
        *[c for c in scored.columns if c not in ("main_category", "customer_state")],
        F.coalesce("row.main_category", F.lit("unknown")).alias("main_category"),
        F.coalesce("row.customer_state", F.lit("unknown")).alias("customer_state"),
    )


def action_queue_export(queue: DataFrame) -> DataFrame:
    """The ten export columns of the action queue, all text."""
    return queue.select(
        F.col("order_id").cast("string").alias("order_id"),
        F.coalesce(priority(), F.lit("")).alias("priority"),
        "delay_risk", F.format_string("%.3f", F.col(DELAY_P)).alias("delay_prob"),
        "low_review_risk", F.format_string("%.3f", F.col(REVIEW_P)).alias("low_review_prob"),
        F.coalesce("customer_state", F.lit("")).alias("state"),
        F.coalesce("main_category", F.lit("")).alias("category"),
        playbook().alias("recommended_action"),
        F.array_join(route_names(), " | ").alias("routes_to"),
    )


def order_book_text(scored: DataFrame) -> DataFrame:
    """A text summary of a scored order book: counts, top 8, top groups."""

    def as_percent(name: str) -> Column:
        return F.format_string("%.1f%%", F.col(name) * 100)

    def as_share(name: str) -> Column:
        return F.regexp_replace(F.format_string("%.1f", F.col(name)), r"\.0$", "")

    def lines(df: DataFrame, line: Column, *order: Column) -> Column:
        """A few rows (k of a top list) as one ordered text block."""
        return df.agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))),
                    lambda row: row["line"],
                ),
                "\n",
            )
        ).scalar()

    top = lines(
        ranked_uploads(scored, 8),
        F.concat(
            F.lit("- "), F.col("order_id").cast("string"), F.lit(": delay "),
            as_percent(DELAY_P), F.lit(" ("), F.col("delay_risk"), F.lit("), low-review "),
            as_percent(REVIEW_P), F.lit(" ("), F.col("low_review_risk"), F.lit(")"),
        ),
        (-F.col("top_probability")).alias("o1"), F.col("order_id").alias("o2"),
    )

    def group_block(group: str, title: str) -> Column:
        body = lines(
            risk_by_group(scored, group),
            F.concat_ws(
                "", F.lit("- "), F.col("group"), F.lit(": "), F.col("at_risk").cast("string"),
                F.lit("/"), F.col("orders").cast("string"),
            ),
            (-F.col("at_risk")).alias("o1"), F.col("group").alias("o2"),
        )
        return F.when(F.length(body) > 0, F.concat(F.lit(f"\n\n{title}\n"), body)).otherwise("")

    return batch_summary(scored).select(F.concat(
        F.lit("Order book, scored just now by the calibrated models:\n- Orders scored: "),
        F.col("orders").cast("string"),
        F.lit("\n- Delay at-risk: "), F.col("delay_at_risk").cast("string"), F.lit(" ("),
        as_share("delay_at_risk_pct"),
        F.lit("%)\n- Low-review at-risk: "), F.col("low_review_at_risk").cast("string"),
        F.lit(" ("), as_share("low_review_at_risk_pct"),
        F.lit("%)\n- High risk on either model: "), F.col("high_risk").cast("string"),
        F.lit("\n\nHighest-risk orders:\n"), top,
        group_block("main_category", "At-risk by category (at-risk / total):"),
        group_block("customer_state", "At-risk by customer state (at-risk / total):"),
    ).alias("text"))
