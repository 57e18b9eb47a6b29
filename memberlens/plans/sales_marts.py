"""Yearly sales marts.

Sums are not safe against joins that repeat rows, so every lookup that can repeat a
line brings the number of repeats along, and the sums are multiplied by it.

Members and orders are distinct counts of different things. Each row is dealt to the
sums, to its member and to its order, with the conditions to count as bits of a number;
one shuffle by ``(kind, key)`` then settles all counts, and the input is read once.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.functions.keys import (
    SPREAD,
    int_key,
    keyed,
    lookup,
    spread_nulls,
    text_key,
)
from memberlens.functions.labels import BRANDWMP, DOUYIN, LCS, OMNI, TMALL, platform_label
from memberlens.functions.measures import (
    ALL_SALES,
    MEMBER_SALES,
    Money,
    ratio,
    zero_to_null,
)
from memberlens.operators.orders import ADDED, PLACE, counts_as_order

# The payment scene and the order scenario of the assistant mini-program.
ASSISTANT_PAYMENT = "WOS企微小程序-新场景"
ORGANIC = "Organic"

PLATFORMS = [LCS, TMALL, DOUYIN]

SUMS = "sums"
MEMBER = "member"
ORDER = "order"
EFFECTIVE = "effective_member_order"


def _any(condition: Column) -> Column:
    """Whether any row of the group meets the condition; unknown counts as no."""
    return F.max(F.coalesce(condition, F.lit(False)))


def _effective_member_order() -> Column:
    return _any(F.col("is_member_order") & F.col("if_eff_order_tag")).alias(EFFECTIVE)


def _bits(*conditions: Column) -> Column:
    """The conditions as bits of a number, the first one lowest."""
    bits = F.lit(0)
    for place, condition in enumerate(conditions):
        bits = bits + F.when(condition, F.lit(1 << place)).otherwise(0)
    return bits


def _deal(
    facts: DataFrame, sums: list[str], sums_key: Column, member: Column, order: Column
) -> DataFrame:
    """One row per year, kind and key, with the sums or the bits that belong to it.

    ``facts`` hold ``member_bits`` and ``order_bits``; a fact without order bits counts
    for no order. Sums have few keys, so they shrink before the shuffle.
    """

    def row(kind: str, key: Column, bits: Column, with_sums: bool) -> Column:
        amounts = [
            (F.col(name) if with_sums else F.when(F.lit(False), F.col(name))).alias(name)
            for name in sums
        ]
        key = key.cast("string").alias("key")
        return F.struct(F.lit(kind).alias("kind"), key, bits.alias("bits"), *amounts)

    member_bits, order_bits = F.col("member_bits"), F.col("order_bits")
    rows = F.array_compact(
        F.array(
            row(SUMS, sums_key, F.lit(0), True),
            row(MEMBER, member, member_bits, False),
            F.when(order_bits > 0, row(ORDER, order, order_bits, False)),
        )
    )
    return (
        facts.select("transaction_year", F.explode(rows).alias("row"))
        .select("transaction_year", "row.*")
        .groupBy("transaction_year", "kind", "key")
        .agg(F.bit_or("bits").alias("bits"), *[F.sum(name).alias(name) for name in sums])
    )


def _keys(kind: str, mask: int) -> Column:
    """Number of members or orders with one of the bits."""
    has_bit = F.col("bits").bitwiseAND(F.lit(mask)) != 0
    return F.count(F.when((F.col("kind") == kind) & has_bit, F.col("key")))


def yearly_sales(lines: DataFrame, member: DataFrame) -> DataFrame:
    """Sales per year and channel, of everybody and of mini-program registrants.

    ``lines`` are distinct. Each counts towards its platform and towards ``Omni``. The rows
    of an order split by day where they lie anyway; dealing joins them again.
    """
    money = Money.of(lines)
    registrants = (
        member.filter(F.col("eff_reg_channel") == BRANDWMP)
        .groupBy(text_key("member_detail_id").alias("member_detail_id"))
        .agg(F.count("*").alias("copies"))
    )
    orders = lines.groupBy(
        F.year("order_paid_date").alias("transaction_year"),
        platform_label().alias("platform"),
        *PLACE,
    ).agg(
        *money.sums(),
        *money.sums(members_only=True),
        _any(F.col("is_member_order")).alias("by_member"),
        _effective_member_order(),
    )
    spread = spread_nulls(
        orders,
        F.col("omni_channel_member_id"),
        ["order_paid_date", "platform", "parent_order_id", "loose"],
    )
    known = lookup(spread, keyed(registrants, F.col("member_detail_id"), "copies"))
    platform, copies = F.col("platform"), F.col("copies")

    def per_platform(*conditions: Column) -> Column:
        return _bits(*[c & (platform == name) for c in conditions for name in PLATFORMS])

    registered, effective = copies.isNotNull(), F.col(EFFECTIVE)
    facts = known.select(
        "transaction_year",
        platform,
        "omni_channel_member_id",
        "parent_order_id",
        per_platform(F.col("by_member"), registered).alias("member_bits"),
        per_platform(effective, effective & registered).alias("order_bits"),
        *ALL_SALES,
        *MEMBER_SALES,
        (F.col("member_sold") * copies).alias("reg_sold"),
        (F.col("member_returned") * copies).alias("reg_returned"),
    )
    reg_sales = ["reg_sold", "reg_returned"]
    dealt = _deal(
        facts,
        [*ALL_SALES, *MEMBER_SALES, *reg_sales],
        platform,
        F.col("omni_channel_member_id"),
        F.col("parent_order_id"),
    )
    is_sum = F.col("kind") == SUMS

    def channel(name: str, members: Column, mask: int) -> Column:
        registered_mask = mask << len(PLATFORMS)
        return F.struct(
            F.lit(name).alias("source_channel"),
            F.count(F.when(members, True)).alias("parts"),
            money.net(ALL_SALES, members).alias("total_sales"),
            money.net(MEMBER_SALES, members).alias("member_sales"),
            money.net(reg_sales, members).alias("reg_sales"),
            _keys(MEMBER, mask).alias("member_shopper"),
            _keys(MEMBER, registered_mask).alias("reg_shopper"),
            _keys(ORDER, mask).alias("transactions"),
            _keys(ORDER, registered_mask).alias("reg_transactions"),
        )

    channels = [
        channel(name, is_sum & (F.col("key") == name), 1 << place)
        for place, name in enumerate(PLATFORMS)
    ]
    channels.append(channel(OMNI, is_sum, (1 << len(PLATFORMS)) - 1))
    return (
        dealt.groupBy("transaction_year")
        .agg(F.array(*channels).alias("channels"))
        .select("transaction_year", F.inline("channels"))
        .filter("parts > 0")
        .drop("parts")
    )


def registrant_sales(lines: DataFrame, member: DataFrame) -> DataFrame:
    """Purchases of mini-program registrants per year and platform, with shares.

    A platform without any known amount shows no platform figures; ``Omni`` rows
    compare with all platforms together.
    """
    sales = yearly_sales(lines, member).filter("reg_shopper > 0")
    total = F.col("total_sales")
    known = total.isNotNull() | (F.col("source_channel") == OMNI)
    return sales.select(
        F.col("transaction_year").cast("bigint").alias("transaction_year"),
        "source_channel",
        F.col("reg_shopper").alias("member_shopper"),
        F.col("reg_sales").cast("double").alias("member_sales"),
        F.col("reg_transactions").alias("member_transactions"),
        ratio(F.col("reg_transactions"), F.col("reg_shopper")).alias("frequency"),
        ratio(F.col("reg_sales"), F.col("reg_transactions")).alias("atv"),
        total.cast("double").alias("YTD_platform_TTL"),
        ratio(F.col("reg_sales"), total).alias("sales_share_of_YTD_platform_TTL"),
        F.when(known, ratio(F.col("transactions"), F.col("member_shopper"))).alias(
            "YTD_platform_frequency"
        ),
        F.when(known, ratio(F.col("member_sales"), F.col("transactions"))).alias(
            "YTD_platform_atv"
        ),
    )


def contact_adder_sales(
    lines: DataFrame, contact_adds: DataFrame, still_added: DataFrame
) -> DataFrame:
    """Store purchases of members who had added a contact by that year.

    Equal lines count once, whatever their order. An id spelled in several ways (``7``,
    ``007``) is several adders and repeats the sales of its member. The total is over
    all lines, equal ones included: merged lines bring their number along, and purchases of
    those who added nobody stay until the cells are added up, so lines are read once.
    """
    money = Money.of(lines)
    in_store = lines.filter(F.col("source_channel") == LCS)
    equal = [c for c in lines.columns if c not in ["parent_order_id", *ADDED]]
    purchases = (
        in_store.groupBy(*equal)
        .agg(F.sum("copies").alias("copies"))
        .groupBy(F.year("order_paid_date").alias("transaction_year"), "omni_channel_member_id")
        .agg(*money.sums(members_only=True), *money.sums(copies="copies"))
    )
    adders = contact_adds.groupBy("crm_member_id").agg(
        F.min("add_year").alias("first_year"), F.max("through_wmp").alias("by_wmp")
    )
    # All spellings of an id meet here, so counting and joining share one shuffle.
    spelled = (
        keyed(adders, int_key("crm_member_id"), "first_year", "by_wmp")
        .repartition(SPREAD)
        .groupBy(SPREAD, "first_year")
        .agg(
            F.count("*").alias("adders"),
            F.sum(F.col("by_wmp").cast("int")).alias("wmp_adders"),
        )
    )
    sums = [*MEMBER_SALES, *ALL_SALES]
    in_time = F.when(F.col("first_year") <= F.col("transaction_year"), F.col("adders"))
    member = F.col("omni_channel_member_id")
    bought = lookup(
        lookup(spread_nulls(purchases, member, ["transaction_year"]), spelled)
        .groupBy(SPREAD, "transaction_year", *sums)
        .agg(F.sum(in_time).alias("adders"), F.sum("wmp_adders").alias("wmp_adders")),
        still_added,
    )
    added = F.coalesce(F.col("adders") > 0, F.lit(False))
    repeats = (
        F.col("adders")
        * F.greatest("wmp_adders", F.lit(1))
        * F.coalesce("still_copies", F.lit(1))
    )
    facts = bought.select(
        "transaction_year",
        added.alias("added"),
        F.when(added, F.col("still_copies").isNotNull().cast("bigint")).alias("if_still_added_wecom"),
        F.when(added, (F.col("wmp_adders") > 0).cast("bigint")).alias("if_added_wecom_through_wmp"),
        *[F.when(added, F.col(name) * repeats).alias(name) for name in MEMBER_SALES],
        *ALL_SALES,
    )
    cells = facts.groupBy(
        "transaction_year", "added", "if_still_added_wecom", "if_added_wecom_through_wmp"
    ).agg(
        F.count("*").alias("member_shopper"),
        money.net(MEMBER_SALES).alias("member_sales"),
        *[F.sum(name).alias(name) for name in ALL_SALES],
    )
    of_year = Window.partitionBy("transaction_year")
    sold, returned = (F.sum(name).over(of_year) for name in ALL_SALES)
    return (
        cells.withColumn("total_sales", money.amount(sold - returned))
        .filter("added")
        .select(
            F.col("transaction_year").cast("bigint").alias("transaction_year"),
            F.lit(LCS).alias("source_channel"),
            "if_still_added_wecom",
            "if_added_wecom_through_wmp",
            "member_shopper",
            F.col("member_sales").cast("double").alias("member_sales"),
            F.col("total_sales").cast("double").alias("YTD_platform_TTL"),
            ratio(F.col("member_sales"), F.col("total_sales")).alias(
                "sales_share_of_YTD_platform_TTL"
            ),
        )
    )


def assistant_sales(
    order_line: DataFrame,
    crm_map: DataFrame,
    member: DataFrame,
    order_scenario: DataFrame,
    as_of: date,
) -> DataFrame:
    """Orders paid in the assistant mini-program, and the organic part of them.

    The registration channel comes from the order's own member id, the member count
    from the mapped id. "New" members joined in the as-of year, whatever the order's
    year. Lines become one row per year, member and order before any lookup.
    """
    money = Money.of(order_line)
    bought = (
        order_line.filter(
            counts_as_order(as_of, [LCS]) & (F.col("payment_type") == ASSISTANT_PAYMENT)
        )
        .groupBy(
            F.year("order_paid_date").alias("transaction_year"),
            text_key("crm_member_detail_id").alias("crm_id"),
            text_key("original_order_id").alias("original_order_id"),
            text_key("parent_order_id").alias("parent_order_id"),
        )
        .agg(*money.sums(), *money.sums(members_only=True), _effective_member_order())
    )
    scenarios = (
        order_scenario.select(text_key("parent_order_id").alias("o"), "order_scenario")
        .distinct()
        .groupBy("o")
        .agg(
            F.count("*").alias("scenarios"),
            F.count(F.when(F.col("order_scenario") == ORGANIC, True)).alias("organic"),
        )
    )
    new_members = (
        member.filter(F.year("join_time") == as_of.year)
        .select("member_detail_id")
        .distinct()
        .groupBy(int_key("member_detail_id").alias("new_key"))
        .agg(F.count("*").alias("new_copies"))
    )
    entries = crm_map.groupBy(
        text_key("member_id").alias("mapped_crm_id"), F.col("id").alias("member_id")
    ).agg(F.count("*").alias("map_copies"))
    mapped = lookup(
        spread_nulls(entries, int_key("member_id"), ["mapped_crm_id"]),
        keyed(new_members, F.col("new_key"), "new_copies"),
    )
    channel = F.col("eff_reg_channel")
    via = F.when(channel == BRANDWMP, "wmp").when(channel.contains(LCS), "lcs")
    registered = member.groupBy(
        int_key("member_detail_id").alias("registered_key"), via.alias("via")
    ).agg(F.count("*").alias("reg_copies"))
    lookups = [
        (F.col("original_order_id"), keyed(scenarios, F.col("o"), "scenarios", "organic")),
        (
            F.col("crm_id"),
            keyed(mapped, F.col("mapped_crm_id"), "member_id", "map_copies", "new_copies"),
        ),
        (int_key("crm_id"), keyed(registered, F.col("registered_key"), "via", "reg_copies")),
    ]
    rows = bought
    spread_by = ["transaction_year", "crm_id", "original_order_id", "parent_order_id"]
    for key, side in lookups:
        rows = lookup(spread_nulls(rows, key, spread_by), side)
    return _assistant_measures(rows, money)


def _assistant_measures(rows: DataFrame, money: Money) -> DataFrame:
    sums = [*ALL_SALES, *MEMBER_SALES]
    organic_sums = [f"organic_{name}" for name in sums]
    organic = F.coalesce("organic", F.lit(0))
    scenarios = F.coalesce("scenarios", F.lit(1))
    others = F.lit(1)
    for copies in ["map_copies", "new_copies", "reg_copies"]:
        others = others * F.coalesce(copies, F.lit(1))

    def organic_part(name: str) -> Column:
        # An unknown amount stays unknown only if no other scenario adds its 0.
        amount = F.when(organic == scenarios, F.col(name)).otherwise(F.coalesce(name, F.lit(0)))
        return (amount * organic * others).alias(f"organic_{name}")

    effective = F.col(EFFECTIVE)
    from_wmp = effective & (organic > 0)
    by_wmp, by_lcs = from_wmp & (F.col("via") == "wmp"), from_wmp & (F.col("via") == "lcs")
    new = F.col("new_copies").isNotNull()
    flags = [effective, from_wmp, by_wmp, by_lcs, by_wmp & new, by_lcs & new]
    facts = rows.select(
        "transaction_year",
        "member_id",
        "parent_order_id",
        _bits(*flags).alias("member_bits"),
        _bits(effective, from_wmp).alias("order_bits"),
        *[(F.col(name) * scenarios * others).alias(name) for name in sums],
        *[organic_part(name) for name in sums],
    )
    names = ["shoppers", "organic_shoppers", "wmp_shoppers", "lcs_shoppers",
             "new_wmp_shoppers", "new_lcs_shoppers"]
    dealt = _deal(
        facts, [*sums, *organic_sums], F.lit("all"), F.col("member_id"), F.col("parent_order_id")
    )
    yearly = dealt.groupBy("transaction_year").agg(
        money.net(ALL_SALES).alias("sales"),
        money.net(MEMBER_SALES).alias("member_sales"),
        money.net(organic_sums[:2]).alias("organic_sales"),
        money.net(organic_sums[2:]).alias("organic_member_sales"),
        _keys(ORDER, 1).alias("orders"),
        _keys(ORDER, 2).alias("organic_orders"),
        *[_keys(MEMBER, 1 << place).alias(name) for place, name in enumerate(names)],
    )

    def shoppers(count: str, name: str) -> Column:
        return zero_to_null(F.col(count)).alias(name)

    def quotient(part: str, whole: str, name: str) -> Column:
        return ratio(F.col(part), F.col(whole)).alias(name)

    def amount(sales: str, name: str) -> Column:
        return F.col(sales).cast("double").alias(name)

    return yearly.select(
        F.col("transaction_year").cast("bigint").alias("transaction_year"),
        shoppers("shoppers", "wos_member_shopper_ttl"),
        amount("member_sales", "wos_member_sales_ttl"),
        amount("sales", "wos_sales_ttl"),
        quotient("member_sales", "orders", "wos_member_atv_ttl"),
        quotient("orders", "shoppers", "wos_member_frequency_ttl"),
        shoppers("organic_shoppers", "wos_member_shopper_from_wmp"),
        amount("organic_member_sales", "wos_member_sales_from_wmp"),
        amount("organic_sales", "wos_ttl_sales_from_wmp"),
        quotient("organic_member_sales", "organic_orders", "wos_member_atv_from_wmp"),
        quotient("organic_orders", "organic_shoppers", "wos_member_frequency_from_wmp"),
        shoppers("wmp_shoppers", "wos_member_shopper_wmp_reg"),
        shoppers("lcs_shoppers", "wos_member_shopper_lcs_reg"),
        shoppers("new_wmp_shoppers", "wos_member_shopper_wmp_reg_new"),
        shoppers("new_lcs_shoppers", "wos_member_shopper_lcs_reg_new"),
    )
