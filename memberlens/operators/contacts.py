"""Contact-adding events and the relations that still exist."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.functions.keys import SPREAD, int_key, keyed, lookup, spread_nulls
from memberlens.operators.identity import all_identities
from memberlens.sources.checks import none_of, watched

# Fixed values of the event log, the tag table and the binding table.
CONTACT_ADD = "external_user_add"
WMP_SCENE = "乐高小程序"
ATTRIBUTES = ["store_codes", "unionId", "external_userId", "add_way", "code_name"]
#: All of them are read as text: a nested value as its JSON.
ATTRIBUTES_TYPE = ", ".join(f"`{name}` string" for name in ATTRIBUTES)
BINDING_TYPE = "unionId"
BINDING_APP = 4


def _events(contact_event: DataFrame, as_of: date) -> DataFrame:
    """Contact-adding events before the as-of day.

    The bound folds to a number of seconds, so that the scan itself can skip later data.
    """
    end = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    events = contact_event.filter(
        (F.col("event_key") == CONTACT_ADD) & (F.col("event_time") < end)
    )
    return watched("contact_event", events, **none_of("gio_id", "attributes"))


def _with_attributes(events: DataFrame) -> DataFrame:
    """The events with ``parsed``, their attributes, each text parsed once.

    Text that is no JSON object, or breaks off, has no attributes; of a name that comes twice
    the last value counts.
    """
    return events.withColumn("parsed", F.from_json("attributes", ATTRIBUTES_TYPE))


def contact_adds(
    contact_event: DataFrame, identity: DataFrame, contact_tag: DataFrame, as_of: date
) -> DataFrame:
    """Every contact-adding event with its attributes, member ids and latest scene."""
    events = _with_attributes(_events(contact_event, as_of)).select(
        "event_key",
        F.timestamp_seconds("event_time").alias("event_time"),
        *[F.col(f"parsed.{name}") for name in ATTRIBUTES],
        "gio_id",
    )
    everything = events.columns
    with_member = lookup(
        spread_nulls(events, F.col("gio_id"), everything),
        keyed(all_identities(identity), F.col("gio_id"), "crm_member_id"),
    ).drop(SPREAD, "gio_id")
    tags = keyed(
        contact_tag,
        F.col("union_id"),
        F.col("wecom_channel_source").alias("latest_wecom_channel_source"),
    )
    spread = spread_nulls(with_member, F.col("unionId"), with_member.columns)
    return lookup(spread, tags).drop(SPREAD)


def adding_years(
    contact_event: DataFrame, identity: DataFrame, contact_tag: DataFrame, as_of: date
) -> DataFrame:
    """Distinct (member id text, add year, added through the mini-program).

    What the marts need of :func:`contact_adds`. Union ids are looked up and dropped before
    members are: a device then has two rows a year at most, so a device that many members
    and many union ids share does not meet in all their pairs.
    """
    devices = (
        _with_attributes(_events(contact_event, as_of))
        .select(
            "gio_id",
            F.col("parsed.unionId").alias("union_id"),
            F.year(F.timestamp_seconds("event_time")).alias("add_year"),
        )
        .distinct()
    )
    through_wmp = F.coalesce(F.col("wecom_channel_source") == WMP_SCENE, F.lit(False))
    tags = contact_tag.select("union_id", through_wmp.alias("through_wmp")).distinct()
    tagged = lookup(
        spread_nulls(devices, F.col("union_id"), devices.columns),
        keyed(tags, F.col("union_id"), "through_wmp"),
    )
    adds = tagged.select(
        "gio_id", "add_year", F.coalesce("through_wmp", F.lit(False)).alias("through_wmp")
    ).distinct()
    members = all_identities(identity).filter(F.col("crm_member_id").isNotNull()).distinct()
    return adds.join(members, "gio_id").select("crm_member_id", "add_year", "through_wmp").distinct()


def _bindings(thirdparty_bind: DataFrame) -> DataFrame:
    return thirdparty_bind.filter(
        (F.col("id_type") == BINDING_TYPE) & (F.col("thirdparty_app_id") == BINDING_APP)
    ).select("id_value", "member_detail_id")


def current_relations(
    staff_relation: DataFrame, staff: DataFrame, thirdparty_bind: DataFrame
) -> DataFrame:
    """Relations not deleted, with staff of a known store, and the bound member."""
    relations = staff_relation.filter(F.col("relation_deleted") == 0).select(
        "external_user_unionid",
        "staff_ext_id",
        "relation_created_at",
        F.col("relation_source").alias("created_type"),
        "relation_deleted",
    )
    store_staff = staff.filter(F.col("lego_store_code").isNotNull()).select(
        "staff_ext_id",
        "staff_name",
        "lego_store_code",
        "store_name",
        "distributor",
        "partner",
        "region",
        "channel",
    )
    joined = relations.join(store_staff, "staff_ext_id")
    spread = spread_nulls(joined, F.col("external_user_unionid"), joined.columns)
    bound = keyed(_bindings(thirdparty_bind), F.col("id_value"), "member_detail_id")
    return lookup(spread, bound).drop(SPREAD)


def still_added(
    staff_relation: DataFrame, staff: DataFrame, thirdparty_bind: DataFrame
) -> DataFrame:
    """Members with a current relation, to look up by numeric id.

    ``still_copies`` is how many spellings of the id have one.
    """
    store_staff = staff.filter(F.col("lego_store_code").isNotNull()).select("staff_ext_id")
    union_ids = (
        staff_relation.filter(F.col("relation_deleted") == 0)
        .join(store_staff, "staff_ext_id", "left_semi")
        .select("external_user_unionid")
        .distinct()
    )
    members = (
        keyed(_bindings(thirdparty_bind), F.col("id_value"), "member_detail_id")
        .join(keyed(union_ids, F.col("external_user_unionid")), SPREAD)
        .select("member_detail_id")
        .distinct()
    )
    return (
        keyed(members, int_key("member_detail_id"))
        .groupBy(SPREAD)
        .agg(F.count("*").alias("still_copies"))
    )
