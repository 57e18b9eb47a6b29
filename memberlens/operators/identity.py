"""Which member a device belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.functions.keys import digits_only, int_key

# Fixed value: the identity property that carries the member id.
MEMBER_PROPERTY = "id_CRM_memberid"


def latest_identity(identity: DataFrame) -> DataFrame:
    """One member per device: the newest active all-digit value.

    An unknown update time comes before all others, as NULLs do in the descending order of
    the Postgres family, and ties go to the greater text. The maximum combines before the shuffle, so a device
    with very many updates reaches its task as one row per input split.
    """
    unknown = F.col("update_time").isNull().alias("unknown")
    newest = F.max(F.struct(unknown, "update_time", "prop_value"))
    return (
        identity.filter(
            (F.col("prop_key") == MEMBER_PROPERTY)
            & (F.col("sign") == 1)
            & digits_only("prop_value")
        )
        .groupBy("gio_id")
        .agg(newest.alias("newest"))
        .select("gio_id", F.col("newest.prop_value").alias("prop_value"))
        .select("gio_id", int_key("prop_value").alias("member_detail_id"))
    )


def all_identities(identity: DataFrame) -> DataFrame:
    """Every member value a device ever had, as text, active or not."""
    return identity.filter(F.col("prop_key") == MEMBER_PROPERTY).select(
        "gio_id", F.col("prop_value").alias("crm_member_id")
    )
