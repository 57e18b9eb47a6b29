"""The input tables by role, and where to read them from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Schema and name of each input in the source warehouse, and the columns
# that the marts read.
SOURCE_TABLES = {
    "member": "edw.d_member_detail",
    "order_line": "edw.f_omni_channel_order_detail",
    "crm_map": "edw.f_crm_member_detail",
    "member_order": "edw.f_member_order_detail",
    "contact_event": "stg.gio_event_local",
    "identity": "stg.gio_id_user_account_all",
    "page_view": "ods.wc_page_view",
    "contact_tag": "edw.d_dl_sa_external_user_tag",
    "staff_relation": "edw.f_sa_staff_external_user_relation_detail",
    "staff": "edw.d_sa_staff_info",
    "thirdparty_bind": "edw.f_crm_thirdparty_bind_detail",
    "ec_history": "edw.d_belong_channel_inc_ec_his_mbr",
    "order_scenario": "dm_view.offline_lcs_cs__by_sku_fnl",
}
COLUMNS = {
    "member": "member_detail_id join_time eff_reg_channel",
    "order_line": (
        "order_paid_date source_channel sales_type order_type type_name type_value"
        " crm_member_detail_id if_eff_order_tag sales_qty is_member_order order_rrp_amt"
        " parent_order_id original_order_id payment_type"
    ),
    "crm_map": "id member_id",
    "member_order": (
        "crm_member_id date_id is_rrp_sales_type distributor_name if_eff_order_tag"
        " initial_vs_repurchase_lifecycle"
    ),
    "contact_event": "event_key event_time attributes gio_id",
    "identity": "gio_id prop_key prop_value sign update_time",
    "page_view": "gio_id event_time page_type",
    "contact_tag": "union_id wecom_channel_source",
    "staff_relation": (
        "external_user_unionid staff_ext_id relation_created_at relation_source"
        " relation_deleted"
    ),
    "staff": (
        "staff_ext_id staff_name lego_store_code store_name distributor partner region channel"
    ),
    "thirdparty_bind": "id_type thirdparty_app_id id_value member_detail_id",
    "ec_history": "belong_type eff_belong_channel member_detail_id platform_id_value",
    "order_scenario": "parent_order_id order_scenario",
}
# What types the marts can work with, by column; the others are taken as text.
IDS = "string, varchar, char, byte, tinyint, smallint, int, bigint, decimal"
KINDS = {
    "time": ("timestamp, timestamp_ntz, date", "join_time order_paid_date date_id update_time relation_created_at"),
    "flag": ("boolean", "if_eff_order_tag is_member_order"),
    "number": (
        "tinyint, smallint, int, bigint, float, double, decimal",
        "sales_type sales_qty is_rrp_sales_type sign relation_deleted thirdparty_app_id",
    ),
    "amount": ("tinyint, smallint, int, bigint, float, double, decimal, string", "order_rrp_amt"),
    "id": (
        IDS,
        "member_detail_id type_value crm_member_detail_id parent_order_id original_order_id id member_id"
        " crm_member_id staff_ext_id",
    ),
}
#: Columns that are a time in one input and seconds in another.
OWN_KINDS = {("page_view", "event_time"): "time", ("contact_event", "event_time"): "number"}


class Tables:
    """Tables by role, opened when first asked for.

    Besides the inputs, a role may name a table that a run has written: the visit log,
    or a block that several marts share.
    """

    def __init__(self, open_role: Callable[[str], DataFrame]):
        self._open = open_role
        self._opened: dict[str, DataFrame] = {}

    def __contains__(self, role: str) -> bool:
        return role in self._opened or role in SOURCE_TABLES

    def __getitem__(self, role: str) -> DataFrame:
        if role not in self:
            raise KeyError(f"no table '{role}'")
        if role not in self._opened:
            self._opened[role] = self._open(role)
        return self._opened[role]

    def pick(self, *roles: str) -> dict[str, DataFrame]:
        return {role: self[role] for role in roles}

    def with_table(self, role: str, table: DataFrame) -> Tables:
        tables = Tables(self._open)
        tables._opened = {**self._opened, role: table}
        return tables


def from_catalog(spark: SparkSession, names: dict[str, str] | None = None) -> Tables:
    """Inputs from catalog tables; ``names`` replaces single table names."""
    chosen = {**SOURCE_TABLES, **(names or {})}
    return Tables(lambda role: _checked(role, spark.table(chosen[role])))


def from_folder(spark: SparkSession, root: str, file_format: str = "parquet") -> Tables:
    """Inputs from ``<root>/<schema>/<table>`` folders."""

    def read(role: str) -> DataFrame:
        path = f"{root.rstrip('/')}/{SOURCE_TABLES[role].replace('.', '/')}"
        return _checked(role, spark.read.format(file_format).load(path))

    return Tables(read)


def from_frames(frames: dict[str, DataFrame]) -> Tables:
    """Inputs that are already DataFrames, as in tests."""
    return Tables(lambda role: _checked(role, frames[role]))


def kind_of(role: str, column: str) -> str:
    """What a column is to the marts: a time, flag, number, amount, id or text."""
    if (role, column) in OWN_KINDS:
        return OWN_KINDS[role, column]
    return next((kind for kind, (_, names) in KINDS.items() if column in names.split()), "text")


def _checked(role: str, df: DataFrame) -> DataFrame:
    """The columns that the marts read, where they are there and of a type that fits."""
    wanted = COLUMNS[role].split()
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"input '{role}' ({SOURCE_TABLES[role]}) lacks columns {missing}")
    wrong = []
    for column in wanted:
        kind, given = kind_of(role, column), df.schema[column].dataType
        fitting = KINDS[kind][0] if kind in KINDS else IDS
        if given.simpleString().split("(")[0] not in [*fitting.split(", "), "void"]:
            wrong.append(f"{column} is {given.simpleString()}, not a {kind}")
    if wrong:
        raise ValueError(f"input '{role}' ({SOURCE_TABLES[role]}): {'; '.join(wrong)}")
    return df.select(*wanted)
