"""Sales measures and ratios.

Amounts are added up as whole minor units: exact in any order. Decimal columns of up to 18
digits, 6 of them decimals, use 64-bit integers, far cheaper than wide decimals; all others
use 38-digit integers. A sum too large raises an error; nothing is rounded but amounts of types
that are not exact (DOUBLE, text), which become decimals first (``DOUBLES``). Of those, an amount
that does not fit (NaN, infinite, no number, 10**26 or more) is unknown, like NULL: it never
stops a job, and :meth:`Money.rejected` counts it where the lines are read.

Net sales stay two running sums, what was sold and what came back, until the last step.
Both can be added up again at a coarser grain, and multiplied by the number of matches
of a later join, without changing the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType

ALL_SALES = ["all_sold", "all_returned"]
MEMBER_SALES = ["member_sold", "member_returned"]

#: What amounts of a type that is not exact are cast to before they are added up.
DOUBLES = DecimalType(38, 12)
#: Digits and decimals up to which minor units are 64-bit integers.
NARROW = DecimalType(18, 6)


@dataclass(frozen=True)
class Money:
    """Converts amounts of a decimal type to minor units and back."""

    kind: DecimalType = DecimalType(18, 2)

    @classmethod
    def of(
        cls, lines: DataFrame, column: str = "order_rrp_amt", doubles: DecimalType = DOUBLES
    ) -> Money:
        """For the type of a column; ``doubles`` says what other than exact numbers become."""
        kind: DataType = lines.schema[column].dataType
        if isinstance(kind, IntegralType):
            kind = DecimalType(20, 0)
        return cls(kind if isinstance(kind, DecimalType) else doubles)

    @property
    def narrow(self) -> bool:
        return self.kind.precision <= NARROW.precision and self.kind.scale <= NARROW.scale

    def exact(self, amount: Column) -> Column:
        """The amount as a decimal; NULL where it does not fit."""
        return amount.try_cast(self.kind)

    def rejected(self, column: str = "order_rrp_amt") -> Column:
        """How many amounts there are that do not fit, as an aggregate."""
        amount = F.col(column)
        return F.count(F.when(amount.isNotNull() & self.exact(amount).isNull(), 1))

    def units(self, amount: Column) -> Column:
        exact = self.exact(amount)
        unit = F.lit(10**self.kind.scale)
        if self.narrow:
            return (exact * unit).cast("bigint")
        # Whole part and decimals apart: one product would exceed 38 digits and be rounded,
        # as would the sign or absolute value of a number of more than 34.
        unit = unit.cast(DecimalType(self.kind.scale + 1, 0))
        whole = F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact))
        rest = exact % F.lit(1).cast("decimal(1,0)")
        parts = [(p * unit).cast("decimal(38,0)") for p in (whole, rest)]
        return (parts[0] + parts[1]).cast("decimal(38,0)")

    def amount(self, units: Column) -> Column:
        """Exact up to 6 decimals, else the nearest double."""
        if self.kind.scale <= NARROW.scale:
            return units.cast("decimal(38,0)") / F.lit(10**self.kind.scale)
        return units.cast("double") / F.lit(float(10**self.kind.scale))

    def sums(self, *, members_only: bool = False, copies: str | None = None) -> list[Column]:
        """Aggregates over lines: what was sold and what came back, in minor units.

        ``copies`` names a column with how many lines a row stands for.
        """
        names = MEMBER_SALES if members_only else ALL_SALES
        wanted = F.col("is_member_order") if members_only else F.lit(True)
        quantity, units = F.col("sales_qty"), self.units(F.col("order_rrp_amt"))
        if copies:
            # A row that stands for no line adds nothing, not 0: unknown amounts stay unknown.
            units = F.when(F.col(copies) > 0, units * F.col(copies))
        sold = F.when((quantity > 0) & wanted, units).otherwise(0)
        returned = F.when((quantity < 0) & wanted, F.abs(units)).otherwise(0)
        return [F.sum(sold).alias(names[0]), F.sum(returned).alias(names[1])]

    def net(self, names: list[str], where: Column | None = None) -> Column:
        """Net amount from the sums of :meth:`sums`, in a last aggregation."""
        parts = [F.col(n) if where is None else F.when(where, F.col(n)) for n in names]
        return self.amount(F.sum(parts[0]) - F.sum(parts[1]))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double-precision quotient; NULL where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def zero_to_null(count: Column) -> Column:
    return F.when(count != 0, count)
