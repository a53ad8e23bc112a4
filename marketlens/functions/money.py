"""Per-line money rules as Column expressions (inputs and outputs are doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens import schemas as S


# Sums keep ten digits after the point and up to 28 before it.
EXACT = "decimal(38,10)"


def exact_sum(amount: Column) -> Column:
    """Sum that does not depend on the order of the rows; an amount of 1e28 or more, which no cell means, counts as none.

    Doubles become decimals one by one, so partial sums add up without rounding.
    """
    return F.sum(amount.try_cast(EXACT))


def shown_sum(amount: Column) -> Column:
    """The same as a double, 0 where there is nothing to add."""
    return F.coalesce(exact_sum(amount), F.lit(0)).cast("double")


def net_quantity(qty: Column, returned: Column) -> Column:
    return qty - returned


def gross_sales(list_price: Column, qty: Column) -> Column:
    """List price times ordered quantity; returns do not reduce it."""
    return list_price * qty


def line_state(status: Column, reason: Column, net_qty: Column, returned: Column) -> Column:
    """One of six states, from accent-free status and reason texts.

    Cancellation wins over returns, returns over the raw status.
    """
    cancelled = status.contains(S.CANCEL_MARK)
    return (
        F.when(cancelled & reason.contains(S.DELIVERY_FAILED_MARK), S.STATE_CANCELLED_AFTER)
        .when(cancelled, S.STATE_CANCELLED_BEFORE)
        .when(net_qty == 0, S.STATE_RETURNED)
        .when((returned > 0) & (net_qty > 0), S.STATE_PARTLY_RETURNED)
        .when(status.contains(S.COMPLETED_MARK), S.STATE_COMPLETED)
        .otherwise(S.STATE_DELIVERING)
    )


def revenue_or_product(revenue: Column, price: Column, qty: Column) -> Column:
    """Given revenue; price times quantity where there is none; 0 where either is missing too."""
    return F.coalesce(revenue, price * qty, F.lit(0.0))


def discount(subsidy: Column, qty: Column, net_qty: Column) -> Column:
    """Seller subsidy per ordered unit, for the units kept."""
    return F.when(qty != 0, subsidy / qty * net_qty).otherwise(F.lit(0.0))


def voucher(order_voucher: Column, paid_ratio: Column, qty: Column, net_qty: Column) -> Column:
    """The line's share of the order voucher per ordered unit, for the units kept."""
    return F.when(qty != 0, order_voucher * paid_ratio / qty * net_qty).otherwise(F.lit(0.0))


def platform_fee(fixed: Column, service: Column, transaction: Column, paid_ratio: Column) -> Column:
    """The line's share of the order's three fees; returns do not reduce it."""
    return (fixed + service + transaction) * paid_ratio


def in_gmv_state(state: Column) -> Column:
    return state.isin(S.GMV_STATES)


def scoped(state: Column, value: Column) -> Column:
    """The value in GMV states, else 0."""
    return F.when(in_gmv_state(state), value).otherwise(F.lit(0.0))


def kept_ship_fee(fee: Column, slot: Column, state: Column) -> Column:
    """Flat fee of an exploded line: only on the first slot, never when cancelled before shipping."""
    carries = (slot.isNull() | (slot == 1)) & (state != S.STATE_CANCELLED_BEFORE)
    return F.when(carries, fee).otherwise(F.lit(0.0))
