"""Column functions on prices and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_price(price: Column) -> Column:
    """A finite decimal price over 1."""
    return F.coalesce((price > 1) & ~F.isnan(price) & (price < float("inf")), F.lit(False))


def devig_over(over: Column, under: Column) -> Column:
    """Probability of Over from a two-way price without the bookmaker's margin; null unless both prices are valid."""
    return F.when(valid_price(over) & valid_price(under), (1 / over) / (1 / over + 1 / under))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def no_push(win: Column, push: Column) -> Column:
    """Probability of a win given no push; null if a push is certain."""
    return F.when(push != 1, win / (1 - push))


def fair_price(win: Column, loss: Column) -> Column:
    """The price at which a bet neither wins nor loses on average; null if it cannot win."""
    return F.when(win != 0, (win + loss) / win)


def expected_profit(win: Column, loss: Column, price: Column) -> Column:
    """Expected profit of a unit stake, refunded on a push; null for an invalid price."""
    return F.when(valid_price(price), win * (price - 1) - loss)


def log_loss(p: Column) -> Column:
    """-ln p, infinite at 0 (Spark's ln gives null there)."""
    return F.when(p <= 0, F.lit(float("inf"))).otherwise(-F.log(p))
