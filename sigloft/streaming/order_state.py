"""Resting orders as keyed state, decided by a stream of quotes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "order_id string, ticker string, status string, price double, at bigint"
_ORDER = "ticker string, side string, limit_price double, created_at bigint"


def decide_orders(orders: DataFrame, quotes: DataFrame, timeout: int) -> DataFrame:
    """Streams ``quotes`` (ticker, pos, bid, ask) against ``orders`` (any number of resting orders per ticker) and emits each
    decision once: filled at the ask of the first quote within the limit, expired at the first quote past the timeout.

    Each quote meets the orders of its ticker, and the state is keyed by order, so orders of one ticker don't disturb each other. An
    order is state seeded from the order table and is cleared when decided, so the state holds open orders only. The quotes of an
    order are read chunk by chunk and reduced to the earliest deciding one; none are gathered. Quotes of one ticker must arrive in
    time order across batches; inside a batch they may be in any order. The session needs the RocksDB state store
    (``stateful_session``).
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    order_fields, patience = _ORDER, timeout

    class RestingOrder(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.order = handle.getValueState("order", order_fields)

        def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
            first = initialState.iloc[0]
            self.order.update((first["ticker"], first["side"], float(first["limit_price"]), int(first["created_at"])))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            if not self.order.exists():
                return
            ticker, side, limit, created = self.order.get()
            best = None
            for chunk in rows:
                ask = chunk["ask"] if side == "yes" else 1.0 - chunk["bid"]
                age = chunk["pos"] - created
                deciding = (age > 0) & ((ask <= limit) | (age > patience))
                if deciding.any():
                    at = chunk["pos"][deciding].idxmin()
                    if best is None or chunk["pos"][at] < best[0]:
                        best = (int(chunk["pos"][at]), float(ask[at]))
            if best is None:
                return
            self.order.clear()
            filled = best[1] <= limit
            yield pd.DataFrame({
                "order_id": [key[0]], "ticker": [ticker], "status": ["filled" if filled else "expired"],
                "price": [best[1] if filled else None], "at": [best[0]],
            })

        def close(self) -> None:
            pass

    met = quotes.join(orders.select("ticker", "order_id"), "ticker").select("order_id", "pos", "bid", "ask")
    return met.groupBy("order_id").transformWithStateInPandas(
        statefulProcessor=RestingOrder(), outputStructType=OUTPUT, outputMode="Append", timeMode="None",
        initialState=orders.select("order_id", "ticker", "side", "limit_price", "created_at").groupBy("order_id"),
    )


def decide_or_expire(orders: DataFrame, quotes: DataFrame, timeout: int, delay: str = "0 seconds") -> DataFrame:
    """As ``decide_orders``, with a timer for each order: the first quote within the limit and up to the deadline fills it, and once the
    event time of all quotes has passed the deadline it expires there, whether or not its market was ever quoted again.

    ``quotes`` has a timestamp ``moment`` beside ``pos`` (the same instant in microseconds). Time goes by the quotes of all markets, less
    ``delay``, so a market that falls silent doesn't hold its orders open; quotes behind that time are dropped. The timer is set with the
    seeded state and is kept in the state store, so a run that starts from its checkpoint goes on with it. State is left only for orders
    whose deadline is still ahead. Since a quote past the deadline decides nothing, the result doesn't depend on how quotes fall into batches.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    order_fields, patience = _ORDER, timeout

    def decision(order_id, ticker, status, price, at) -> pd.DataFrame:
        return pd.DataFrame({"order_id": [order_id], "ticker": [ticker], "status": [status], "price": [price], "at": [at]})

    class TimedOrder(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.order = handle.getValueState("order", order_fields)

        def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
            first = initialState.iloc[0]
            self.order.update((first["ticker"], first["side"], float(first["limit_price"]), int(first["created_at"])))
            self.handle.registerTimer((int(first["created_at"]) + patience) // 1000)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            if not self.order.exists():
                return
            ticker, side, limit, created = self.order.get()
            best = None
            for chunk in rows:
                ask = chunk["ask"] if side == "yes" else 1.0 - chunk["bid"]
                age = chunk["pos"] - created
                fitting = (age > 0) & (age <= patience) & (ask <= limit)
                if fitting.any():
                    at = chunk["pos"][fitting].idxmin()
                    if best is None or chunk["pos"][at] < best[0]:
                        best = (int(chunk["pos"][at]), float(ask[at]))
            if best is not None:
                self.handle.deleteTimer((created + patience) // 1000)
                self.order.clear()
                yield decision(key[0], ticker, "filled", best[1], best[0])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.order.exists():
                ticker, _, _, created = self.order.get()
                self.order.clear()
                yield decision(key[0], ticker, "expired", None, created + patience)

        def close(self) -> None:
            pass

    timed = quotes.withWatermark("moment", delay)
    met = timed.join(orders.select("ticker", "order_id"), "ticker").select("order_id", "pos", "bid", "ask", "moment")
    return met.groupBy("order_id").transformWithStateInPandas(
        statefulProcessor=TimedOrder(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
        initialState=orders.select("order_id", "ticker", "side", "limit_price", "created_at").groupBy("order_id"),
    )
