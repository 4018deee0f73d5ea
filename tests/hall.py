"""Ledgers of an invented climbing hall, its small annex, and a workspace without rows.

Made for the cases that the tests need: months on both sides of the day, a sale after it,
equal revenues, a sale without a margin, categories in other letter cases, bills that are overdue,
due today, on the last day of a window and one day beyond it, a paid one, and products that expired,
expire on the last day of the window, one day later, and never.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from ledgerspark import schemas

AS_OF = dt.date(2031, 11, 20)
STAMP = dt.datetime(2031, 10, 8)


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def money(text: str | None) -> Decimal | None:
    return None if text is None else Decimal(text)


SALES = [
    ("hall", "s0", "2031-09-30", "DAYPASS", "Day pass", "Entry", 40, "720", "64.5"),
    ("hall", "s1", "2031-10-01", "DAYPASS", "Day pass", "Entry", 25, "450", None),
    ("hall", "s2", "2031-10-01", "SHOE", "Rental shoe", "Rental", 12, "96", "80"),
    ("hall", "s3", "2031-10-19", "ROPE", "Rope 60 m", "Gear", 2, "318.40", "22.5"),
    ("hall", "s4", "2031-11-03", "CARD10", "Ten visits", "Entry", 6, "900", "55"),
    ("hall", "s5", "2031-11-03", "ROPE", "Rope 60 m", "Gear", 1, "159.20", "22.5"),
    ("hall", "s6", "2031-11-03", "CHALK", "Chalk", "Gear", 30, "477.60", "41.4"),
    ("hall", "s7", "2031-11-20", "SHOE", "Rental shoe", "Rental", 5, "40", "80"),
    ("hall", "s8", "2031-11-28", "DAYPASS", "Day pass", "Entry", 10, "180", "64.5"),
    ("annex", "s9", "2031-11-20", "SHOE", "Rental shoe", "Rental", 1, "8", None),
]
PURCHASES = [
    ("hall", "p0", "2031-10-02", "Vertical Supply", "ROPE", 10, "1100"),
    ("hall", "p1", "2031-10-02", "Dust & Co", "CHALK", 200, "460"),
    ("hall", "p2", "2031-11-10", "Vertical Supply", "SHOE", 30, "1350"),
    ("hall", "p3", "2031-11-12", "Dust & Co", "CHALK", 100, "240"),
]
PRODUCTS = [
    ("hall", "CHALK", "Chalk", "Gear", "15.92", 120, None),
    ("hall", "TAPE", "Finger tape", "Gear", "4.50", 40, "2032-01-04"),
    ("hall", "BAR", "Energy bar", "Snacks", "2.20", 50, "2031-11-01"),
    ("hall", "GEL", "Energy gel", "Snacks", "1.80", 70, "2032-01-05"),
    ("hall", "ROPE", "Rope 60 m", "Gear", "159.20", 8, None),
]
EXPENSES = [
    ("hall", "e0", "2031-09-01", "Hall lease", "Premises", "2400"),
    ("hall", "e1", "2031-09-14", "Electricity", "utilities", "310.50"),
    ("hall", "e2", "2031-10-01", "Hall lease", "Premises", "2400"),
    ("hall", "e3", "2031-10-14", "Electricity", "Utilities", "298.50"),
    ("hall", "e4", "2031-10-20", "Route setting", "Staff", "540"),
    ("hall", "e5", "2031-11-01", "Hall lease", "Premises", "2400"),
    ("hall", "e6", "2031-11-14", "Electricity", "UTILITIES", "351"),
    ("hall", "e7", "2031-11-14", "Water", "Utilities", "80"),
    ("hall", "e8", "2031-11-18", "New holds", "Gear", "5040"),
]
BILLS = [
    ("hall", "o0", "Hall lease", "Premises", "2400", "2031-11-22", "monthly", "due"),
    ("hall", "o1", "Electricity", "Utilities", "330", "2031-11-30", "monthly", "scheduled"),
    ("hall", "o2", "Holds order", "supplier", "5200", "2031-11-24", "quarterly", "scheduled"),
    ("hall", "o3", "Insurance", "Premises", "990", "2031-12-01", "annual", "due"),
    ("hall", "o4", "Water", "Utilities", "75", "2031-11-20", "monthly", "paid"),
    ("hall", "o5", "Rope order", "Supplier", "1800", "2031-11-19", "monthly", "due"),
    ("annex", "o6", "Annex lease", "Premises", "100", "2031-11-20", "monthly", "due"),
]


def ledgers(spark) -> dict:
    make = spark.createDataFrame
    return {
        "workspaces": make([(w, w.title()) for w in ("hall", "annex", "quiet")], schemas.WORKSPACES),
        "sales": make(
            [(w, i, d(day), *rest, money(a), money(m), STAMP) for w, i, day, *rest, a, m in SALES],
            schemas.SALES,
        ),
        "purchases": make(
            [(w, i, d(day), *rest, money(a), STAMP) for w, i, day, *rest, a in PURCHASES],
            schemas.PURCHASES,
        ),
        "products": make(
            [(*named, money(price), n, end and d(end), STAMP) for *named, price, n, end in PRODUCTS],
            schemas.PRODUCTS,
        ),
        "expenses": make(
            [(w, i, d(day), *rest, money(a), STAMP) for w, i, day, *rest, a in EXPENSES],
            schemas.EXPENSES,
        ),
        "obligations": make(
            [(*named, money(a), d(day), *rest, STAMP) for *named, a, day, r, s in BILLS for rest in [(r, s)]],
            schemas.OBLIGATIONS,
        ),
        "jobs": make([], schemas.IMPORT_JOBS),
        "actions": make([], schemas.ACTIONS),
    }
