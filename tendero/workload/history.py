"""Price history, discount context and the assembled catalogs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import lexicon as lx
from ..functions.money import mean_money
from ..functions.money import pct as money_pct
from ..operators import current as cur
from ..operators import discount as disc
from ..operators import history as his
from ..operators.catalog import observations
from ..plans import exports
from ..sources.sinks import csv_rows
from .base import CTES, ORACLES, avg2, cents, pct, query
from .staging import snapshot_folder

# --- derived tables ---------------------------------------------------------

# Easter Sundays as almanacs list them.
EASTERS = """
    1990-04-15 1991-03-31 1992-04-19 1993-04-11 1994-04-03 1995-04-16 1996-04-07 1997-03-30 1998-04-12 1999-04-04
    2000-04-23 2001-04-15 2002-03-31 2003-04-20 2004-04-11 2005-03-27 2006-04-16 2007-04-08 2008-03-23 2009-04-12
    2010-04-04 2011-04-24 2012-04-08 2013-03-31 2014-04-20 2015-04-05 2016-03-27 2017-04-16 2018-04-01 2019-04-21
    2020-04-12 2021-04-04 2022-04-17 2023-04-09 2024-03-31 2025-04-20 2026-04-05 2027-03-28 2028-04-16 2029-04-01
    2030-04-21 2031-04-13 2032-03-28 2033-04-17 2034-04-09 2035-03-25 2036-04-13 2037-04-05 2038-04-25 2039-04-10
"""
EASTER_ROWS = ", ".join(f"({d[:4]}, DATE '{d}')" for d in EASTERS.split())

CTES["series"] = (
    ("snapshot_rows",),
    """SELECT coalesce(nullif(url, ''), name) AS key, scraped_date AS date, price, name, category, store_name, url
       FROM snapshot_rows WHERE price IS NOT NULL""",
)
CTES["series_summary"] = (
    ("series",),
    f"""SELECT key, lst.name AS name, lst.category AS category, lst.store_name AS store_name,
               coalesce(nullif(lst.url, ''), nullif(fst.url, ''), '') AS url, "count", min_price, max_price, avg_price,
               fst.date AS first_date, lst.date AS last_date, fst.price AS first_price, lst.price AS last_price,
               CAST(lst.price - fst.price AS DECIMAL(18,2)) AS delta_cop,
               {pct('(lst.price - fst.price)', 'fst.price', 4)} AS delta_pct
        FROM (SELECT key, min({{date: date, price: price, name: name, category: category, store_name: store_name, url: url}}) AS fst,
                     max({{date: date, price: price, name: name, category: category, store_name: store_name, url: url}}) AS lst,
                     count(*) AS "count", min(price) AS min_price, max(price) AS max_price, {avg2('price')} AS avg_price
              FROM series GROUP BY key)""",
)
CTES["daily_points"] = (
    ("points",),
    "SELECT key, date AS day, arg_max(price, (ts, event_id)) AS price FROM points GROUP BY key, date",
)

# Listings of the discount context: every event series, its newest price, a list
# price for a third of them, and no history for some.
CTES["context_rows"] = (
    ("points",),
    f"""SELECT key AS rid, price, CASE WHEN u % 3 = 0 THEN {cents('CAST(price * 150 AS BIGINT)')} END AS list_price
        FROM (SELECT key, CAST(split_part(key, '/', 1) AS BIGINT) AS u, arg_max(price, (ts, event_id)) AS price
              FROM points GROUP BY key)""",
)
CTES["context_daily"] = (
    ("daily_points",),
    "SELECT key AS rid, day, price FROM daily_points WHERE CAST(split_part(key, '/', 1) AS BIGINT) % 17 <> 0",
)


def context_ctes(prefix: str, rows: str, daily: str) -> None:
    """Discount context of ``rows(rid, price, list_price)`` over ``daily(rid, day, price)``."""
    name = f"{prefix}_context"
    monday = lambda d: f"({d}) + CAST((8 - isodow({d})) % 7 AS INT)"
    fixed = " UNION ALL ".join(
        f"SELECT {monday(f'make_date(y, {m}, {d})') if moved else f'make_date(y, {m}, {d})'} AS date, "
        f"'{label}' AS label, {position} AS position FROM easters"
        for position, m, d, moved, label in lx.FIXED_HOLIDAYS
    )
    movable = " UNION ALL ".join(
        f"SELECT {monday(f'easter + ({days})') if moved else f'easter + ({days})'}, '{label}', {position} FROM easters"
        for position, days, moved, label in lx.EASTER_HOLIDAYS
    )
    CTES[name] = (
        (rows, daily, "matches"),
        f"""
        WITH years AS (SELECT DISTINCT CAST(year(day) AS INT) AS y FROM {daily}),
        easters AS (SELECT y, easter FROM years JOIN (VALUES {EASTER_ROWS}) AS known(y, easter) USING (y)),
        calendar AS (SELECT date, arg_max(label, position) AS label, min(position) AS position
                     FROM ({fixed} UNION ALL {movable}) GROUP BY date),
        heads AS (SELECT rid, max(price) AS highest, arg_max(price, day) AS cur, max(day) AS until FROM {daily} GROUP BY rid),
        diffs AS (SELECT d.rid, max(d.day) FILTER (abs(d.price - cur) >= 0.01) AS diff
                  FROM {daily} d JOIN heads USING (rid) GROUP BY d.rid),
        starts AS (SELECT d.rid, min(d.day) AS start FROM {daily} d JOIN diffs USING (rid)
                   WHERE diff IS NULL OR d.day > diff GROUP BY d.rid),
        facts AS (
            SELECT r.rid,
                   CASE WHEN cur IS NULL THEN coalesce(r.list_price > r.price, false)
                        ELSE (highest > 0 AND cur < highest * 0.98) OR coalesce(r.list_price > cur * 1.02, false) END AS has_discount,
                   CASE WHEN cur IS NULL THEN CASE WHEN r.list_price > r.price THEN r.list_price END
                        WHEN highest > 0 AND cur < highest * 0.98 THEN highest
                        WHEN r.list_price > cur * 1.02 THEN r.list_price ELSE highest END AS reference_price,
                   CASE WHEN cur IS NULL THEN CASE WHEN r.list_price > r.price THEN r.price END ELSE cur END AS current_price,
                   start, until,
                   CASE WHEN cur IS NULL AND r.list_price > r.price THEN '{lx.NOTE_LIST_PRICE}' ELSE '{lx.NOTE_OBSERVED}' END AS reference_price_note
            FROM {rows} r LEFT JOIN heads USING (rid) LEFT JOIN starts USING (rid)),
        facts2 AS (SELECT * EXCLUDE (start, until), CASE WHEN has_discount THEN start END AS discount_start,
                          CASE WHEN has_discount THEN until END AS discount_observed_until FROM facts),
        own_years AS (SELECT DISTINCT rid, year(day) AS y FROM {daily}),
        signals AS (
            SELECT f.rid, 1 AS grp, abs(date_diff('day', discount_start, c.date)) AS far, year(c.date) AS k1, position AS k2, '' AS k3,
                   'holiday' AS kind, c.date, c.label, date_diff('day', discount_start, c.date) AS off,
                   CASE WHEN c.date = discount_start THEN '{lx.NOTE_HOLIDAY}' ELSE '{lx.NOTE_NEAR_HOLIDAY}' END AS note
            FROM facts2 f JOIN calendar c ON abs(date_diff('day', discount_start, c.date)) <= 7
            JOIN own_years o ON o.rid = f.rid AND o.y = year(c.date)
            UNION ALL
            SELECT f.rid, 2, abs(date_diff('day', discount_start, m.date)), 0, date_diff('day', DATE '2000-01-01', m.date), m.label,
                   'match', m.date, m.label, date_diff('day', discount_start, m.date),
                   CASE WHEN venue IS NULL OR contains(lower(venue), 'local') THEN '{lx.NOTE_LOCAL_MATCH}'
                        ELSE 'partido cercano (' || lower(venue) || ')' END
            FROM facts2 f JOIN matches m ON abs(date_diff('day', discount_start, m.date)) <= 7),
        texts AS (SELECT rid, string_agg(kind || '|' || date || '|' || label || '|' || off || '|' || note, ';'
                         ORDER BY grp, far, k1, k2, k3) AS signals FROM signals GROUP BY rid)
        SELECT rid, has_discount, reference_price, current_price,
               CASE WHEN has_discount THEN CAST(reference_price - current_price AS DECIMAL(18,2)) END AS discount_amount,
               CASE WHEN has_discount THEN {pct('(reference_price - current_price)', 'reference_price')} END AS discount_pct,
               discount_start, discount_observed_until, reference_price_note, coalesce(signals, '') AS signals
        FROM facts2 LEFT JOIN texts USING (rid)""",
    )


context_ctes("events", "context_rows", "context_daily")


def signal_text(signals):
    return F.array_join(
        F.transform(
            signals,
            lambda s: F.concat_ws(
                "|", s["kind"], s["date"].cast("string"), s["label"], s["days_offset"].cast("string"), s["note"]
            ),
        ),
        ";",
    )


def history_text(history):
    return F.array_join(
        F.transform(history, lambda p: F.concat(p["date"].cast("string"), F.lit("="), p["price"].cast("string"))), " "
    )


HISTORY_SQL = "string_agg(day || '=' || price, ' ' ORDER BY day)"


def context_columns(c: str = "pricing_context"):
    names = [n for n in disc.CONTEXT_FIELDS if n != "signals"]
    return [F.col(f"{c}.{n}").alias(n) for n in names] + [signal_text(F.col(f"{c}.signals")).alias("signals")]


def context_rows(t):
    newest = t.points.groupBy("key").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"))
    user = F.split_part("key", F.lit("/"), F.lit(1)).cast("bigint")
    rows = newest.withColumn(
        "list_price", F.when(user % 3 == 0, (F.col("price") * F.lit("1.50").cast("decimal(3,2)")).cast("decimal(18,2)"))
    )
    daily = t.points.groupBy("key", F.col("date").alias("day")).agg(
        F.max_by("price", F.struct("ts", "event_id")).alias("price")
    )
    history = his.collect_history(daily.filter(user % 17 != 0), ["key"])
    return his.attach_history(rows, history, ["key"])


# --- F: stats over histories ------------------------------------------------


@query(
    "f5_history_stats",
    f"""SELECT product_id, count(*) AS points, min(price) AS min_price, max(price) AS max_price, {avg2('price')} AS avg_price
        FROM prices JOIN listings USING (listing_id) WHERE product_id IS NOT NULL GROUP BY product_id""",
    "prices", "listings",
)
def _(t):
    return his.history_stats(his.product_history(t, limit=None))


@query(
    "f6_h2_daily_series",
    f"""SELECT key, date, max(price) AS price_cop, {avg2('price')} AS avg_price_cop, min(price) AS min_price_cop,
               max(price) AS max_price_cop, count(*) AS samples FROM series GROUP BY key, date""",
    "series",
)
def _(t):
    return his.daily_series(his.series_points(t.snapshot_rows))


@query(
    "f6_daily_series_events",
    f"""SELECT key, date, max(price) AS price_cop, {avg2('price')} AS avg_price_cop, min(price) AS min_price_cop,
               max(price) AS max_price_cop, count(*) AS samples FROM points GROUP BY key, date""",
    "points",
)
def _(t):
    return his.daily_series(t.points)


@query(
    "f7_j6_daily_last_price",
    """SELECT listing_id, CAST(captured_at AS DATE) AS day, arg_max(price, (captured_at, price_id, -price)) AS price
       FROM prices GROUP BY ALL""",
    "prices",
)
def _(t):
    return cur.daily_last_price(t.prices)


F8 = """SELECT snapshot_store, url, name, snapshot_day AS day, arg_max(price, line_order) AS price
        FROM snapshot_rows WHERE name <> '' AND price IS NOT NULL GROUP BY ALL"""


@query("f8_daily_last_by_snapshot", F8, "snapshot_rows")
def _(t):
    return cur.daily_last_by_snapshot(t.snapshot_rows)


@query(
    "g5_oldest_points",
    """SELECT product_id, price_id, price FROM (
           SELECT product_id, price_id, price, listing_id,
                  row_number() OVER (PARTITION BY product_id ORDER BY captured_at, price_id, price, listing_id) AS rn
           FROM prices JOIN listings USING (listing_id) WHERE product_id IS NOT NULL) WHERE rn <= 10""",
    "prices", "listings",
)
def _(t):
    points = observations(t).filter(F.col("product_id").isNotNull())
    return his.oldest_points(points, 10).select("product_id", "price_id", "price")


@query(
    "g6_top_products",
    """SELECT key, name, last_date, "count" FROM series_summary ORDER BY last_date DESC, "count" DESC, name DESC, key DESC LIMIT 20""",
    "series_summary",
)
def _(t):
    summary = his.series_summary(his.series_points(t.snapshot_rows))
    return his.top_products(summary).select("key", "name", "last_date", "count")


# --- H ----------------------------------------------------------------------


@query("h1_series_points", "SELECT key, date, price, name, category FROM series", "series")
def _(t):
    return his.series_points(t.snapshot_rows).select("key", "date", "price", "name", "category")


@query("h3_series_summary", "SELECT * FROM series_summary", "series_summary")
def _(t):
    return his.series_summary(his.series_points(t.snapshot_rows))


@query(
    "h4_series_export",
    """SELECT key, "count", delta_cop, part, history, CASE WHEN part = 1 THEN days END AS days FROM series_summary
       JOIN (SELECT key, CAST((rn - 1) // 50 + 1 AS INT) AS part, string_agg(date || '=' || price, ' ' ORDER BY rn) AS history
             FROM (SELECT key, date, price, row_number() OVER (PARTITION BY key ORDER BY date, price) AS rn FROM series)
             GROUP BY ALL) USING (key)
       JOIN (SELECT key, string_agg(date || '=' || mx || 'x' || n, ' ' ORDER BY date) AS days FROM (
                 SELECT key, date, max(price) AS mx, count(*) AS n FROM series GROUP BY key, date) GROUP BY key) USING (key)""",
    "series", "series_summary",
)
def _(t):
    points = F.transform(
        "history", lambda p: F.concat(p["date"].cast("string"), F.lit("="), p["price_cop"].cast("string"))
    )
    days = F.transform(
        "daily_series",
        lambda d: F.concat(
            d["date"].cast("string"), F.lit("="), d["price_cop"].cast("string"), F.lit("x"), d["samples"].cast("string")
        ),
    )
    return his.series_export(his.series_points(t.snapshot_rows), 50).select(
        "key", "count", "delta_cop", "part",
        F.array_join(points, " ").alias("history"),
        F.array_join(days, " ").alias("days"),
    )


@query(
    "h5_product_history",
    f"""SELECT product_id, count(*) AS points, min(price) AS min_price, max(price) AS max_price, {avg2('price')} AS avg_price
        FROM (SELECT product_id, price, row_number() OVER (PARTITION BY product_id ORDER BY captured_at, price_id, price, listing_id) AS rn
              FROM prices JOIN listings USING (listing_id) JOIN stores USING (store_id)
              WHERE product_id IS NOT NULL AND slug = 'nation_9'
                AND captured_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-01-01')
        WHERE rn <= 25 GROUP BY product_id""",
    "prices", "listings",
)
def _(t):
    return his.history_stats(his.product_history(t, "nation_9", "1996-01-01", "2000-01-01", 25))


@query(
    "h6_history_deltas",
    f"""SELECT key, latest, previous, week_ago, CAST(latest - week_ago AS DECIMAL(18,2)) AS variance_cop,
               {pct('(latest - week_ago)', 'week_ago')} AS variance_pct
        FROM (SELECT rid AS key, any_value(r.price) FILTER (d.price IS NULL) AS own,
                     coalesce(max(d.price) FILTER (rn = 1), any_value(r.price)) AS latest,
                     max(d.price) FILTER (rn = 2) AS previous,
                     max(d.price) FILTER (rn = least(n, 8)) AS week_ago
              FROM context_rows r LEFT JOIN (
                  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY day DESC) AS rn, count(*) OVER (PARTITION BY rid) AS n
                  FROM context_daily) d USING (rid) GROUP BY rid)""",
    "context_rows", "context_daily",
)
def _(t):
    return his.history_deltas(context_rows(t)).select(
        "key", "latest", "previous", "week_ago", "variance_cop", "variance_pct"
    )


@query(
    "h7_history_array",
    f"""SELECT listing_id, {HISTORY_SQL} AS history FROM (
            SELECT listing_id, CAST(captured_at AS DATE) AS day, arg_max(price, (captured_at, price_id, -price)) AS price
            FROM prices WHERE captured_at >= TIMESTAMP '2001-11-05' - INTERVAL 730 DAY GROUP BY ALL)
        GROUP BY listing_id""",
    "prices",
)
def _(t):
    return his.history_array(t, "2001-11-05", 730).select("listing_id", history_text("history").alias("history"))


@query(
    "e8_attach_history",
    f"""SELECT r.rid AS key, coalesce(history, '') AS history FROM context_rows r
        LEFT JOIN (SELECT rid, {HISTORY_SQL} AS history FROM context_daily GROUP BY rid) USING (rid)""",
    "context_rows", "context_daily",
)
def _(t):
    return context_rows(t).select("key", history_text("history").alias("history"))


# --- I ----------------------------------------------------------------------


@query("i9_pricing_context", "SELECT * EXCLUDE (rid), rid AS key FROM events_context", "events_context")
def _(t):
    calendar = dates.holiday_calendar(t.points.select(F.year("date").alias("year")))
    return disc.pricing_context(context_rows(t), t.matches, calendar).select("key", *context_columns())


@query(
    "i1_i5_discount_facts",
    """SELECT rid AS key, has_discount, reference_price, current_price, discount_start, discount_observed_until,
              discount_amount, discount_pct FROM events_context""",
    "events_context",
)
def _(t):
    return disc.discount_facts(context_rows(t)).select(
        "key", "has_discount", "reference_price", "current_price", "discount_start",
        "discount_observed_until", "discount_amount", "discount_pct",
    )


HOLIDAYS_BODY = CTES["events_context"][1].split("heads AS", 1)[0].rstrip().rstrip(",")


CTES["order_days"] = ((), "SELECT CAST(o_orderdate AS DATE) AS day FROM orders")


@query(
    "i6_holiday_calendar",
    HOLIDAYS_BODY.replace("FROM context_daily", "FROM order_days").strip()
    + " SELECT date, label, position FROM calendar",
    "order_days",
)
def _(t):
    years = t.read("orders").select(F.year("o_orderdate").alias("year"))
    return dates.holiday_calendar(years)


@query(
    "e9_i7_i8_nearby_events",
    """SELECT start, label, days_offset FROM (
           SELECT DISTINCT CAST(o_orderdate AS DATE) + CAST(round(date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT min(date) FROM matches))) AS INT) AS start FROM orders) s
       JOIN (SELECT date, label FROM matches) m ON abs(date_diff('day', start, date)) <= 7,
       LATERAL (SELECT CAST(date_diff('day', start, date) AS INT) AS days_offset) o""",
    "matches",
)
def _(t):
    # the order days moved so that the first falls on the first match
    first = t.read("orders").agg(F.min(F.to_date("o_orderdate")).alias("o")).first().o
    moved = (t.matches.agg(F.min("date").alias("m")).first().m - first).days
    starts = t.read("orders").select(F.date_add(F.to_date("o_orderdate"), moved).alias("start")).distinct()
    near = disc.nearby_events(t.matches)
    return starts.join(near, F.col("start") == F.col("day")).select("start", "label", "days_offset")


# --- J ----------------------------------------------------------------------


@query(
    "j1_j2_j4_day_functions",
    """SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) AS parsed,
              CAST(ts AS DATE) + CAST((8 - isodow(CAST(ts AS DATE))) % 7 AS INT) AS monday,
              CAST(date_diff('day', DATE '2024-01-15', CAST(ts AS DATE)) AS INT) AS days_offset,
              TRY_CAST(left(event_type, 10) AS DATE) AS no_date
       FROM events""",
)
def _(t):
    day = F.to_date("ts")
    return t.read("events").select(
        "event_id",
        dates.to_day(F.col("ts")).alias("day"),
        dates.parse_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("parsed"),
        dates.monday_on_or_after(day).alias("monday"),
        dates.day_offset(day, F.lit("2024-01-15").cast("date")).alias("days_offset"),
        dates.parse_date(F.col("event_type")).alias("no_date"),
    )


@query(
    "j3_parse_stamp",
    "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS stamp, NULL::VARCHAR AS no_stamp FROM events",
)
def _(t):
    stamp = dates.parse_stamp(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    bad = dates.parse_stamp(F.date_format("ts", "yyyyMMdd HHmmss"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t.read("events").select("event_id", shown(stamp).alias("stamp"), shown(bad).alias("no_stamp"))


@query(
    "j5_years_of_history",
    """SELECT listing_id, string_agg(DISTINCT CAST(year(captured_at) AS VARCHAR), ',' ORDER BY CAST(year(captured_at) AS VARCHAR)) AS years
       FROM prices GROUP BY listing_id""",
    "prices",
)
def _(t):
    days = his.history_array(t, None, None)
    years = dates.years_of(F.transform("history", lambda p: p["date"]))
    return days.select("listing_id", F.array_join(years.cast("array<string>"), ",").alias("years"))


@query(
    "j11_math_functions",
    f"""SELECT key, min(price) AS lowest, max(price) AS highest, {avg2('price')} AS mean,
              CAST(max(abs(price - 50)) AS DECIMAL(18,2)) AS farthest, {pct('(max(price) - min(price))', 'max(price)')} AS spread_pct
       FROM points GROUP BY key""",
    "points",
)
def _(t):
    spread = F.max("price") - F.min("price")
    return t.points.groupBy("key").agg(
        F.min("price").alias("lowest"), F.max("price").alias("highest"), mean_money("price").alias("mean"),
        F.max(F.abs(F.col("price") - 50)).cast("decimal(18,2)").alias("farthest"),
        money_pct(spread, F.max("price")).alias("spread_pct"),
    )


@query(
    "j8_as_json",
    """SELECT rid AS key, price, coalesce(n, 0) AS points, last_day FROM context_rows
       LEFT JOIN (SELECT rid, count(*) AS n, CAST(max(day) AS VARCHAR) AS last_day FROM context_daily GROUP BY rid) USING (rid)""",
    "context_rows", "context_daily",
)
def _(t):
    # the row goes through its JSON text and back
    raw = context_rows(t).select("key", F.to_json(F.struct("price", "history")).alias("raw"))
    back = F.from_json(
        "raw", "price DECIMAL(18,2), history ARRAY<STRUCT<date: STRING, price: DECIMAL(18,2)>>"
    )
    return raw.select("key", back.alias("b")).select(
        "key", "b.price",
        F.size("b.history").cast("bigint").alias("points"),
        F.try_element_at("b.history", F.lit(-1))["date"].alias("last_day"),
    )


# --- Q ----------------------------------------------------------------------

CTES["newest"] = (
    ("snapshot_rows",),
    """SELECT *, dense_rank() OVER (PARTITION BY snapshot_store ORDER BY snapshot_day DESC) AS age FROM snapshot_rows""",
)
CTES["file_products"] = (
    ("newest",),
    """SELECT store || '-' || substr(sha1(url), 1, 16) AS id, snapshot_store || ' ' || url || ' ' || name AS rid, name AS title, store, store_name,
              array_to_string(list_transform(string_split(replace(category, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS category,
              price, CASE WHEN list_price > price THEN list_price END AS list_price, image_url AS img, url, scraped_date
       FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_store, url ORDER BY line_order) AS rn
             FROM newest WHERE age = 1 AND name <> '' AND price IS NOT NULL AND url <> '') WHERE rn = 1""",
)
CTES["file_daily"] = (
    ("newest",),
    """SELECT snapshot_store || ' ' || url || ' ' || name AS rid, snapshot_day AS day, arg_max(price, line_order) AS price
       FROM newest WHERE age <= 8 AND name <> '' AND price IS NOT NULL GROUP BY ALL""",
)
CTES["file_rows"] = (("file_products",), "SELECT rid, price, list_price FROM file_products")
CTES["file_daily_kept"] = (("file_daily", "file_rows"), "SELECT * FROM file_daily SEMI JOIN file_rows USING (rid)")
context_ctes("file", "file_rows", "file_daily_kept")

Q_COLUMNS = "id, title, store, store_name, category, price, list_price, img, url, scraped_date"


@query(
    "q1_snapshot_catalog",
    f"""SELECT {Q_COLUMNS}, coalesce(history, '') AS history, c.* EXCLUDE (rid)
        FROM file_products JOIN file_context c USING (rid)
        LEFT JOIN (SELECT rid, {HISTORY_SQL} AS history FROM file_daily GROUP BY rid) USING (rid)""",
    "file_products", "file_context", "file_daily",
)
def _(t):
    return exports.snapshot_catalog(t.snapshot_rows, t.matches).select(
        *Q_COLUMNS.split(", "), history_text("history").alias("history"), *context_columns()
    )


@query(
    "q1_snapshot_folder_catalog",
    f"SELECT * REPLACE (CAST(scraped_date AS VARCHAR) AS scraped_date) FROM ({ORACLES['q1_snapshot_catalog']})",
)
def _(t):
    """As q1_snapshot_catalog, from written snapshots: only the newest ones are read."""
    return exports.snapshot_folder_catalog(t.spark, snapshot_folder(t), t.matches).select(
        *Q_COLUMNS.split(", "), history_text("history").alias("history"), *context_columns()
    )


CTES["table_rows"] = (
    ("export_rows",),
    "SELECT listing_id AS rid, price, CASE WHEN list_price > price THEN list_price END AS list_price FROM export_rows",
)
CTES["table_daily"] = (
    ("prices",),
    """SELECT listing_id AS rid, CAST(captured_at AS DATE) AS day, arg_max(price, (captured_at, price_id, -price)) AS price
       FROM prices WHERE captured_at >= TIMESTAMP '2001-11-05' - INTERVAL 730 DAY GROUP BY ALL""",
)
CTES["table_daily_kept"] = (("table_daily", "table_rows"), "SELECT * FROM table_daily SEMI JOIN table_rows USING (rid)")
context_ctes("table", "table_rows", "table_daily_kept")


@query(
    "q2_table_catalog",
    f"""SELECT store || '-' || substr(sha1(url), 1, 16) AS id, title, store, store_name, category, e.price, r.list_price,
               img, url, CAST(captured_at AS DATE) AS scraped_date, barcode, brand, coalesce(history, '') AS history, c.* EXCLUDE (rid)
        FROM export_rows e JOIN table_rows r ON r.rid = listing_id JOIN table_context c ON c.rid = listing_id
        LEFT JOIN (SELECT rid, {HISTORY_SQL} AS history FROM table_daily GROUP BY rid) h ON h.rid = listing_id""",
    "export_rows", "table_context", "table_daily",
)
def _(t):
    return exports.table_catalog(t, t.matches, date(2001, 11, 5), 730).select(
        *Q_COLUMNS.split(", "), "barcode", "brand", history_text("history").alias("history"), *context_columns()
    )


@query(
    "b2_history_csv_rows",
    """SELECT key, name, category, store_name, url, CAST("count" AS VARCHAR) AS "count", CAST(min_price AS VARCHAR) AS min_price,
              CAST(max_price AS VARCHAR) AS max_price, CAST(avg_price AS VARCHAR) AS avg_price, CAST(first_date AS VARCHAR) AS first_date,
              CAST(last_date AS VARCHAR) AS last_date, CAST(first_price AS VARCHAR) AS first_price, CAST(last_price AS VARCHAR) AS last_price,
              CAST(delta_cop AS VARCHAR) AS delta_cop, coalesce(CAST(delta_pct AS VARCHAR), '') AS delta_pct
       FROM series_summary""",
    "series_summary",
)
def _(t):
    return csv_rows(his.series_summary(his.series_points(t.snapshot_rows)))
