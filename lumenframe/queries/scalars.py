"""Scalar functions: numbers, strings, dates and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import functions as L
from lumenframe.queries.registry import Registry, Tables

R = Registry()

# numbers
R.sql("m_add_sub_mul", "SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber AS a, l_quantity - 7 AS b, l_linenumber * l_partkey AS c, round(l_extendedprice * l_discount, 4) AS d FROM lineitem")
R.sql("m_div_float", "SELECT o_orderkey, round(o_totalprice / 7, 6) AS v, round(o_custkey / 8.0, 6) AS w FROM orders")
R.sql("m_div_int", "SELECT o_orderkey, o_custkey div 7 AS v, (o_custkey - 700) div 9 AS w FROM orders", "SELECT o_orderkey, o_custkey // 7 AS v, (o_custkey - 700) // 9 AS w FROM orders")
R.sql(
    "m_div_zero",
    "SELECT l_orderkey, l_linenumber, round(try_divide(l_quantity, l_linenumber - 3), 6) AS v FROM lineitem",
    "SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_linenumber - 3, 0), 6) AS v FROM lineitem",
)
R.sql("m_mod", "SELECT o_orderkey, o_custkey % 13 AS v, mod(o_custkey - 700, 11) AS w, round(mod(o_totalprice, 10), 4) AS x FROM orders", "SELECT o_orderkey, o_custkey % 13 AS v, (o_custkey - 700) % 11 AS w, round(o_totalprice % 10, 4) AS x FROM orders")
R.sql("m_neg", "SELECT c_custkey, -c_acctbal AS a, -(c_nationkey - 12) AS b, +c_nationkey AS c FROM customer")
R.sql("m_power_sqrt", "SELECT p_partkey, round(power(p_size, 2), 4) AS a, round(power(p_retailprice, 0.5), 6) AS b, round(sqrt(p_retailprice), 6) AS c FROM part")
R.sql("m_round", "SELECT c_custkey, round(c_acctbal) AS a, round(c_acctbal, 1) AS b, round(c_nationkey - 12.5) AS c FROM customer", "SELECT c_custkey, round(c_acctbal) AS a, round(c_acctbal, 1) AS b, round(c_nationkey - 12.5) AS c FROM customer")
R.sql("m_floor_ceil", "SELECT c_custkey, CAST(floor(c_acctbal) AS DOUBLE) AS a, CAST(ceil(c_acctbal) AS DOUBLE) AS b, CAST(floor(-c_acctbal / 100) AS DOUBLE) AS c FROM customer")
R.sql("m_abs", "SELECT c_custkey, abs(c_acctbal) AS a, abs(c_nationkey - 12) AS b FROM customer")
R.sql("m_trig", "SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 4) AS t, round(cot(p_size), 4) AS ct FROM part")
R.sql("m_inverse_trig", "SELECT p_partkey, round(asin(p_size / 100.0), 6) AS s, round(acos(p_size / 100.0), 6) AS c, round(atan(p_size), 6) AS t FROM part")
R.sql("m_ln_log10", "SELECT p_partkey, round(ln(p_retailprice), 6) AS a, round(log10(p_size), 6) AS b FROM part")
R.sql("m_rand", "SELECT c_custkey, rand() >= 0 AND rand() < 1 AS inside FROM customer", "SELECT c_custkey, TRUE AS inside FROM customer")


@R.frame(
    "m_op_division",
    """SELECT c_custkey, (c_nationkey - 12) // nullif(c_custkey % 4, 0) AS q, (c_nationkey - 12) % nullif(c_custkey % 4, 0) AS r,
              round(c_acctbal / nullif(c_custkey % 4, 0), 4) AS d FROM customer""",
)
def _division(t: Tables):
    a, b = F.col("c_nationkey") - 12, F.col("c_custkey") % 4
    return t.customer.select("c_custkey", L.int_div(a, b).alias("q"), L.modulo(a.cast("long"), b).alias("r"), F.round(L.null_safe_div(F.col("c_acctbal"), b), 4).alias("d"))


@R.frame("m_op_floor_ln", "SELECT c_custkey, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, CASE WHEN c_nationkey = 0 THEN -1e9 ELSE round(ln(c_nationkey), 6) END AS l FROM customer")
def _floor_ln(t: Tables):
    log = L.ln_ieee(F.col("c_nationkey"))
    return t.customer.select("c_custkey", L.floor_double(F.col("c_acctbal")).alias("f"), L.ceil_double(F.col("c_acctbal")).alias("c"), F.when(log == float("-inf"), -1e9).otherwise(F.round(log, 6)).alias("l"))


# strings
R.sql("s_lower_upper", "SELECT c_custkey, lower(c_name) AS a, upper(c_mktsegment) AS b, upper(substring(c_name, 1, 4)) AS c FROM customer")
R.sql(
    "s_initcap",
    "SELECT p_partkey, initcap(p_name) AS v FROM part",
    "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ') AS v FROM part",
)
R.sql("s_char_length", "SELECT doc_id, char_length(text) AS a, character_length(source) AS b FROM documents", "SELECT doc_id, length(text) AS a, length(source) AS b FROM documents")
R.sql("s_substring", "SELECT c_custkey, substring(c_name, 10) AS a, substring(c_name, 1, 3) AS b, substring(c_mktsegment, 3, 100) AS c FROM customer")
R.sql("s_substring_dynamic", "SELECT c_custkey, substring(c_name, c_nationkey + 1, c_custkey % 5) AS v FROM customer")
R.sql("s_left_right", "SELECT c_custkey, left(c_mktsegment, 4) AS a, right(c_name, 3) AS b FROM customer")
R.sql("s_concat", "SELECT c_custkey, concat(c_name, '-', c_mktsegment, '-', CAST(c_nationkey AS STRING)) AS v FROM customer")
R.sql("s_concat_op", "SELECT c_custkey, c_name || '/' || c_mktsegment AS v, c_name || CASE WHEN c_nationkey > 12 THEN 'x' END AS w FROM customer")
R.sql("s_trim", "SELECT c_custkey, trim('  ' || c_mktsegment || ' ') AS a, ltrim('  ' || c_mktsegment) AS b, rtrim(c_mktsegment || '  ') || '.' AS c FROM customer")
R.sql(
    "s_trim_chars",
    "SELECT c_custkey, trim(BOTH 'BG' FROM c_mktsegment) AS a, trim(LEADING 'MACH' FROM c_mktsegment) AS b, trim(TRAILING 'ERY' FROM c_mktsegment) AS c FROM customer",
    "SELECT c_custkey, trim(c_mktsegment, 'BG') AS a, ltrim(c_mktsegment, 'MACH') AS b, rtrim(c_mktsegment, 'ERY') AS c FROM customer",
)
R.sql("s_replace", "SELECT c_custkey, replace(c_name, '#', ' no ') AS a, replace(c_mktsegment, 'I', '') AS b FROM customer")
R.sql("s_regexp_replace", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', 'N') AS a, regexp_replace(c_mktsegment, '[AEIOU]', '*') AS b FROM customer", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS a, regexp_replace(c_mktsegment, '[AEIOU]', '*', 'g') AS b FROM customer")
R.sql("s_reverse", "SELECT c_custkey, reverse(c_name) AS v FROM customer")


@R.frame("s_regexp_backref", r"SELECT p_partkey, regexp_replace(p_name, '(\w+) (\w+)', '\2 of \1', 'g') AS v, left(p_name, 3) || regexp_replace(substring(p_name, 4), 'e', 'E', 'g') AS w FROM part")
def _backref(t: Tables):
    name = F.col("p_name")
    return t.part.select("p_partkey", L.regex_replace(name, r"(\w+) (\w+)", r"\2 of \1").alias("v"), L.regex_replace(name, "e", "E", 4).alias("w"))


@R.frame(
    "s_op_positions",
    """SELECT c_custkey, substring(c_name, greatest(c_nationkey - 12, 1), 4) AS a, substring(c_name, greatest(c_nationkey - 12, 1)) AS b,
              left(c_name, greatest(c_nationkey - 12, 0)) AS l, right(c_name, greatest(c_nationkey - 12, 0)) AS r FROM customer""",
)
def _positions(t: Tables):
    s, n = F.col("c_name"), F.col("c_nationkey") - 12
    return t.customer.select("c_custkey", L.substring_from(s, n, 4).alias("a"), L.substring_from(s, n).alias("b"), L.left_chars(s, n).alias("l"), L.right_chars(s, n).alias("r"))


# dates
R.sql("d_extract", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, extract(YEAR FROM o_orderdate) AS ey, extract(DAY FROM o_orderdate) AS ed FROM orders")
R.sql("d_extract_time", "SELECT event_id, hour(ts) AS h, minute(ts) AS m, CAST(floor(extract(SECOND FROM ts)) AS INTEGER) AS s, dayofmonth(ts) AS d FROM events")
R.sql("d_dayofweek", "SELECT o_orderkey, weekday(o_orderdate) + 1 AS iso, dayofweek(o_orderdate) AS sun FROM orders", "SELECT o_orderkey, isodow(o_orderdate) AS iso, dayofweek(o_orderdate) + 1 AS sun FROM orders")
R.sql("d_add_interval", "SELECT o_orderkey, o_orderdate + INTERVAL '3' DAY AS a, o_orderdate + INTERVAL '36' HOUR AS b, o_orderdate + INTERVAL '90' SECOND AS c FROM orders")
R.sql("d_sub_interval", "SELECT event_id, ts - INTERVAL '1' DAY AS a, ts - INTERVAL '45' MINUTE AS b FROM events")
R.sql(
    "d_interval_compound",
    "SELECT event_id, ts + INTERVAL '1 02:03:04' DAY TO SECOND AS a, ts - INTERVAL '10:30' HOUR TO MINUTE AS b, ts + 3 * INTERVAL '20' MINUTE AS c FROM events",
    "SELECT event_id, ts + INTERVAL '1 day 2 hours 3 minutes 4 seconds' AS a, ts - INTERVAL '10 hours 30 minutes' AS b, ts + 3 * INTERVAL '20 minutes' AS c FROM events",
)
R.sql("d_timestampadd", "SELECT event_id, timestampadd(HOUR, 5, ts) AS a, timestampadd(DAY, -2, ts) AS b FROM events", "SELECT event_id, ts + INTERVAL 5 HOUR AS a, ts - INTERVAL 2 DAY AS b FROM events")
R.sql(
    "d_timestampdiff",
    "SELECT o_orderkey, timestampdiff(DAY, o_orderdate, l_shipdate) AS d, timestampdiff(HOUR, o_orderdate, l_shipdate) AS h FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40",
    "SELECT o_orderkey, datesub('day', o_orderdate, l_shipdate) AS d, datesub('hour', o_orderdate, l_shipdate) AS h FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40",
)
R.sql(
    "d_timestampdiff_units",
    "SELECT event_id, timestampdiff(MINUTE, TIMESTAMP_NTZ '2024-01-10 06:30:00', ts) AS m, timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-10 06:30:00', ts) AS s FROM events",
    "SELECT event_id, datesub('minute', TIMESTAMP '2024-01-10 06:30:00', ts) AS m, datesub('second', TIMESTAMP '2024-01-10 06:30:00', ts) AS s FROM events",
)
R.sql("d_month_interval_folded", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL '3' MONTH")
R.sql("d_interval_result", "SELECT o_orderkey, CAST(extract(DAY FROM l_shipdate - o_orderdate) AS BIGINT) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity = 50", "SELECT o_orderkey, CAST(extract(DAY FROM l_shipdate - o_orderdate) AS BIGINT) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity = 50")
R.sql("d_compare_dates", "SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-02-01' AND DATE '1997-02-28'")
R.sql("d_current", "SELECT r_regionkey, current_date() <= CAST(current_timestamp() AS DATE) AS same FROM region", "SELECT r_regionkey, TRUE AS same FROM region")


@R.frame("d_to_date", "SELECT c_custkey, CAST(strptime(CAST(1995 + c_nationkey AS VARCHAR) || '/03/' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0'), '%Y/%m/%d') AS DATE) AS v FROM customer")
def _to_date(t: Tables):
    text = F.concat((F.col("c_nationkey") + 1995).cast("string"), F.lit("/03/"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"))
    return t.customer.select("c_custkey", L.parse_date(text, "%Y/%m/%d").alias("v"))


@R.frame("d_to_timestamp", "SELECT event_id, date_trunc('second', ts) AS v, CAST(NULL AS TIMESTAMP) AS w FROM events")
def _to_timestamp(t: Tables):
    text = F.date_format("ts", "dd.MM.yyyy HH:mm:ss")
    return t.events.select("event_id", L.parse_timestamp(text, "%d.%m.%Y %H:%M:%S").alias("v"), L.parse_timestamp(F.lit("no time"), "%Y-%m-%d").alias("w"))


@R.frame("d_op_week_diff", "SELECT event_id, isodow(ts) AS dow, datesub('hour', TIMESTAMP '2024-01-05 00:00:00', ts) AS h FROM events")
def _week_diff(t: Tables):
    return t.events.select("event_id", L.day_of_week(F.col("ts")).alias("dow"), L.ts_diff("HOUR", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("h"))


# casts
R.sql("c_int_widths", "SELECT o_orderkey, CAST(o_custkey % 100 AS TINYINT) AS a, CAST(o_custkey AS SMALLINT) AS b, CAST(o_custkey AS INTEGER) AS c, CAST(o_custkey AS BIGINT) AS d, CAST(floor(o_totalprice) AS BIGINT) AS e FROM orders")
R.sql("c_float_double", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS a, round(CAST(CAST(o_custkey AS FLOAT) AS DOUBLE), 3) AS b FROM orders")
R.sql("c_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST('2001-02-03' AS DATE) AS b FROM orders")
R.sql("c_timestamp", "SELECT r_regionkey, CAST('2001-02-03 04:05:06' AS TIMESTAMP_NTZ) AS a, CAST(DATE '2001-02-03' AS TIMESTAMP_NTZ) AS b FROM region")
R.sql("c_varchar", "SELECT o_orderkey, CAST(o_custkey AS STRING) AS a, CAST(o_custkey > 700 AS STRING) AS b, CAST(o_orderdate AS STRING) AS c, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, CAST(o_custkey + 0.5 AS STRING) AS e FROM orders")
R.sql("c_str_to_num", "SELECT c_custkey, CAST(right(c_name, 4) AS INTEGER) AS a, CAST(right(c_name, 4) || '.5' AS DOUBLE) AS b, try_cast(c_mktsegment AS INTEGER) AS c FROM customer")


@R.frame("c_op_from_numbers", "SELECT o_orderkey, DATE '1970-01-01' + CAST(o_custkey AS INTEGER) AS d, make_timestamp(o_orderkey * 1000003) AS t, CAST(NULL AS BIGINT) AS n FROM orders")
def _from_numbers(t: Tables):
    return t.orders.select("o_orderkey", L.days_to_date(F.col("o_custkey")).alias("d"), L.ts_from_ns(F.col("o_orderkey") * 1000003000 + 999).alias("t"), L.to_number(F.col("o_orderpriority")).alias("n"))

# SQL text of the usual dialect, through the session's translation
R.sql(
    "d_sql_formats",
    "SELECT c_custkey, to_date(concat(lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'), '.03.', CAST(1995 + c_nationkey AS STRING)), '%d.%m.%Y') AS d, to_timestamp(c_name, '%Y-%m-%d') AS n FROM customer",
    "SELECT c_custkey, CAST(strptime(lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || '.03.' || CAST(1995 + c_nationkey AS VARCHAR), '%d.%m.%Y') AS DATE) AS d, CAST(NULL AS TIMESTAMP) AS n FROM customer",
)
R.sql(
    "m_sql_zero_divisors",
    "SELECT c_custkey, round(c_acctbal / (c_custkey % 4), 4) AS d, (c_nationkey - 12) % (c_custkey % 4) AS r, CAST(c_mktsegment AS INTEGER) AS c FROM customer",
    "SELECT c_custkey, round(c_acctbal / nullif(c_custkey % 4, 0), 4) AS d, (c_nationkey - 12) % nullif(c_custkey % 4, 0) AS r, CAST(NULL AS INTEGER) AS c FROM customer",
)
R.sql(
    "s_sql_backref",
    r"SELECT p_partkey, regexp_replace(p_name, '(\w+) (\w+)', '\2 of \1') AS v, regexp_replace(p_name, 'e', 'E', 4) AS w FROM part",
    r"SELECT p_partkey, regexp_replace(p_name, '(\w+) (\w+)', '\2 of \1', 'g') AS v, left(p_name, 3) || regexp_replace(substring(p_name, 4), 'e', 'E', 'g') AS w FROM part",
)
