"""Scalar functions over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from viewgrain.catalogue import query, table
from viewgrain.functions import dates as d
from viewgrain.functions import logic, numbers
from viewgrain.functions import strings as s
from viewgrain.functions.parameters import Parameter, arguments
from viewgrain.operators.view import worksheet
from viewgrain.sources import custom_query


@query("""
    SELECT p_partkey, CAST(ascii(p_name) AS INTEGER) AS code, chr(CAST(65 + p_size % 26 AS INTEGER)) AS letter,
      p_brand || '/' || p_type AS joined, contains(p_name, 'ring') AS has_ring, starts_with(p_name, 'red') AS red,
      ends_with(p_brand, '7') AS seven, CAST(instr(p_name, 'e') AS INTEGER) AS first_e,
      CAST(CASE WHEN instr(p_name[3:], 'e') = 0 THEN 0 ELSE instr(p_name[3:], 'e') + 2 END AS INTEGER) AS e_from_3,
      left(p_name, 3) AS l3, right(p_name, 3) AS r3, substr(p_name, 2, 4) AS m24, substr(p_name, 3) AS m3,
      CAST(length(p_name) AS INTEGER) AS len, upper(p_name) AS up, lower(p_type) AS low,
      trim('  ' || p_name || ' ') AS trimmed, ltrim('  ' || p_name) AS lt, rtrim(p_name || '  ') AS rt,
      replace(p_name, 'e', '33') AS replaced, repeat(' ', 3) || p_brand AS spaced,
      split_part(p_name, ' ', 2) AS w2, split_part(p_name, ' ', -1) AS wlast, split_part(p_name, ' ', 5) AS w5,
      greatest(p_brand, p_type) AS later, least(p_brand, p_type) AS earlier
    FROM part
""")
def fn_string(spark, folder):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return table(spark, folder, "part").select(
        "p_partkey",
        F.ascii(name).alias("code"),
        F.char(F.lit(65) + F.col("p_size") % 26).alias("letter"),
        s.join_text(brand, F.lit("/"), kind).alias("joined"),
        name.contains("ring").alias("has_ring"),
        name.startswith("red").alias("red"),
        brand.endswith("7").alias("seven"),
        s.find(name, "e").alias("first_e"),
        s.find(name, "e", 3).alias("e_from_3"),
        F.left(name, F.lit(3)).alias("l3"),
        F.right(name, F.lit(3)).alias("r3"),
        s.mid(name, 2, 4).alias("m24"),
        s.mid(name, 3).alias("m3"),
        F.length(name).alias("len"),
        F.upper(name).alias("up"),
        F.lower(kind).alias("low"),
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.ltrim(F.concat(F.lit("  "), name)).alias("lt"),
        F.rtrim(F.concat(name, F.lit("  "))).alias("rt"),
        F.replace(name, F.lit("e"), F.lit("33")).alias("replaced"),
        F.concat(s.space(3), brand).alias("spaced"),
        s.split_token(name, " ", 2).alias("w2"),
        s.split_token(name, " ", -1).alias("wlast"),
        s.split_token(name, " ", 5).alias("w5"),
        F.greatest(brand, kind).alias("later"),
        F.least(brand, kind).alias("earlier"),
    )


@query("""
    WITH w AS (SELECT doc_id, string_split(text, 'the') AS parts FROM documents)
    SELECT doc_id, CAST(CASE WHEN len(parts) > 2 THEN length(parts[1]) + 3 + length(parts[2]) + 1 ELSE 0 END AS INTEGER) AS second_the,
           CAST(CASE WHEN len(parts) > 1 THEN length(parts[1]) + 1 ELSE 0 END AS INTEGER) AS first_the
    FROM w
""")
def fn_find_nth(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", s.find_nth(text, "the", 2).alias("second_the"), s.find_nth(text, "the", 1).alias("first_the")
    )


@query("""
    SELECT o_orderkey, o_orderdate + INTERVAL 5 DAY AS d5, o_orderdate + INTERVAL 2 MONTH AS m2, o_orderdate - INTERVAL 1 QUARTER AS q_1,
      o_orderdate + INTERVAL 3 YEAR AS y3, o_orderdate + INTERVAL 14 DAY AS w2, o_orderdate + INTERVAL 90 MINUTE AS n90,
      date_diff('year', DATE '1996-06-30', o_orderdate::DATE) AS dy, date_diff('quarter', DATE '1996-06-30', o_orderdate::DATE) AS dq,
      date_diff('month', DATE '1996-06-30', o_orderdate::DATE) AS dm, date_diff('day', DATE '1996-06-24', CAST(date_trunc('week', o_orderdate) AS DATE)) // 7 AS dw,
      date_diff('day', DATE '1996-06-30', o_orderdate::DATE) AS dd, date_diff('hour', TIMESTAMP '1996-06-30 00:00:00', o_orderdate) AS dh,
      monthname(o_orderdate) AS month_name, dayname(o_orderdate) AS day_name, CAST(year(o_orderdate) AS VARCHAR) AS year_name,
      CAST(quarter(o_orderdate) AS VARCHAR) AS quarter_name, CAST(day(o_orderdate) AS VARCHAR) AS dom_name,
      CAST(isoyear(o_orderdate) AS INTEGER) AS iso_year, CAST(weekofyear(o_orderdate) AS INTEGER) AS iso_week,
      CAST(least(4, ceil(weekofyear(o_orderdate) / 13.0)) AS INTEGER) AS iso_quarter,
      CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start
    FROM orders
""")
def fn_date(spark, folder):
    x, base = F.col("o_orderdate"), F.lit(dt.date(1996, 6, 30))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        d.date_add("day", 5, x).alias("d5"),
        d.date_add("month", 2, x).alias("m2"),
        d.date_add("quarter", -1, x).alias("q_1"),
        d.date_add("year", 3, x).alias("y3"),
        d.date_add("week", 2, x).alias("w2"),
        d.date_add("minute", 90, x).alias("n90"),
        d.date_diff("year", base, x).alias("dy"),
        d.date_diff("quarter", base, x).alias("dq"),
        d.date_diff("month", base, x).alias("dm"),
        d.date_diff("week", base, x).alias("dw"),
        d.date_diff("day", base, x).alias("dd"),
        d.date_diff("hour", base, x).alias("dh"),
        d.date_name("month", x).alias("month_name"),
        d.date_name("weekday", x).alias("day_name"),
        d.date_name("year", x).alias("year_name"),
        d.date_name("quarter", x).alias("quarter_name"),
        d.date_name("day", x).alias("dom_name"),
        d.date_part("isoyear", x).alias("iso_year"),
        d.date_part("isoweek", x).alias("iso_week"),
        d.date_part("isoquarter", x).alias("iso_quarter"),
        d.date_trunc("week", x).cast("date").alias("week_start"),
        d.date_trunc("quarter", x).cast("date").alias("quarter_start"),
    )


@query("""
    SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS DATE) AS parsed,
      TRUE AS is_date, FALSE AS not_date, make_date(CAST(year(o_orderdate) AS BIGINT), 2, CAST(1 + o_orderkey % 28 AS BIGINT)) AS made,
      lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':07' AS time_text,
      CAST(o_orderdate AS DATE) + INTERVAL 1 HOUR * CAST(o_orderkey % 24 AS INTEGER) + INTERVAL 1 MINUTE * CAST(o_orderkey % 60 AS INTEGER) + INTERVAL 7 SECOND AS made_at
    FROM orders
""")
def fn_date_make(spark, folder):
    x, key = F.col("o_orderdate"), F.col("o_orderkey")
    text = F.date_format(x, "dd.MM.yyyy")
    time = d.make_time(key % 24, key % 60, F.lit(7))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.to_date(text, "dd.MM.yyyy").alias("parsed"),
        d.is_date(x.cast("date").cast("string")).alias("is_date"),
        d.is_date(text).alias("not_date"),
        F.make_date(F.year(x), F.lit(2), (1 + key % 28).cast("int")).alias("made"),
        time.alias("time_text"),
        d.make_datetime(x, time).cast("timestamp_ntz").alias("made_at"),
    )


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, abs(l_discount - 0.05) AS ab, round(acos(l_discount), 8) AS ac, round(asin(l_discount), 8) AS asn,
      round(atan(l_quantity), 8) AS at, round(atan2(l_quantity, l_tax), 8) AS at2, CAST(ceil(l_extendedprice) AS BIGINT) AS ce,
      CAST(floor(l_extendedprice) AS BIGINT) AS fl, round(cos(l_quantity), 8) AS co, round(cot(l_quantity), 6) AS ct,
      round(degrees(l_tax), 6) AS dg, CAST(l_partkey // l_linenumber AS BIGINT) AS dv, round(exp(l_discount), 8) AS ex,
      round(ln(l_quantity), 8) AS lg, round(log10(l_quantity), 8) AS lg10, round(pow(l_quantity, 2), 4) AS pw,
      round(radians(l_quantity), 8) AS rd, round(l_quantity / 8, 1) AS r1, CAST(sign(l_discount - 0.05) AS DOUBLE) AS sg,
      round(sin(l_quantity), 8) AS sn, round(sqrt(l_quantity), 8) AS sq, l_quantity * l_quantity AS sqr, round(tan(l_quantity), 6) AS tn,
      greatest(l_discount, l_tax) AS mx, least(l_discount, l_tax) AS mn, round(pi(), 10) AS p
    FROM lineitem
""")
def fn_math(spark, folder):
    q, disc, tax, price = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))
    r = lambda c, n=8: F.round(c, n)
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.abs(disc - 0.05).alias("ab"),
        r(F.acos(disc)).alias("ac"),
        r(F.asin(disc)).alias("asn"),
        r(F.atan(q)).alias("at"),
        r(F.atan2(q, tax)).alias("at2"),
        F.ceil(price).alias("ce"),
        F.floor(price).alias("fl"),
        r(F.cos(q)).alias("co"),
        r(F.cot(q), 6).alias("ct"),
        r(F.degrees(tax), 6).alias("dg"),
        F.expr("l_partkey div l_linenumber").alias("dv"),
        r(F.exp(disc)).alias("ex"),
        r(F.ln(q)).alias("lg"),
        r(F.log(10.0, q)).alias("lg10"),
        r(F.pow(q, F.lit(2)), 4).alias("pw"),
        r(F.radians(q)).alias("rd"),
        r(q / 8, 1).alias("r1"),
        F.signum(disc - 0.05).alias("sg"),
        r(F.sin(q)).alias("sn"),
        r(F.sqrt(q)).alias("sq"),
        numbers.square(q).alias("sqr"),
        r(F.tan(q), 6).alias("tn"),
        F.greatest(disc, tax).alias("mx"),
        F.least(disc, tax).alias("mn"),
        r(F.pi(), 10).alias("p"),
    )


@query("""
    SELECT e.event_id, CASE WHEN value > 40 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band,
      CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS code,
      CASE WHEN value > 30 THEN 'yes' ELSE 'no' END AS iif, coalesce(quality, -1) AS filled, quality IS NULL AS missing,
      coalesce(quality, 0) AS zn, event_type IN ('click', 'signup') AS listed,
      (value > 10 AND NOT event_type = 'error') OR value < 1 AS logic,
      CASE WHEN quality = 1 THEN 'good' WHEN quality IS NULL THEN 'unknown' ELSE 'bad' END AS iif3
    FROM events e LEFT JOIN labels l ON e.event_id = l.doc_id
""")
def fn_logic(spark, folder):
    events, labels = table(spark, folder, "events"), table(spark, folder, "labels")
    rows = events.join(labels, events["event_id"] == labels["doc_id"], "left")
    value, kind, quality = F.col("value"), F.col("event_type"), F.col("quality")
    return rows.select(
        "event_id",
        F.when(value > 40, "high").when(value > 20, "mid").otherwise("low").alias("band"),
        F.when(kind == "click", 1).when(kind == "view", 2).otherwise(0).alias("code"),
        logic.iif(value > 30, F.lit("yes"), F.lit("no")).alias("iif"),
        F.coalesce(quality, F.lit(-1)).alias("filled"),
        quality.isNull().alias("missing"),
        logic.zn(quality).alias("zn"),
        kind.isin("click", "signup").alias("listed"),
        (((value > 10) & ~(kind == "error")) | (value < 1)).alias("logic"),
        logic.iif(quality == 1, F.lit("good"), F.lit("bad"), F.lit("unknown")).alias("iif3"),
    )


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_extendedprice) AS BIGINT) AS i, CAST(trunc(-l_extendedprice) AS BIGINT) AS neg_i,
      CAST(l_linenumber AS DOUBLE) AS f, CAST(l_partkey AS VARCHAR) AS s, CAST(NULL AS BIGINT) AS bad,
      CAST(trunc(l_quantity + 0.7) AS BIGINT) AS from_text, CAST(l_shipdate AS DATE) AS d,
      CAST(l_shipdate AS TIMESTAMP) AS t
    FROM lineitem
""")
def fn_cast(spark, folder):
    price = F.col("l_extendedprice")
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".7"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        logic.to_int(price).alias("i"),
        logic.to_int(-price).alias("neg_i"),
        logic.to_float(F.col("l_linenumber")).alias("f"),
        logic.to_text(F.col("l_partkey")).alias("s"),
        logic.to_int(F.col("l_returnflag")).alias("bad"),
        logic.to_int(text).alias("from_text"),
        logic.to_date(F.col("l_shipdate").cast("string")).alias("d"),
        logic.to_datetime(F.col("l_shipdate").cast("string")).cast("timestamp_ntz").alias("t"),
    )


@query("""
    WITH p AS (SELECT l_quantity AS x, l_discount * 100 AS y FROM lineitem),
    c AS (SELECT x, y, floor(x / sqrt(3.0) + 0.5) * sqrt(3.0) AS ax, floor(y / 3.0 + 0.5) * 3.0 AS ay,
                 (floor(x / sqrt(3.0)) + 0.5) * sqrt(3.0) AS bx, (floor(y / 3.0) + 0.5) * 3.0 AS by_ FROM p)
    SELECT round(CASE WHEN near THEN ax ELSE bx END, 6) AS hx, round(CASE WHEN near THEN ay ELSE by_ END, 6) AS hy, count(*) AS n
    FROM (SELECT *, (x - ax) * (x - ax) + (y - ay) * (y - ay) <= (x - bx) * (x - bx) + (y - by_) * (y - by_) AS near FROM c)
    GROUP BY ALL
""")
def hexbin(spark, folder):
    hx, hy = numbers.hexbin(F.col("l_quantity"), F.col("l_discount") * 100)
    return worksheet(
        table(spark, folder, "lineitem"),
        [("hx", F.round(hx, 6)), ("hy", F.round(hy, 6))],
        {"n": F.count(F.lit(1))},
    )


@query("""
    SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice / nullif(l_tax, 0)), 2) AS s, count(l_extendedprice / nullif(l_tax, 0)) AS defined
    FROM lineitem WHERE l_discount >= 0.04 GROUP BY 1
""")
def parameters_and_division(spark, folder):
    low = Parameter("low", 0.02, low=0.0, high=0.1, step=0.01)
    args = arguments([low], {"low": 0.04})
    rows = custom_query(
        spark,
        "SELECT * FROM {lineitem} WHERE l_discount >= :low",
        args,
        lineitem=table(spark, folder, "lineitem"),
    )
    per_tax = logic.safe_div(F.col("l_extendedprice"), F.col("l_tax"))
    return worksheet(
        rows,
        ["l_returnflag"],
        {"n": F.count(F.lit(1)), "s": F.round(F.sum(per_tax), 2), "defined": F.count(per_tax)},
    )
