"""Queries of scalar expressions: text, codes, clocks, angles, headways."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from .registry import Tables, portable, query

_D_NORM = "trim(regexp_replace(upper(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')), '[^A-Z0-9]+', ' ', 'g'))"


@query("r036_accent_fold", (36, 37), f"SELECT doc_id, {_D_NORM.format('text')} AS norm, regexp_replace(lower({_D_NORM.format('text')}), ' ', '', 'g') AS name_key FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", X.norm(F.col("text")).alias("norm"), X.name_key(F.col("text")).alias("name_key"))


_STOP = ["the", "and", "les", "des", "der", "die", "los", "las"]
_TOKENS = f"list_sort(list_distinct(list_filter(string_split(lower({_D_NORM.format('text')}), ' '), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(repr(w) for w in _STOP)}))))"


@query("r038_token_set", (38,), f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS tokens FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.array_join(X.tokens(F.col("text"), _STOP), " ").alias("tokens"))


@query("r039_overlap_match", (39,), f"""
    WITH k AS (SELECT item_id AS id, {_TOKENS} AS s FROM benchmark)
    SELECT a.id AS a, b.id AS b, len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s)) >= 0.5 * least(len(a.s), len(b.s)) AS matched
    FROM k a JOIN k b ON b.id = a.id + 1""")
def _(t: Tables):
    k = t.benchmark.select(F.col("item_id").alias("id"), X.tokens(F.col("text"), _STOP).alias("s"))
    nxt = k.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("s").alias("s2"))
    return k.join(nxt, "id").select(F.col("id").alias("a"), "b", X.names_match(F.col("s"), F.col("s2")).alias("matched"))


_RULES = [(1, "ring|gear", "part"), (2, "widget", "assembly"), (3, "bolt|nut", "fastener"), (4, "red|blue", "coloured")]
_CASE = "CASE " + " ".join(f"WHEN regexp_matches(p_name, '{p}') THEN '{c}'" for _, p, c in _RULES) + " ELSE 'unclassifiable' END"


@query("r040_rule_classifier", (40, 41), f"SELECT p_partkey, {_CASE} AS first_match, {_CASE} AS overlaid FROM part")
def _(t: Tables):
    #: distinct texts are classified once and joined back
    names = t.part.select("p_name").distinct().select("p_name", X.classify(F.col("p_name"), _RULES).alias("first_match"), X.overlay(F.col("p_name"), _RULES).alias("overlaid"))
    return t.part.join(names, "p_name").select("p_partkey", "first_match", "overlaid")


_CROSS = {"ECONOMY/red": "a", "ECONOMY": "b", "PROMO": "c", "SMALL/blue": "d"}


@query("r042_hierarchy_lookup", (42,), """
    SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND split_part(p_name, ' ', 1) = 'red' THEN 'a' WHEN p_type = 'ECONOMY' THEN 'b'
        WHEN p_type = 'PROMO' THEN 'c' WHEN p_type = 'SMALL' AND split_part(p_name, ' ', 1) = 'blue' THEN 'd' ELSE 'unclassifiable' END AS class
    FROM part""")
def _(t: Tables):
    return t.part.select("p_partkey", X.hierarchy_class(F.array("p_type", F.split_part("p_name", F.lit(" "), F.lit(1))), _CROSS).alias("class"))


@query("r043_longest_prefix", (43,), """
    WITH x(prefix, class) AS (VALUES ('Brand#1', 'one'), ('Brand#2', 'two'), ('Brand#12', 'twelve'), ('Brand#25', 'last'))
    SELECT p_partkey, p_brand, (SELECT arg_max(class, length(prefix)) FROM x WHERE starts_with(p_brand, prefix)) AS class FROM part""")
def _(t: Tables):
    x = t.spark.sql("SELECT * FROM VALUES ('Brand#1', 'one'), ('Brand#2', 'two'), ('Brand#12', 'twelve'), ('Brand#25', 'last') AS x(prefix, class)")
    return X.longest_prefix(t.part.select("p_partkey", "p_brand"), "p_brand", x).select("p_partkey", "p_brand", "class")


portable("r044_code_crosswalk", (44, 45), """
    SELECT c, CASE WHEN c = '1360' THEN 'exception' WHEN c LIKE '13%' THEN 'thirteen' WHEN c LIKE '1%' THEN 'one' WHEN c LIKE '2%' THEN 'two' ELSE 'other' END AS class, n
    FROM (SELECT CAST(o_orderkey % 3000 AS VARCHAR(10)) AS c, count(*) AS n FROM {orders} GROUP BY CAST(o_orderkey % 3000 AS VARCHAR(10))) AS k""")


@query("r045_label_or_fail", (45,), "SELECT r_regionkey, CASE r_name WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'AM' WHEN 'ASIA' THEN 'AS' WHEN 'EUROPE' THEN 'EU' ELSE 'ME' END AS label FROM region")
def _(t: Tables):
    return t.region.select("r_regionkey", X.label_or_fail(F.col("r_name"), {"AFRICA": "AF", "AMERICA": "AM", "ASIA": "AS", "EUROPE": "EU", "MIDDLE EAST": "ME"}).alias("label"))


_CLOCKS = "concat(lpad(CAST(event_id % 30 AS VARCHAR(9)), 2, '0'), ':', lpad(CAST(event_id % 70 AS VARCHAR(9)), 2, '0'), ':', lpad(CAST(event_id % 60 AS VARCHAR(9)), 2, '0'))"


@query("r046_clock_seconds", (46, 47, 48), f"""
    SELECT event_id, CASE WHEN regexp_full_match(x, '[0-9]+:[0-5][0-9]:[0-5][0-9]') THEN
        try_cast(split_part(x, ':', 1) AS BIGINT) * 3600 + try_cast(split_part(x, ':', 2) AS BIGINT) * 60 + try_cast(split_part(x, ':', 3) AS BIGINT) END AS sec
    FROM (SELECT event_id, {_CLOCKS} AS x FROM events)""")
def _(t: Tables):
    return t.events.select("event_id", F.expr(_CLOCKS).alias("x")).select("event_id", N.clock_seconds(F.col("x"), strict=False).alias("sec"))


@query("r049_digits_key", (49, 50, 51), """
    SELECT c_custkey, lpad(regexp_replace(c_name, '[^0-9]', '', 'g'), 8, '0') AS key8,
        concat(lpad(CAST(c_nationkey AS VARCHAR), 3, '0'), lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS sql_key, regexp_full_match(c_name, 'Customer#[0-9]{9}') AS well_formed
    FROM customer""")
def _(t: Tables):
    n = F.col("c_nationkey").cast("string")
    return t.customer.select(
        "c_custkey",
        X.digits_key(F.col("c_name")).alias("key8"),
        F.concat(F.lpad(n, 3, "0"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("sql_key"),
        F.col("c_name").rlike("^Customer#[0-9]{9}$").alias("well_formed"),
    )


@query("r052_decimal_comma", (52,), "SELECT c_custkey, coalesce(try_cast(CASE WHEN c_custkey % 7 = 0 THEN 'n/d' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE), 0) AS v FROM customer")
def _(t: Tables):
    text = F.when(F.col("c_custkey") % 7 == 0, "n/d").otherwise(F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")))
    return t.customer.select("c_custkey", X.decimal_comma(text).alias("v"))


@query("r053_nested_access", (53, 54), "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, list_min(embedding) AS lo, list_max(embedding) AS hi FROM embeddings")
def _(t: Tables):
    e = F.col("embedding")
    boxed = t.embeddings.select("vec_id", F.array(F.struct(e[0].cast("double").alias("first"))).alias("sources"), F.struct(F.array_min(e).alias("lo"), F.array_max(e).alias("hi")).alias("bbox"))
    return boxed.select("vec_id", F.try_element_at("sources", F.lit(1))["first"].alias("first"), "bbox.*")


@query("r055_json_tags", (55, 278), """
    SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, bool_or(json_exists(props, '$.k')) AS has_k
    FROM events GROUP BY event_type HAVING count(*) > 5""")
def _(t: Tables):
    tags = F.from_json("props", "map<string,string>")
    e = t.events.select("event_type", tags.alias("tags"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("tags")["k"].cast("long")).alias("k"), F.bool_or(F.map_contains_key("tags", "k")).alias("has_k")).where("n > 5")


@query("r056_rule_predicate", (56,), "SELECT o_orderkey, bool_or(l_returnflag = 'R' AND l_linestatus = 'F' AND l_tax = 0) AS any_rule FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(t: Tables):
    rules = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_linestatus", "l_tax")).alias("rules"))
    hit = F.exists("rules", lambda r: (r["l_returnflag"] == "R") & (r["l_linestatus"] == "F") & (r["l_tax"] == 0))
    return t.orders.join(rules, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", hit.alias("any_rule"))


@query("r057_guarded_log", (57, 58), """
    WITH x AS (SELECT o_orderkey, ln(o_totalprice) AS l, ln(1 + o_totalprice) AS l1 FROM orders), s AS (SELECT avg(l) AS m, stddev_pop(l) AS sd FROM x)
    SELECT o_orderkey, round(l, 6) AS l, round(l1, 6) AS l1, round(greatest(least((l - m) / sd, 3), -3), 5) AS z FROM x, s""")
def _(t: Tables):
    p = F.col("o_totalprice")
    x = t.orders.select("o_orderkey", N.guarded(p, "log").alias("l"), N.guarded(p, "log1p").alias("l1"))
    s = x.agg(F.avg("l").alias("m"), F.stddev_pop("l").alias("sd"))  # one row
    return x.join(F.broadcast(s)).select("o_orderkey", F.round("l", 6).alias("l"), F.round("l1", 6).alias("l1"), F.round(N.clip((F.col("l") - F.col("m")) / F.col("sd")), 5).alias("z"))


_LL = "CAST(event_id % 170 - 85 AS DOUBLE) AS lat0, CAST(user_id * 2 - 150 AS DOUBLE) AS lon0, value / 10 AS lat1, value / 5 AS lon1"


@query("r059_angles", (59, 60), f"""
    WITH e AS (SELECT event_id, {_LL} FROM events),
    b AS (SELECT *, degrees(atan2(sin(radians(lon1 - lon0)) * cos(radians(lat1)), cos(radians(lat0)) * sin(radians(lat1)) - sin(radians(lat0)) * cos(radians(lat1)) * cos(radians(lon1 - lon0)))) AS d FROM e)
    SELECT event_id, round(((d % 360) + 360) % 360, 5) AS bearing, round((((d - lon0 + 180) % 360) + 360) % 360 - 180, 5) AS off FROM b""")
def _(t: Tables):
    e = t.events.selectExpr("event_id", *[x.strip() for x in _LL.split(", ")])
    b = e.withColumn("b", N.bearing(*map(F.col, ("lat0", "lon0", "lat1", "lon1"))))
    return b.select("event_id", F.round("b", 5).alias("bearing"), F.round(N.angle_difference(F.col("b"), F.col("lon0")), 5).alias("off"))


@query("r061_street_frame", (61,), """
    SELECT event_id, round((value - 3) * sin(radians(30)) + (user_id - 4) * cos(radians(30)), 6) AS u, round((value - 3) * cos(radians(30)) - (user_id - 4) * sin(radians(30)), 6) AS v,
        round(value, 6) AS x, round(CAST(user_id AS DOUBLE), 6) AS y FROM events""")
def _(t: Tables):
    f = N.Frame(3, 4, 30)
    u, v = f.to_uv(F.col("value"), F.col("user_id"))
    x, y = f.to_xy(F.col("u"), F.col("v"))
    return t.events.withColumns({"u": u, "v": v}).select("event_id", *[F.round(c, 6).alias(n) for c, n in ((F.col("u"), "u"), (F.col("v"), "v"), (x, "x"), (y, "y"))])


@query("r062_edf", (62, 142), """
    WITH e AS (SELECT user_id, 30 / (value / 80 + 30.0 / (1 + event_id % 12) + CASE WHEN event_type IN ('view', 'click') THEN 2.0 ELSE 0.75 END) AS f FROM events)
    SELECT user_id, round(max(f) + 0.5 * (sum(f) - max(f)), 6) AS ai FROM e GROUP BY user_id""")
def _(t: Tables):
    from ..operators.transit import access_of_mode

    mode = F.when(F.col("event_type").isin("view", "click"), "bus").otherwise("rail")
    e = t.events.select("user_id", N.edf(F.col("value"), 1 + F.col("event_id") % 12, mode).alias("f"))
    return e.groupBy("user_id").agg(F.round(access_of_mode(F.col("f")), 6).alias("ai"))


@query("r063_ordered_select", (63, 64), """
    SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 200000 THEN 'mid' ELSE 'low' END AS class,
        CAST((o_totalprice > 100000)::INT + (o_totalprice > 200000)::INT + (o_totalprice > 300000)::INT AS INTEGER) AS band FROM orders""")
def _(t: Tables):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p > 400000, "high").when(p > 200000, "mid").otherwise("low").alias("class"), N.banded(p, [100000, 200000, 300000]).alias("band"))


@query("r065_range_compatible", (65,), """
    SELECT event_id, (user_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 OR user_id % 3 = 0)
        OR (least(user_id % 5, event_id % 7) <= greatest(event_id % 11, user_id % 3) AND least(event_id % 11, user_id % 3) <= greatest(user_id % 5, event_id % 7)) AS ok FROM events""")
def _(t: Tables):
    u, e = F.col("user_id"), F.col("event_id")
    return t.events.select("event_id", N.ranges_compatible(u % 5, e % 7, e % 11, u % 3).alias("ok"))


@query("r248_headways", (248, 249), """
    WITH h AS (SELECT event_id, 3600 * (event_id % 5) AS s, 3600 * (event_id % 5) + 1800 * (1 + user_id % 6) AS e, 120 + 60 * (event_id % 9) AS h, 30 * (user_id % 7) AS o FROM events)
    SELECT event_id, round(greatest(least(e + o, 10800) - greatest(s + o, 7200), 0) / h, 6) AS expected,
        CAST((SELECT count(*) FROM range(0, 200) AS r(k) WHERE s + k * h < e AND s + k * h + o >= 7200 AND s + k * h + o < 10800) AS BIGINT) AS exact FROM h""")
def _(t: Tables):
    e, u = F.col("event_id"), F.col("user_id")
    h = t.events.select("event_id", (3600 * (e % 5)).alias("s"), (3600 * (e % 5) + 1800 * (1 + u % 6)).alias("e"), (120 + 60 * (e % 9)).alias("h"), (30 * (u % 7)).alias("o"))
    args = [F.col(c) for c in "seho"] + [F.lit(7200), F.lit(10800)]
    return h.select("event_id", F.round(N.expected_departures(*args), 6).alias("expected"), N.exact_departures(*args).alias("exact"))


@query("r259_clock_alignment", (259,), "SELECT event_id, round(epoch_us(ts - TIMESTAMP '2024-01-01') / 1e6 + 0.5 + 0.001 * (epoch_us(ts - TIMESTAMP '2024-01-01') / 1e6), 4) AS t FROM events".replace("epoch_us(ts - TIMESTAMP '2024-01-01')", "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))"))
def _(t: Tables):
    s = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    return t.events.select("event_id", F.round(N.sensor_clock(s, 0.5, 0.001), 4).alias("t"))


@query("r024_quadkey_tiles", (24,), """
    WITH k AS (SELECT n_nationkey, concat(n_nationkey % 4, n_nationkey // 4 % 4, n_nationkey // 16 % 4, '021302') AS quadkey FROM nation),
    t AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: CAST(quadkey[i] AS INT) % 2 * (1 << (9 - CAST(i AS INT))))) AS x, list_sum(list_transform(range(1, 10), lambda i: CAST(quadkey[i] AS INT) // 2 * (1 << (9 - CAST(i AS INT))))) AS y FROM k)
    SELECT n_nationkey, quadkey, round(x / 512 * 360 - 180, 9) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 512)))), 9) AS south, round((x + 1) / 512 * 360 - 180, 9) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / 512)))), 9) AS north FROM t""")
def _(t: Tables):
    key = F.concat(*[(F.floor(F.col("n_nationkey") / 4**i) % 4).cast("string") for i in range(3)], F.lit("021302"))
    return t.nation.select("n_nationkey", key.alias("quadkey"), N.quadkey_bounds(key).alias("b")).select("n_nationkey", "quadkey", *[F.round(f"b.{c}", 9).alias(c) for c in ("west", "south", "east", "north")])


@query("r276_source_credit", (276, 277), """
    WITH s AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type || '+' || p_brand ELSE p_brand END AS credit FROM part),
    d AS (SELECT unnest(list_sort(list_distinct(string_split(credit, '+')))) AS dataset FROM s)
    SELECT dataset, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM d GROUP BY dataset""")
def _(t: Tables):
    own = F.struct(F.lit("name").alias("property"), F.col("p_type").alias("dataset"))
    also = F.struct(F.lit("name").alias("property"), F.col("p_brand").alias("dataset"))
    whole = F.struct(F.lit("").alias("property"), F.col("p_brand").alias("dataset"))
    s = t.part.select(F.when(F.col("p_size") % 3 == 0, F.array(own, also, whole)).otherwise(F.array(whole)).alias("sources"))
    credit = s.select(X.datasets(F.col("sources"), "name").alias("credit"))
    total = credit.agg(F.count("*").alias("total"))  # one row
    d = credit.select(F.explode(F.split("credit", r"\+")).alias("dataset")).groupBy("dataset").agg(F.count("*").alias("n"))
    return d.join(F.broadcast(total)).select("dataset", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
