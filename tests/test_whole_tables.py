"""Queries without SQL that run on all rows of their tables."""

import datetime

from metrolith.plans import catalogue


def test_schedule_and_smoother_take_all_groups(spark, tmp_path):
    orders = [(k, 10 + 45 * (k % 3), 300_000.0) for k in range(30)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.piece: (r.plan, r.session, r.day) for r in catalogue.QUERIES["r242_schedule"](spark, str(tmp_path)).collect()}
    #: 1,500 seconds each: two fit a session of 3,600, four a day of 7,200
    assert got == {k: (c, k // 3 // 2 + 1, k // 3 // 4 + 1) for k, c, _ in orders}
    at = datetime.datetime(2024, 1, 1)
    events = [(k, k % 50, at + datetime.timedelta(seconds=60 * k), 5.0, "view") for k in range(200)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, value double, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    rows = catalogue.QUERIES["r260_rts_smoother"](spark, str(tmp_path)).collect()
    assert len(rows) == 200 and {r.session for r in rows} == set(range(50))
    assert all(abs(r.u - 5) < 1e-6 for r in rows)


def test_tours_of_all_orders(spark, tmp_path):
    rows = [(k, i + 1, (7 * k + 3 * i * i) % 5 + 1, 1.0 + (k + i) % 4) for k in range(1, 61) for i in range(k % 7 + 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {}
    for r in catalogue.QUERIES["r240_tour"](spark, str(tmp_path)).orderBy("plan", "step").collect():
        got.setdefault(r.plan, ([], r.total))[0].append(r.node)
    assert set(got) == set(range(1, 61))
    for k, (walk, total) in got.items():
        stops = [(s, w) for o, _, s, w in rows if o == k]
        nodes = [0, *(s for s, _ in stops)]
        assert walk[0] == walk[-1] and {frozenset(p) for p in zip(nodes, nodes[1:])} <= {frozenset(p) for p in zip(walk, walk[1:])}
        #: back by the return stretch, the same way, or by a mix with shorter links
        there = sum(w for _, w in stops)
        assert there <= total <= min(there + stops[-1][1], 2 * there) + 1e-9


def test_no_claims_without_code():
    claimed = {r for rows in catalogue.ROWS.values() for r in rows}
    assert not claimed & {17, 131, 208, 211, 214, 224, 227, 241, 243, 263, 264}
