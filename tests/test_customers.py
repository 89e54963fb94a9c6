import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import birth_date, completed_years, decade, key_hash, key_text, whole_days, yes_no
from ledgerlens.operators import clean, cohort, features, rfm, seasons, wholesale
from ledgerlens.sources import artifacts, schemas, tables

TX = "customer_id double, invoice string, stock_code string, description string, quantity double, invoice_ts timestamp, price double"
DAY = dt.datetime(2020, 1, 1)


def line(customer, invoice, days, value=10.0, quantity=1.0, seconds=0, stock="s"):
    return (customer, invoice, stock, "d" + stock, quantity, DAY + dt.timedelta(days=days, seconds=seconds), value)


def test_cleaning_and_audit(spark):
    raw = spark.createDataFrame([
        line(None, "1", 0), line(7.0, "C2", 0), line(7.0, "3", 0, quantity=0.0), line(7.0, "4", 0, value=-1.0),
        line(7.0, None, 0), line(7.0, "5", 0, value=2.0, quantity=3.0)], TX)
    kept = clean.clean_transactions(raw).orderBy("order_value").collect()
    assert [(r["customer_id"], r["invoice"], r["order_value"]) for r in kept] == [("7", "5", 6.0), ("7", None, 10.0)]
    assert [r["removed"] for r in clean.cleaning_audit(raw).orderBy("step").collect()] == [1, 1, 2]


def test_whole_days_floors_both_ways(spark):
    rows = [(DAY, DAY + dt.timedelta(hours=-1)), (DAY, DAY + dt.timedelta(days=2)), (DAY, DAY + dt.timedelta(days=2, seconds=-1)), (DAY, DAY)]
    got = spark.createDataFrame(rows, "a timestamp, b timestamp").select(whole_days("b", "a").alias("d")).collect()
    assert [r["d"] for r in got] == [-1, 2, 1, 0]


def test_birth_dates_and_years(spark):
    rows = [(1980, 2, 30), (1980, None, 3), (2000, 2, 29), (1985, 1, 1)]
    got = spark.createDataFrame(rows, "y int, m int, d int").select(birth_date("y", "m", "d").alias("b")).collect()
    assert [r["b"] for r in got] == [None, None, dt.date(2000, 2, 29), dt.date(1985, 1, 1)]
    pair = spark.createDataFrame([(dt.date(2000, 2, 29), dt.date(2001, 2, 28)), (dt.date(2000, 2, 29), dt.date(2001, 3, 1))], "a date, b date")
    assert [r[0] for r in pair.select(completed_years("a", "b")).collect()] == [0, 1]


def test_small_expressions(spark):
    df = spark.createDataFrame([("Yes", 17850.0, 1999), (" no", 1.0, 2000), ("", None, -1), (None, 2.0, 0)], "f string, k double, y int")
    rows = df.select(yes_no("f").alias("f"), key_text("k").alias("k"), decade("y").alias("y")).collect()
    assert [tuple(r) for r in rows] == [(1, "17850", 1990), (0, "1", 2000), (None, None, -10), (None, "2", 0)]
    h = spark.range(5).select(key_hash("id").alias("h")).collect()
    assert [r["h"] for r in h] == [i * 2654435761 % 2**32 for i in range(5)]


def test_same_day_orders_and_single_orders(spark):
    raw = spark.createDataFrame([
        line(1.0, "a", 0), line(2.0, "b", 0), line(2.0, "c", 0, seconds=60), line(3.0, "d", 0), line(3.0, "e", 5), line(4.0, "z", 100)], TX)
    tx = clean.clean_transactions(raw)
    by = {r["customer_id"]: r for r in cohort.purchase_interval_churn(tx).collect()}
    assert by["1"]["avg_interpurchase"] == 100 and not by["1"]["is_churned"]
    assert by["2"]["avg_interpurchase"] == 0 and by["2"]["is_churned"]
    assert by["3"]["avg_interpurchase"] == 5 and by["3"]["is_churned"]


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_rfm_is_independent_of_partitioning(spark, partitions):
    rows = [line(float(c), f"{c}-{i}", i * c % 50, value=float(c + i)) for c in range(1, 40) for i in range(c % 7 + 1)]
    tx = clean.clean_transactions(spark.createDataFrame(rows, TX).repartition(partitions))
    got = {r["customer_id"]: (r["r_score"], r["f_score"], r["m_score"]) for r in rfm.rfm_score_quintile(rfm.rfm_table(tx)).collect()}
    test_rfm_is_independent_of_partitioning.seen = getattr(test_rfm_is_independent_of_partitioning, "seen", got)
    assert got == test_rfm_is_independent_of_partitioning.seen
    assert sorted({s for scores in got.values() for s in scores}) == [1, 2, 3, 4, 5]


def test_all_equal_recency_scores_five(spark):
    df = spark.createDataFrame([(str(i), 3) for i in range(6)], "customer_id string, recency bigint")
    assert {r["r"] for r in rfm.quintile_score_raw(df, "recency", "r").collect()} == {5}


QUINTILE_RULES = [
    (lambda r, f, m: r <= 2 and f >= 4 and m >= 4, "Cannot Lose Them"), (lambda r, f, m: r >= 4 and f >= 4 and m >= 3, "Champions"),
    (lambda r, f, m: f >= 4 and r >= 3, "Loyal Customers"), (lambda r, f, m: r >= 3 and f == 3, "Potential Loyalists"),
    (lambda r, f, m: r >= 4 and f <= 2, "New Customers"), (lambda r, f, m: r <= 2 and f >= 3, "At Risk"),
    (lambda r, f, m: r <= 2 and f <= 2, "Hibernating"), (lambda r, f, m: True, "Need Attention")]


def test_every_quintile_combination(spark):
    cells = list(itertools.product(range(1, 6), repeat=3))
    got = rfm.segment_quintile(spark.createDataFrame(cells, "r_score int, f_score int, m_score int")).collect()
    for row in got:
        assert row["segment"] == next(n for rule, n in QUINTILE_RULES if rule(*row[:3]))
    assert {tuple(r[:2]) for r in got if r["segment"] == "Need Attention"} == {(3, 1), (3, 2)}


def test_every_tertile_combination_has_a_segment(spark):
    cells = [(r, f, m, r + f + m) for r, f, m in itertools.product(range(1, 4), repeat=3)]
    got = {tuple(x[:3]): x["segment"] for x in rfm.segment_tertile(
        spark.createDataFrame(cells, "r_score int, f_score int, m_score int, rfm_score int")).collect()}
    assert len(got) == 27 and got[(3, 3, 2)] == "Champions" and got[(1, 1, 3)] == "Cannot Lose Them" and got[(1, 1, 1)] == "Hibernating"


def test_wholesale_removes_only_the_extreme(spark):
    rows = [line(float(c), f"{c}", 0, value=10.0 + c % 5) for c in range(50)] + [line(99.0, "x", 0, value=5000.0)]
    kept = wholesale.detect_wholesale(clean.clean_transactions(spark.createDataFrame(rows, TX)))
    assert kept.where("customer_id = '99'").count() == 0 and kept.count() == 50


def test_temporal_split_is_disjoint_and_complete(spark):
    tx = clean.clean_transactions(spark.createDataFrame([line(1.0, str(i), i) for i in range(0, 200, 10)], TX))
    history, future = clean.temporal_split(tx)
    assert history.count() + future.count() == tx.count()
    assert history.agg(F.max("invoice_ts")).first()[0] == DAY + dt.timedelta(days=100)


def test_feature_windows_have_an_inclusive_start(spark):
    tx = clean.clean_transactions(spark.createDataFrame([
        line(1.0, "a", 0), line(1.0, "b", 72), line(1.0, "c", 86, stock="t"), line(1.0, "d", 100)], TX))
    row = features.left_join_features_fill0(tx, F.lit(DAY + dt.timedelta(days=100))).first()
    assert (row["txn_last_28d"], row["txn_last_14d"], row["frequency"], row["recency"], row["n_unique_products"]) == (3, 2, 4, 0, 2)
    idle = features.left_join_features_fill0(tx, F.lit(DAY + dt.timedelta(days=300))).first()
    assert (idle["txn_last_28d"], idle["spend_last_28d"]) == (0, 0.0)


def test_segment_shares_add_up(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 5.0)], "segment string, v double")
    assert sum(r["p"] for r in rfm.share_of_total(df, "v", "p").collect()) == pytest.approx(100, abs=0.2)


def test_top_schools_keep_ties_and_missing_names(spark):
    schools = spark.createDataFrame([(p, s, 1995) for s in range(5) for p in range(3 if s < 4 else 1)], "player_id int, school_id int, year int")
    details = spark.createDataFrame([(0, "Zero")], "school_id int, name string")
    got = seasons.top_schools_per_decade(schools, details, n=1).collect()
    assert sorted(r["school_id"] for r in got) == [0, 1, 2, 3] and {r["name"] for r in got} == {"Zero", None}


def test_shared_birthdays_are_one_row(spark):
    rows = [(i, f"n{i:06d}", 1985, 3, 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "player_id int, name string, birth_year int, birth_month int, birth_day int")
    assert [r["players"] for r in seasons.group_concat(df).collect()] == [", ".join(r[1] for r in rows)]


def test_team_without_known_players(spark):
    salaries = spark.createDataFrame([("T", 1, 2000, 1.0), ("T", 2, 2000, 1.0)], "team_id string, player_id int, year int, salary double")
    players = spark.createDataFrame([(1, "R")], "player_id int, bats string")
    row = seasons.pivot_share(players, salaries).first()
    assert (row["bats_right"], row["bats_left"]) == (50.0, 0.0)


def test_first_year_needs_to_exceed(spark):
    salaries = spark.createDataFrame([("T", 1, y, 50.0) for y in (2000, 2001, 2002)], "team_id string, player_id int, year int, salary double")
    assert seasons.first_year_over_threshold(salaries, 100.0, 1.0).first()["year"] == 2002


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(" 1", "x")], [" Customer ID", "Name "])
    assert tables.normalize_headers(df).columns == ["customer_id", "name"]
    with pytest.raises(ValueError, match="price, quantity"):
        tables.validate_schema(df, [" Customer ID", "price", "quantity"])
    data = spark.createDataFrame([("2020-01-01 10:00:00",), ("nope",), (None,)], "t string")
    assert [r["t"] for r in clean.parse_dates_lenient(data, ["t"]).collect()] == [dt.datetime(2020, 1, 1, 10), None, None]
    numbered = data.withColumn("n", F.lit(1))  # a lone NULL column would be a blank CSV line
    tables.sink_table(numbered, str(tmp_path / "d"), "csv")
    assert tables.scan_csv(spark, str(tmp_path / "d"), numbered.schema).count() == 3
    keys = spark.createDataFrame([(1, None), (1, 2)], "a int, b int")
    assert not tables.key_uniqueness(keys, "a").first()["is_unique"]
    assert tables.missing_audit(keys).collect()[0]["missing_pct"] == 50.0
    assert tables.missing_audit(keys.limit(0)).count() == 0


def test_generated_ids_are_not_cut(spark):
    df = spark.range(12).withColumnRenamed("id", "k")
    ids = [r["customer_id"] for r in clean.id_generator(df, ["k"], start=9995).orderBy("k").collect()]
    assert ids[0] == "CUST-9995" and ids[-1] == "CUST-10006"


def test_append_replaces_returning_customers_and_repeats(spark, tmp_path):
    first = spark.createDataFrame([("1", 1.0), ("2", 2.0)], "customer_id string, v double")
    second = spark.createDataFrame([("2", 9.0), ("3", 3.0)], "customer_id string, v double")
    table = str(tmp_path / "customers")
    artifacts.write_batch(first, table, 0)
    for _ in range(2):  # the same delivery twice
        artifacts.write_batch(second, table, 1)
    got = {r["customer_id"]: r["v"] for r in artifacts.read_customer_table(spark, table).collect()}
    assert got == {"1": 1.0, "2": 9.0, "3": 3.0}
    artifacts.compact_customer_table(spark, table, str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 3
    assert set(schemas.TRANSACTIONS.names) == set(schemas.TRANSACTION_COLUMNS)


def test_cuts_give_the_scores_of_ranks(spark):
    for n in (1, 4, 5, 6, 203):
        df = spark.createDataFrame([(f"c{i:03d}", i % 7, float(i * i % 11), i % 5) for i in range(n)], "customer_id string, frequency long, monetary double, recency long")
        want = sorted(tuple(r) for r in rfm.rfm_score_quintile(df).select("customer_id", "r_score", "f_score", "m_score").collect())
        got = sorted(tuple(r) for r in rfm.score_by_cuts(df, rfm.quintile_cuts(df)).select("customer_id", "r_score", "f_score", "m_score").collect())
        assert got == want


def test_row_without_order_is_kept(spark):
    stored = spark.createDataFrame([("a", 1.0, 1), ("b", 20.0, None)], "customer_id string, total_spend double, batch_ts int")
    scored = spark.createDataFrame([("a", 5.0, 2)], "customer_id string, total_spend double, batch_ts int")
    assert sorted(tuple(r) for r in artifacts.append_scored(stored, scored).collect()) == [("a", 5.0, 2), ("b", 20.0, None)]
