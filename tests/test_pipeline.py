"""Training, batch scoring and the stream over the same transactions."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from checks import bindings as b
from checks import queries_models
from checks.catalog import ENTRIES
from ledgerlens import session
from ledgerlens.operators import clean, rfm
from ledgerlens.plans import scoring, training
from ledgerlens.sources import artifacts, schemas
from ledgerlens.streaming.score_stream import stream_score_append


@pytest.fixture(scope="module")
def trained(spark, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("models"))
    early = b.transactions(spark, small).where(F.year("invoice_ts") < 2001)
    training.train_customer_models(early, folder, trees=3, n_init=1)
    return training.load_models(spark, folder)


def test_training_stores_everything(spark, trained):
    table = artifacts.read_customer_table(spark, trained.customer_table)
    assert set(schemas.CUSTOMER_TABLE.names) < set(table.columns)
    assert table.count() == table.select("customer_id").distinct().count() > 100
    assert table.where("pred_clv_90d < 0 OR prob_alive NOT BETWEEN 0 AND 1 OR segment IS NULL OR km_label IS NULL").count() == 0
    for part in ("metrics", "top_products", "metadata"):
        assert spark.read.parquet(f"{trained.folder}/{part}").count() > 0


def test_scoring_requires_all_columns(spark, small, trained):
    with pytest.raises(ValueError, match="stock_code"):
        scoring.score_new_batch(b.transactions(spark, small).drop("stock_code"), trained)


def test_stream_equals_batches_and_survives_a_restart(spark, small, trained, tmp_path):
    late = b.transactions(spark, small).where(F.year("invoice_ts") >= 2001)
    direct, models = copied(spark, trained, tmp_path / "direct"), copied(spark, trained, tmp_path / "streamed")
    arrivals = str(tmp_path / "arrivals")
    parts = [late.where("month(invoice_ts) <= 3"), late.where("month(invoice_ts) > 3")]
    for number, part in enumerate(parts, start=1):
        assert scoring.score_and_append(part, direct, "by hand", number) == number
        part.write.mode("append").parquet(arrivals)
        for _ in range(2):  # the second start finds nothing new
            stream_score_append(spark, arrivals, models, str(tmp_path / "progress")).awaitTermination()
    shown = ["customer_id", "batch_id", "segment", "frequency", "n_orders", "recency", "rfm_score"]
    want = sorted(tuple(r) for r in artifacts.read_customer_table(spark, direct.customer_table).select(*shown).collect())
    got = sorted(tuple(r) for r in artifacts.read_customer_table(spark, models.customer_table).select(*shown).collect())
    assert got == want and {r[1] for r in got} == {0, 1, 2}
    assert scoring.score_and_append(parts[1], direct, "by hand", 2) == 2  # the same delivery again
    again = sorted(tuple(r) for r in artifacts.read_customer_table(spark, direct.customer_table).select(*shown).collect())
    assert again == want
    # a lost checkpoint reads all files again under new numbers
    stream_score_append(spark, arrivals, models, str(tmp_path / "new progress")).awaitTermination()
    assert {r["batch_id"] for r in spark.read.parquet(models.transactions).select("batch_id").distinct().collect()} == {0, 1, 2, 3}


def test_a_quarter_arrives_as_one_file(spark, small, trained, monkeypatch):
    files = []

    def watched(spark, source, *args, **settings):
        files.extend(spark.read.parquet(source).inputFiles())
        return stream_score_append(spark, source, *args, **settings)

    monkeypatch.setattr(queries_models, "_trained", lambda *_: trained)
    monkeypatch.setattr(queries_models, "stream_score_append", watched)
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as with large tables
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        assert ENTRIES["stream_score_append"].run(spark, small).count() > 100
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) <= 4


def copied(spark, trained, folder):
    models = trained.at(str(folder))
    for part in ("customers", "transactions"):
        artifacts.write_batch(spark.read.parquet(f"{trained.folder}/{part}/batch_id=0"), f"{folder}/{part}", 0)
    spark.read.parquet(trained.cuts).write.parquet(models.cuts)
    return models


def test_history_is_kept_whatever_the_grouping(spark, small, trained, tmp_path):
    raw = b.transactions(spark, small)
    late = raw.where(F.year("invoice_ts") >= 2001)
    whole = {r["customer_id"]: r for r in rfm.rfm_table(clean.clean_transactions(raw)).collect()}
    before = {r["customer_id"]: r for r in artifacts.read_customer_table(spark, trained.customer_table).collect()}
    for name, parts in {"one": [late], "two": [late.where("month(invoice_ts) > 4"), late.where("month(invoice_ts) <= 4")]}.items():
        models = copied(spark, trained, tmp_path / name)
        for k, part in enumerate(parts):
            scoring.score_and_append(part, models, "run", k)
        after = {r["customer_id"]: r for r in artifacts.read_customer_table(spark, models.customer_table).collect()}
        assert set(before) <= set(after)
        touched = {r["customer_id"] for r in clean.clean_transactions(late).select("customer_id").distinct().collect()}
        for c in touched:
            assert after[c]["n_orders"] == whole[c]["n_orders"] and after[c]["total_spend"] == pytest.approx(whole[c]["total_spend"])
        assert all(after[c]["n_orders"] >= r["n_orders"] and after[c]["km_label"] == r["km_label"] for c, r in before.items())
        assert all(after[c]["prob_alive"] is not None for c in touched & set(before) if before[c]["prob_alive"] is not None)


def test_stages_go_with_their_block(spark):
    with session.stages(spark):
        table = session.materialize(spark.range(3))
        path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
        assert os.path.isdir(path) and table.count() == 3
    assert not os.path.exists(path)


def test_kernels_run_outside_the_repository(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from ledgerlens.session import build_session
from ledgerlens.operators import density
spark = build_session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, a double")
print("rows", density.kth_neighbor_distance(df, ["a"], "id", 2).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 10" in done.stdout, done.stderr[-2000:]
