import numpy as np
from pyspark.sql import functions as F

from timbrel.plans import models

LABELS = ["oom", "disk_full"]


def _local():
    """Functions that travel to the workers by value."""

    def words():
        return lambda texts: np.array([[3.0 * t.count("memory"), 3.0 * t.count("disk")] for t in texts])

    def broken():
        raise OSError("no weights")

    def vectors():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], float)

    return words, broken, vectors


words, broken, vectors = _local()


def test_the_mean_of_distributions_decides(spark):
    rows = [("a", ["memory", "memory", "disk"]), ("b", ["memory", "disk"]), ("c", []), ("d", None)]
    frame = spark.createDataFrame(rows, "log_path string, chosen array<string>")
    got = {r["log_path"]: r["x"] for r in frame.withColumn("x", models.classifier(words, LABELS, 0.6)(F.col("chosen"))).collect()}
    high = 1 / (1 + np.exp(-3))
    assert got["a"]["category"] == "oom" and abs(got["a"]["confidence"] - (2 * high + 1 - high) / 3) < 1e-9
    assert {tuple(got[k]) for k in "bcd"} == {("unknown", 0.0)}
    lost = frame.withColumn("x", models.classifier(broken, LABELS)(F.col("chosen"))).collect()
    assert {tuple(r["x"]) for r in lost} == {("unknown", 0.0)}


def test_messages_follow_leaders(spark):
    frame = spark.createDataFrame([(["aaa", "aa", "xx", "xxxx"],)], "chosen array<string>")
    assert frame.select(models.grouper(vectors)(F.col("chosen")).alias("g")).first()["g"] == [0, 0, 2, 2]
    assert frame.select(models.grouper(broken)(F.col("chosen")).alias("g")).first()["g"] == [0, 1, 2, 3]


def test_a_model_decides_a_summary(spark):
    from test_detectors import event, frame

    from timbrel.operators import correlation, detectors
    from timbrel.plans import summary

    rows = [event(i / 60, "error", f"no space on disk {i}", line=i) for i in range(30)]
    signals = correlation.correlate(correlation.merge(detectors.detect(frame(spark, rows))), 120_000_000)
    out = summary.summarize(spark.createDataFrame([("a",)], "log_path string"), signals, models.classifier(words, LABELS)).first()
    assert (out["category"], out["title"]) == ("disk_full", "Disk Full") and out["confidence"] > 0.9


def test_evidence_as_its_sql_finds_it(spark, tmp_path):
    import duckdb

    from timbrel import queries
    from timbrel.constants import EVIDENCE

    texts = ["éssh", "sshé", "an sshd.", "a_ssh", "ssh2", "SSH-1", "ſſh", "aſſh", "DISK", "disK", "Kisk", "ſignal", "ıinvalid", "ınvalid", "śsh", "ssh́", "ssh‍", "日ssh本", "٣ssh", "", None]
    texts += [g + w + h for words in EVIDENCE.values() for w in words for g, h in (("é", ""), ("", "ß"), ("x", ""), ("", "7"), ("ſ", "K"))]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, queries.QUERIES["category_evidence"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert got == sorted(db.sql(queries.ORACLE_SQL["category_evidence"]).fetchall())
