import datetime as dt

import pytest

from aularank.operators import commits as cm
from aularank.operators import features as fe
from aularank.operators import logs as lg
from aularank.sources import enrolments as en

LOG = "id int, tarea string, timestamp timestamp"
DET = "id string, conversacion_id int, timestamp timestamp"
DAY = [dt.datetime(2024, 1, d, 5) for d in (1, 2, 3)]


def batch(spark, ids):
    return (spark.createDataFrame([(i, "sifods", DAY[i % 3]) for i in ids], LOG),
            spark.createDataFrame([(f"{i}:{k}", i, DAY[i % 3]) for i in ids for k in (1, 2)], DET))


def seen(spark, root):
    log, det = batch(spark, [])
    return (sorted(r.id for r in cm.committed(spark, root, cm.LOG, log.schema).collect()),
            sorted(r.id for r in cm.committed(spark, root, cm.DETAILS, det.schema).collect()))


def test_a_rerun_with_fewer_rows_replaces_the_batch(spark, tmp_path):
    root = str(tmp_path / "store")
    assert seen(spark, root) == ([], [])
    cm.commit_batch(*batch(spark, [1, 2, 3]), root, "b1")
    cm.commit_batch(*batch(spark, [10]), root, "b2")
    cm.commit_batch(*batch(spark, [2]), root, "b1")
    assert seen(spark, root) == ([2, 10], ["10:1", "10:2", "2:1", "2:2"])
    assert {r.batch_id: (r.n_log, r.n_details) for r in cm.manifest(spark, root).collect()} == {"b1": (1, 2), "b2": (1, 2)}
    cm.commit_batch(*batch(spark, []), root, "b1")  # an empty run of a batch empties it
    assert seen(spark, root) == ([10], ["10:1", "10:2"])


def test_a_crash_before_the_manifest_leaves_the_earlier_run(spark, tmp_path):
    root = str(tmp_path / "store")
    cm.commit_batch(*batch(spark, [1, 2]), root, "b1")

    def crash():
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError, match="lost"):
        cm.commit_batch(*batch(spark, [1, 2, 3, 4]), root, "b1", before_manifest=crash)
    cm.write_attempt(batch(spark, [7])[0], root, cm.LOG, "torn")  # stopped between the tables
    assert seen(spark, root) == ([1, 2], ["1:1", "1:2", "2:1", "2:2"])
    left = {r.attempt for r in cm.uncommitted(spark, root, cm.LOG, batch(spark, [])[0].schema).collect()}
    assert "torn" in left and len(left) == 2


def test_append_batch_leaves_no_rows_of_a_longer_run(spark, tmp_path):
    path = str(tmp_path / "log")
    lg.append_batch(batch(spark, [1, 2, 3])[0], path, "b/1")
    lg.append_batch(batch(spark, [9])[0], path, "b2")
    lg.append_batch(batch(spark, [2])[0], path, "b/1")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 9]


ROWS = [("u", "c", None, 1, 1, "n2", 2024), ("u", "c", "second", 1, 1, "n1", 2024), ("u", "c", "a third", 0, 1, "n0", 2023)]
SEVEN = "USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string, CURSO string, APROBACION int, ACTIVO int, NIVELNEXUS string, `AÑO` int"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_first_values_follow_the_files(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    for k, row in enumerate(ROWS):  # file names in source order
        spark.createDataFrame([row], SEVEN).coalesce(1).write.format(fmt).option("header", True).save(f"{path}/{k}")
    raw = en.read_files(spark, path, fmt, recursiveFileLookup="true")
    clean, name = en.load_enrolments(spark, [("files", lambda: raw)])
    assert name == "files" and fe.course_catalog(clean).first().CURSO == "second"
    assert fe.user_profile(clean).first().NIVELNEXUS == "n2"


def test_rows_of_one_file_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.createDataFrame([("u", "c", f"name {i}", 1, 1, "n", 2024) for i in (5, 3, 9, 1)], SEVEN).coalesce(1).write.parquet(path)
    assert fe.course_catalog(en.clean_enrolments(en.read_files(spark, path))).first().CURSO == "name 5"


def test_declared_key_and_contents(spark):
    raw = spark.createDataFrame([(*r, k) for r, k in zip(ROWS, (3, 2, 1))], SEVEN + ", Linea int")
    assert fe.course_catalog(en.clean_enrolments(raw, order_by=["linea"])).first().CURSO == "a third"
    assert fe.user_profile(en.clean_enrolments(raw, order_by=["linea"])).first().NIVELNEXUS == "n0"
    shuffled = raw.drop("Linea").repartition(3)  # no key: whatever the order of reading, the contents decide
    assert len({fe.course_catalog(en.clean_enrolments(df)).first().CURSO for df in (shuffled, shuffled.orderBy("CURSO"))}) == 1
