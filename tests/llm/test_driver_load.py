"""The driver keeps track of every task: loops over small tables must not take
all shuffle partitions in every step (coalescing is off here, as on a full cluster)."""

import pytest

from interlinear.llm import common, cotraining, surrogates

PARTS = 40


@pytest.fixture
def tasks(spark):
    """Tasks that the given action takes."""
    conf = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    sc = spark.sparkContext

    def count(group, action):
        sc.setJobGroup(group, group)
        out = action()
        sc.setLocalProperty("spark.jobGroup.id", None)
        status = sc.statusTracker()
        stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
        return out, sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)

    yield count
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components(spark, tasks):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(50, 3), (60, 61), (60, 60)], "a long, b long")
    rows, n = tasks("components", lambda: common.connected_components(edges).collect())
    expected = {i: i // 10 * 10 for i in range(40)} | {50: 0, 60: 60, 61: 60}
    assert {r.id: r.component for r in rows} == expected and len(rows) == len(expected)
    assert n < 2000


def test_surrogates(spark, tasks):
    entities = spark.createDataFrame([("email", f"ann{i}@mail.example.com") for i in range(30)], "type string, canonical string")
    rows, n = tasks("surrogates", lambda: surrogates.assign(entities, "key").collect())
    assert len({r.surrogate for r in rows}) == len({r.canonical for r in rows}) == 30
    assert n < 300


def test_quality(spark, tasks):
    rows = [(i, ("good plain words here " if i % 2 else "BUY BUY now!!! ") * (1 + i % 7), "s", "en", 9) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got, n = tasks("quality", lambda: cotraining.score(docs, labels).collect())
    assert all((r.quality_score >= 0.5) == bool(r.doc_id % 2) for r in got) and len(got) == 120
    assert n < 450
