"""Components: the results of odd graphs, and the tasks that a run on few edges takes."""

import random

from lectern.llm.components import components

from .test_duplicates import roots


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def tasks_of(spark, group, run):
    """(result of ``run``, number of tasks that it took)."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {k for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)


def test_components_of_odd_graphs(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(300, 340)]
    hub = [(900, 600 + i) for i in range(80)] + [(900, 950 + i) for i in range(80)]
    loose = [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(120)]
    pairs = [*chain, *hub, *loose, (7, 7), (5, 6), (6, 5), (5, 6), (-3, 5)]
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    known = {frozenset(p) for p in pairs}
    expected = roots(nodes, lambda a, b: frozenset((a, b)) in known)
    got = [(x["node"], x["root"]) for x in components(edges_of(spark, pairs)).collect()]
    assert len(got) == len(nodes) and dict(got) == expected
    assert components(edges_of(spark, [])).count() == 0 and components(edges_of(spark, [(7, 7)])).count() == 0


def test_few_edges_take_few_tasks(spark):
    """A run on few edges costs its tasks: their files, and their lines in the event log (531 here before, now 321)."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        pairs = [(i % 7, 100 + i) for i in range(300)] + [(200, 500), (3, 4)]
        rows, tasks = tasks_of(spark, "components", lambda: components(edges_of(spark, pairs)).collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(rows) == 308 and len({x["root"] for x in rows}) == 6
    assert 0 < tasks < 430
