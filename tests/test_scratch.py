"""Written tables leave no heap of garbage on the driver."""

from doclake.sources import scratch


def collections(spark) -> int:
    """Whole collections of the driver's heap so far."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_a_grown_heap_is_collected_after_a_write(spark, monkeypatch):
    monkeypatch.setattr(scratch, "FULL", 0.0, raising=False)
    before = collections(spark)
    assert scratch.stored(spark.range(3).withColumnRenamed("id", "doc_id")).count() == 3
    assert collections(spark) > before


def test_a_small_heap_is_left_alone(spark, monkeypatch):
    monkeypatch.setattr(scratch, "FULL", 2.0)
    before = collections(spark)
    scratch.stored(spark.range(3).withColumnRenamed("id", "doc_id"))
    assert collections(spark) == before


def test_documents_of_one_task_are_read_by_several(spark):
    held = scratch.stored(spark.range(100, numPartitions=1), rows=10)
    assert len(held.inputFiles()) == 10 and held.count() == 100


def test_packages_are_made_by_all_cores(spark):
    from doclake.jobs.foreign_queries import _parts

    made = _parts(spark, "/root/testdata/sf0.001", {"a": "{k}"})
    assert made.rdd.getNumPartitions() > 1


def test_marks_of_paragraph_shapes(spark):
    from doclake.sources.xmlrows import hwpx_paragraph_marks

    heads = ['<paraPr id="1"><align horizontal="CENTER"/><heading type="NUMBER" level="2"/></paraPr><paraPr id="2"/><paraPr id="3"><heading type="NONE"/></paraPr><paraPr id="3"><heading type="BULLET"/></paraPr><paraPr><align horizontal="LEFT"/></paraPr>', "<broken"]
    parts = spark.createDataFrame([(n, "Contents/header.xml", f"<head>{x}</head>".encode()) for n, x in enumerate(heads)], "doc_id long, part string, bytes binary")
    assert sorted(map(tuple, hwpx_paragraph_marks(parts).collect())) == [(0, "1", "NUMBER", 2, "center"), (0, "3", "BULLET", 0, None)]
