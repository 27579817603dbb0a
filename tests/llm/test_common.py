from pyspark.sql import functions as F

from varloom.llm.common import connected_components, cut, delete, drop_cut, owned, shared_dir, values


class Session:
    """A session with the given settings alone."""

    def __init__(self, master, **settings):
        self.sparkContext = type("C", (), {"master": master})
        self.conf = type("S", (), {"get": staticmethod(lambda k, default=None: settings.get(k.replace(".", "_"), default))})


def test_the_shared_folder():
    assert shared_dir(Session("spark://x", spark_checkpoint_dir="hdfs://n/shared/")) == "hdfs://n/shared"
    assert shared_dir(Session("local[4]")).startswith("file:///") and shared_dir(Session("local[4]")) == shared_dir(Session("local[2]"))
    for master in ("spark://x", "local-cluster[3,2,1000]"):
        assert shared_dir(Session(master, spark_sql_warehouse_dir="hdfs://n/w")) == "hdfs://n/w/_varloom_checkpoints"


def test_tables_have_an_owner(spark):
    with owned() as made:
        one, two = cut(spark.range(5)), cut(spark.range(7))
    assert len(made) == 2 and two.count() == 7 and one.count() == 5
    drop_cut(one)
    delete(spark, made[1])
    for path in made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def test_components_of_structs_and_nothing(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (4, 4), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in connected_components(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 8, 8: 8}
    both = pairs.select(*[F.struct(F.col(c).alias("x"), F.lit(1).alias("y")).alias(c) for c in "ab"]).where("a.x is not null")
    assert {r.node.x: r.component.x for r in connected_components(both).collect()} == got
    assert connected_components(pairs.limit(0)).count() == 0


def test_values_come_in_order():
    import pyarrow as pa

    assert list(values(pa.array([1, None, 3, 4, 5]), 2)) == [1, None, 3, 4, 5] and list(values(pa.array([], pa.int64()))) == []
