import os

from tessera.llm.store import materialize


def test_tables_on_the_way_have_no_success_file(spark):
    """Its making has the driver's JVM start child processes, which were seen counted as a second JVM."""
    df = materialize(spark.range(3), "plain")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    names = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    assert names and not any(n.startswith("_") for n in names) and df.count() == 3


def test_tables_on_the_way_start_no_processes(spark, tmp_path):
    """For each folder, file and checksum the JVM would start a ``chmod``, which is a second JVM to whoever looks too early."""
    jvm = spark.sparkContext._jvm
    materialize(spark.range(1), "first")  # Hadoop asks for its shell once
    seen = jvm.jdk.jfr.Recording()
    seen.enable("jdk.ProcessStart")
    seen.start()
    df = materialize(spark.range(0, 30, 1, 3), "plain")
    seen.stop()
    seen.dump(jvm.java.io.File(f"{tmp_path}/seen.jfr").toPath())
    seen.close()
    assert df.count() == 30 and len(df.inputFiles()) == 3
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file:"))
    # The modes that Hadoop's own class gives.
    plain = f"{tmp_path}/plain"
    spark.range(0, 30, 1, 3).write.parquet(f"file://{plain}")
    mode = lambda at: ({oct(os.stat(f"{at}/{f}").st_mode) for f in os.listdir(at)}, oct(os.stat(at).st_mode))
    assert mode(folder) == mode(plain)
    started = [str(e) for e in jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(jvm.java.io.File(f"{tmp_path}/seen.jfr").toPath())]
    assert [e for e in started if "chmod" in e] == []
