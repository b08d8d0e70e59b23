"""Hadoop's local file system without child processes.

Without its native library Hadoop sets the mode of each folder, file and checksum on a local file system by starting ``chmod``: three
processes for a task that writes. Until such a child has become ``chmod`` it shares all memory of the JVM that started it. The class
here sets the same modes from within the JVM; all else is Hadoop's. Janino, which Spark brings for its own generated code, compiles it.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_CLASS = "tessera.files.Local"
_SOURCE = """package tessera.files;
public class Local extends org.apache.hadoop.fs.LocalFileSystem {
    public Local() { super(new Raw()); }
    public static class Raw extends org.apache.hadoop.fs.RawLocalFileSystem {
        public void setPermission(org.apache.hadoop.fs.Path p, org.apache.hadoop.fs.permission.FsPermission mode) throws java.io.IOException {
            try {
                java.nio.file.Files.setAttribute(pathToFile(p).toPath(), "unix:mode", Integer.valueOf(mode.toShort()), new java.nio.file.LinkOption[0]);
            } catch (UnsupportedOperationException e) {
                super.setPermission(p, mode);
            }
        }
    }
}"""
#: By application: the folder of the jar, which goes with this process, and the options of writers.
_MADE: dict[str, tuple[tempfile.TemporaryDirectory | None, dict[str, str]]] = {}


def options(spark: SparkSession, path: str) -> dict[str, str]:
    """Options of a writer to ``path``: none if it isn't local, if the session has a local file system of its own, or if the class can't be had."""
    sc = spark.sparkContext
    conf = sc._jsc.hadoopConfiguration()
    if (sc._jvm.org.apache.hadoop.fs.Path(path).toUri().getScheme() or sc._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf).getScheme()) != "file":
        return {}
    app = sc.applicationId
    if app not in _MADE:
        try:
            _MADE[app] = _make(spark)
        except Exception:  # the plain way does the same, with child processes
            _MADE[app] = None, {}
    return _MADE[app][1]


def _make(spark: SparkSession) -> tuple[tempfile.TemporaryDirectory | None, dict[str, str]]:
    sc = spark.sparkContext
    conf = sc._jsc.hadoopConfiguration()
    if conf.get("fs.file.impl"):
        return None, {}
    compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(_SOURCE)
    folder = tempfile.TemporaryDirectory(prefix="tessera-files-")
    jar = os.path.join(os.path.realpath(folder.name), f"tessera-files-{sc.applicationId}.jar")
    with zipfile.ZipFile(jar, "w") as z:
        for name, code in compiler.getBytecodes().items():
            z.writestr(name.replace(".", "/") + ".class", bytes(code))
    conf.getClassLoader().addURL(sc._jvm.java.io.File(jar).toURI().toURL())  # the driver's; executors get the jar with their tasks
    conf.getClassByName(_CLASS)
    sc._jsc.addJar(jar)
    return folder, {"fs.file.impl": _CLASS, "fs.file.impl.disable.cache": "true"}
