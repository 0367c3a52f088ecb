"""Dataset profiles (mask list, prefix depth, similarity threshold, line format)
as data, so one job can mine many datasets keyed by ``dataset``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Benchmark profiles (dataset, log format, masks, depth, st).
# ---------------------------------------------------------------------------
_LINUX_MASKS = [
    r"(\d+\.){3}\d+",
    r"\d{2}:\d{2}:\d{2}",
    r"\/[\w\.\/-]+",
    r"\[\s*\d+\.\d+\s*\]",
    r"((?<=\s)|(?<=^))0x[a-f0-9A-F]+",
    r"\b[0-9a-fA-F]{10,}\b",
    r"\d+",
]
_OPENSTACK_MASKS = [
    r"((\d+\.){3}\d+,?)+",
    r"[a-fA-F0-9]{8}(?:-[a-fA-F0-9]{4}){3}-[a-fA-F0-9]{12}",
    r"req-[a-fA-F0-9-]+",
    r"/.+?\s",
    r"\d+",
]
_HADOOP_FORMAT = r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>"
_HADOOP_MASKS = [r"(\d+\.){3}\d+", r"\d{2}:\d{2}:\d{2}", r"\d+"]
_LINUX_FORMAT = r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>"
_OPENSTACK_FORMAT = r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>"
_BGL_FORMAT = r"<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>"
_BGL_MASKS = [r"core\.\d+", r"(\d+\.){3}\d+", r"0x[a-f0-9A-F]+", r"\d+"]
_SPARK_FORMAT = r"<Date> <Time> <Level> <Component>: <Content>"
_SPARK_MASKS = [r"(\d+\.){3}\d+", r"\b[KGTM]?B\b", r"([\w-]+\.){2,}[\w-]+", r"\d+"]
_MAC_FORMAT = r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>"
_MAC_MASKS = [r"([\w-]+\.){2,}[\w-]+", r"\d+"]

PROFILES = [
    ("HDFS", r"<Date> <Time> <Pid> <Level> <Component>: <Content>",
     [r"blk_-?\d+", r"(\d+\.){3}\d+(:\d+)?"], 1, 0.5),
    ("Hadoop", _HADOOP_FORMAT, _HADOOP_MASKS, 1, 0.5),
    ("Spark", _SPARK_FORMAT, _SPARK_MASKS, 1, 0.5),
    ("Zookeeper", r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>",
     [r"(/|)(\d+\.){3}\d+(:\d+)?", r"0x[a-f0-9A-F]+", r"\d+"], 3, 0.5),
    ("BGL", _BGL_FORMAT, _BGL_MASKS, 1, 0.5),
    ("HPC", r"<LogId> <Node> <Component> <State> <Time> <Flag> <Content>",
     [r"=\d+", r"0x[a-f0-9A-F]+", r"\d+"], 1, 0.5),
    ("Thunderbird",
     r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>",
     [r"(\d+\.){3}\d+", r"\/[\w\.\/-]+", r"0x[a-f0-9A-F]+", r"\b[0-9a-fA-F]{8,}\b", r"(\d+)"], 1, 0.5),
    ("Windows", r"<Date> <Time>, <Level>                  <Component>    <Content>",
     [r"0x.*?\s"], 3, 0.5),
    ("Linux", _LINUX_FORMAT, _LINUX_MASKS, 1, 0.5),
    ("Android", r"<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>",
     [r"(/[\w-]+)+", r"([\w-]+\.){2,}[\w-]+",
      r"\b(\-?\+?\d+)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b"], 3, 0.5),
    ("HealthApp", r"<Time>\|<Component>\|<Pid>\|<Content>",
     [r"([\w-]+\.){2,}[\w-]+", r"\b(\-?\+?\d+)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b"], 1, 0.5),
    ("Apache", r"\[<Time>\] \[<Level>\] <Content>", [r"(\d+\.){3}\d+", r"\d+"], 3, 0.5),
    ("Proxifier", r"\[<Time>\] <Program> - <Content>",
     [r"<\d+\ssec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"\d{2}:\d{2}(:\d{2})*", r"[KGTM]B"], 5, 0.5),
    ("OpenSSH", r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>",
     [r"(\d+\.){3}\d+", r"([\w-]+\.){2,}[\w-]+", r"\d+"], 2, 0.5),
    ("OpenStack", _OPENSTACK_FORMAT, _OPENSTACK_MASKS, 1, 0.5),
    ("Mac", _MAC_FORMAT, _MAC_MASKS, 1, 0.5),
    ("TestHadoop", _HADOOP_FORMAT, _HADOOP_MASKS, 3, 0.5),
    ("TestLinux", _LINUX_FORMAT, _LINUX_MASKS, 3, 0.5),
    ("TestOpenStack", _OPENSTACK_FORMAT, _OPENSTACK_MASKS, 3, 0.5),
    ("Testxieyi", _LINUX_FORMAT, _LINUX_MASKS, 3, 0.5),
    ("TestBGL", _BGL_FORMAT, _BGL_MASKS, 3, 0.5),
    ("TestSpark", _SPARK_FORMAT, _SPARK_MASKS, 3, 0.5),
    ("TestMac", _MAC_FORMAT, _MAC_MASKS, 3, 0.5),
]
# Summary row order.
DATASET_ORDER = [p[0] for p in PROFILES]
# ---------------------------------------------------------------------------

PROFILE_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("log_format", T.StringType()),
    T.StructField("masks", T.ArrayType(T.StringType())),
    T.StructField("depth", T.IntegerType()),
    T.StructField("st", T.DoubleType()),
])


def profile(name: str) -> dict:
    for d, fmt, masks, depth, st in PROFILES:
        if d == name:
            return {"dataset": d, "log_format": fmt, "masks": list(masks), "depth": depth, "st": st}
    raise KeyError(name)


def profiles_frame(spark: SparkSession, extra: list | None = None) -> DataFrame:
    """All profiles as a small static DataFrame (23 rows + ``extra``)."""
    rows = [(d, f, list(m), int(dep), float(st)) for d, f, m, dep, st in PROFILES + list(extra or [])]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)
