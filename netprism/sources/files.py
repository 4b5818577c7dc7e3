"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import table

# NSL-KDD field names in file order, plus the difficulty level
# that the raw files carry as a 43rd field.
NSL_KDD_FIELDS = (
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "land", "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
    "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login",
    "is_guest_login", "count", "srv_count", "serror_rate", "srv_serror_rate",
    "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
    "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
    "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "label", "difficulty")
_NSL_STRING = {"protocol_type", "service", "flag", "label"}
_NSL_INT = {"land", "logged_in", "root_shell", "su_attempted", "is_host_login", "is_guest_login",
            "difficulty"}


def nsl_kdd_schema() -> T.StructType:
    fields = []
    for n in NSL_KDD_FIELDS:
        if n in _NSL_STRING:
            t = T.StringType()
        elif n in _NSL_INT:
            t = T.IntegerType()
        elif n.endswith("_rate"):
            t = T.DoubleType()
        else:
            t = T.LongType()
        fields.append(T.StructField(n, t, True))
    return T.StructType(fields)


# CIC-IDS-2017 column names in file order.
CIC_IDS_FIELDS = (
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Fwd Packet Length Max",
    "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean",
    "Bwd Packet Length Std", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std",
    "Flow IAT Max", "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max",
    "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags", "Fwd Header Length",
    "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s", "Min Packet Length",
    "Max Packet Length", "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count",
    "URG Flag Count", "CWE Flag Count", "ECE Flag Count", "Down/Up Ratio", "Average Packet Size",
    "Avg Fwd Segment Size", "Avg Bwd Segment Size", "Fwd Header Length.1", "Fwd Avg Bytes/Bulk",
    "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate", "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk",
    "Bwd Avg Bulk Rate", "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets",
    "Subflow Bwd Bytes", "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd",
    "min_seg_size_forward", "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean",
    "Idle Std", "Idle Max", "Idle Min", "Label")
# UNSW-NB15 column names of the training and testing files, in file order.
UNSW_FIELDS = (
    "id", "dur", "proto", "service", "state", "spkts", "dpkts", "sbytes", "dbytes", "rate", "sttl",
    "dttl", "sload", "dload", "sloss", "dloss", "sinpkt", "dinpkt", "sjit", "djit", "swin",
    "stcpb", "dtcpb", "dwin", "tcprtt", "synack", "ackdat", "smean", "dmean", "trans_depth",
    "response_body_len", "ct_srv_src", "ct_state_ttl", "ct_dst_ltm", "ct_src_dport_ltm",
    "ct_dst_sport_ltm", "ct_dst_src_ltm", "is_ftp_login", "ct_ftp_cmd", "ct_flw_http_mthd",
    "ct_src_ltm", "ct_srv_dst", "is_sm_ips_ports", "attack_cat", "label")
_UNSW_DOUBLE = {"dur", "rate", "sload", "dload", "sinpkt", "dinpkt", "sjit", "djit", "tcprtt",
                "synack", "ackdat"}


def cic_ids_schema() -> T.StructType:
    """Ports and flag counts int, packet counts and the duration long, measures double."""
    fields = []
    for n in CIC_IDS_FIELDS:
        if n == "Label":
            t = T.StringType()
        elif n == "Destination Port" or "Flag" in n:
            t = T.IntegerType()
        elif n in ("Flow Duration", "Total Fwd Packets", "Total Backward Packets"):
            t = T.LongType()
        else:
            t = T.DoubleType()
        fields.append(T.StructField(n, t, True))
    return T.StructType(fields)


def unsw_nb15_schema() -> T.StructType:
    fields = []
    for n in UNSW_FIELDS:
        if n in ("proto", "service", "state", "attack_cat"):
            t = T.StringType()
        elif n in _UNSW_DOUBLE:
            t = T.DoubleType()
        elif n == "label":
            t = T.IntegerType()
        else:
            t = T.LongType()
        fields.append(T.StructField(n, t, True))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             header: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """CSV with header; an explicit schema avoids the inference pass (use it at scale)."""
    r = spark.read.option("header", header).option("mode", mode)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_headerless(spark: SparkSession, path: str, schema: T.StructType,
                    check_arity: bool = True) -> DataFrame:
    """Headerless CSV with a fixed named schema.  ``FAILFAST`` makes a row
    with the wrong number of fields an error instead of a silent shift (T5)."""
    mode = "FAILFAST" if check_arity else "PERMISSIVE"
    return spark.read.schema(schema).option("header", False).option("mode", mode).csv(path)


def schema_for(name: str) -> T.StructType | None:
    """The fixed schema chosen by data set name."""
    n = name.upper().replace("-", "_")
    for part, schema in (("NSL_KDD", nsl_kdd_schema), ("CIC_IDS", cic_ids_schema), ("UNSW_NB15", unsw_nb15_schema)):
        if part in n:
            return schema()
    return None


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by suffix, headerless NSL-KDD by name, other CSV with
    header.  Headers with all the names of the data set's schema (in its order;
    blanks around names do not count) get its types without an inference pass."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    name = path.rsplit("/", 1)[-1]
    schema = schema_for(name)
    if schema is not None and "NSL_KDD" in name.upper().replace("-", "_"):
        return read_headerless(spark, path, schema)
    if schema is not None:
        head = spark.read.option("header", True).csv(path).columns
        if [c.strip().lower() for c in head] == [c.lower() for c in schema.names]:
            return read_csv(spark, path, schema)
    return read_csv(spark, path)


CLEANED_SUFFIXES = ("_cleaned", "-cleaned", "_clean", "-clean")


def dataset_name_expr(file_col) -> "F.Column":
    """File name -> data set name ('_' and ' ' -> '-', cleaned suffix removed)."""
    stem = F.regexp_replace(file_col, r"\.[^.]*$", "")
    name = F.regexp_replace(stem, r"[_ ]", "-")
    return F.regexp_replace(name, r"(-cleaned|-clean)$", "")


def discover(spark: SparkSession, folder: str, pattern: str = "*.csv",
             schema: T.StructType | None = None) -> DataFrame:
    """Every matching file under ``folder`` except already-cleaned ones, read
    as one DataFrame with a ``dataset`` column from the file name (no driver loop
    over files; the listing is Spark's)."""
    r = spark.read.option("pathGlobFilter", pattern).option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(folder).withColumn("__file", F.col("_metadata.file_name"))
    df = df.where(~F.col("__file").rlike(r"[_-]cleaned"))
    return df.withColumn("dataset", dataset_name_expr(F.col("__file"))).drop("__file")


def sample_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First n rows in an explicit order (top-k, no full sort)."""
    return df.orderBy(*order_by).limit(n)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: Sequence[str] = ()) -> None:
    """Write the cleaned data (partitioned when asked)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 stand-in: documents in the ``binaryFile`` layout (content = UTF-8 bytes)."""
    d = table(spark, sf_dir, "documents")
    content = F.encode(F.col("text"), "UTF-8")
    return d.select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
                    F.octet_length(F.col("text")).cast("long").alias("length"),
                    content.alias("content"))


def read_binary_files(spark: SparkSession, path: str, glob: str = "*",
                      min_bytes: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """A corpus of binary files (path, modificationTime, length, content).
    A ``length`` predicate is evaluated on the listing before any file is read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    if min_bytes is not None:
        df = df.where(F.col("length") >= min_bytes)
    if max_bytes is not None:
        df = df.where(F.col("length") <= max_bytes)
    return df


def discover_folders(spark: SparkSession, root: str, pattern: str = "*.csv",
                     schema: T.StructType | None = None) -> DataFrame:
    """S04 for data written by Spark (a folder of part files per data set): the
    data set name comes from the folder, cleaned copies are skipped."""
    r = (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
         .option("header", True))
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(root).withColumn("__dir", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    df = df.where(~F.col("__dir").rlike(r"[_-]clean(ed)?(\.[^.]*)?$"))
    return df.withColumn("dataset", dataset_name_expr(F.col("__dir"))).drop("__dir")
