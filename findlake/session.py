"""Session-level helpers: table access, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was measured to hold at most so many rows and bytes (in memory, estimated).
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("findlake")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers anywhere can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    shared = shared_dir(spark)
    folder = Path(shared.removeprefix("file://")) if shared.startswith(("file:", "/")) else Path(tempfile.mkdtemp())
    folder.mkdir(parents=True, exist_ok=True)
    package = Path(__file__).resolve().parent
    target = folder / f"findlake-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder. Timestamps stay without a zone, so filters on them reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "findlake-checkpoints")
        os.makedirs(folder, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
        folder = f"file://{folder}"
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/findlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = df.sparkSession._jvm  # the folder is cleaned up when the application ends
    file = jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(file)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, written, and marked for broadcast if it is measured to hold at most `rows` rows and `size` bytes; else as it is
    (a shuffled join).

    The plan runs once: what is written is counted, measured and read. The size is that of the longest row times the rows
    for a table that is small on disk; no table whose files alone exceed the size is looked at."""
    jvm = df.sparkSession._jvm
    if not _plain_scan(df):
        df = written(df, "bounded")
    on_disk = 0
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        on_disk += path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if on_disk > size:
            return df
    n, widest = df.agg(F.count("*"), F.max(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()
    return F.broadcast(df) if n <= rows and n * (widest or 0) <= size else df


def _plain_scan(df: DataFrame) -> bool:
    """Whether df is a table of files as it is, without anything on top."""
    return df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LogicalRelation"


def validate_query(spark: SparkSession, sql: str) -> str:
    """The query, if it is one statement that only reads; ValueError otherwise. Only the parser runs."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ValueError("not a single readable statement") from e
    kinds = {type_name.split("(")[0].strip() for type_name in plan.toString().replace("+-", " ").replace(":-", " ").splitlines()}
    if plan.getClass().getName().rsplit(".", 1)[-1] in ("Project", "UnresolvedWith", "Aggregate", "Filter", "Sort", "GlobalLimit", "Union", "Distinct", "Except", "Intersect", "UnresolvedHaving", "Limit", "LocalLimit", "WithCTE", "UnresolvedInlineTable"):
        if not any(k.startswith(("'Insert", "Insert", "Create", "'Create", "Drop", "'Drop", "Set")) for k in kinds):
            return sql
    raise ValueError("only SELECT and WITH are allowed")


def alnum(col: Column) -> Column:
    """Lower case, letters and digits only (any script): what is left when case, blanks and punctuation don't matter."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "")
