"""What several operators of this subpackage need: cut lineage, hot-key joins, hold-out rules, table readers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: At most so many keys are ever sent to all executors as "hot"; a key is hot above 1/HOT_KEYS of the rows.
HOT_KEYS = 1024


def ship(spark: SparkSession) -> None:
    """Makes this package known to the Python workers, wherever the driver found it."""
    sc, name = spark.sparkContext, "termweave_workers.zip"
    if any(str(x).endswith(name) for x in getattr(sc, "_python_includes", [])):
        return
    top = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="termweave-")) / name
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    sc.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one on one machine; on a cluster an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    named = named or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: intermediate results need a folder that all executors share")
        named = tempfile.mkdtemp(prefix="termweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spilled(df: DataFrame, what: str) -> DataFrame:
    """As stable(), but as Parquet: compressed, with pruned columns on later reads. For tables read in part or more than once."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(rows: DataFrame) -> Column:
    """All columns of rows as one struct, so that no name of theirs can meet a name of ours."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns])


def id_bucket(column: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % mod


def attach(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows LEFT JOIN facts on `key`, where facts has one row a key, and any key may hold a third of `rows`.

    Keys above 1/HOT_KEYS of the rows (so at most HOT_KEYS of them) meet their fact by a broadcast of that bounded
    table; all other keys are shuffled. Null keys find nothing.
    """
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = stable(counts.where((F.col("__n") > max(1000, total // HOT_KEYS)) & F.col(key).isNotNull()).select(key))
    if hot.isEmpty():
        return rows.join(facts, key, "left")
    hot_facts = facts.join(F.broadcast(hot), key, "left_semi")
    warm = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(hot_facts), key, "left")
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(facts, key, "left")
    return warm.unionByName(cold)
