"""Online feature store: the newest features per (zone, group), valid for a while.

Writes are numbered folders. `d<number>` is a delta: the entries of one write,
hashed into buckets by key, so a write makes files for the buckets it touches and
for no others. `b<number>` is a base: all entries up to that write. Readers take
the newest finished base and the finished deltas after it and keep the newest
entry of each key; a look-up of known keys opens their buckets only. A write that
fails leaves no success mark, is never read, and its folder is used by the next.

Once `compact_after` deltas have gathered, they are merged with the base into a
new base. Entries that were past their life at the newest entry's time are left
out of it. The last few folders it replaces stay for readers still on them.
Repeating a write changes nothing, because the newest entry per key wins; a write
with a batch id that is there already is skipped. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast import fixed_values as fv
from zonecast.schema import ONLINE

GROUP = "demand_features"


def feature_map(columns: Sequence[str]) -> Column:
    """The columns as a name -> text map."""
    return F.create_map(*[part for c in columns for part in (F.lit(c), F.col(c).cast("string"))])


def latest_features(df: DataFrame, target: str = "demand") -> DataFrame:
    """Per zone, the numeric fields of the newest row but the target, rounded to 4 places."""
    numeric = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (target, "zone")
    ]
    newest = df.groupBy("zone").agg(F.max_by(F.struct(*numeric), "timestamp").alias("row"))
    return newest.select("zone", *[F.round(F.col(f"row.{c}").cast("double"), 4).alias(c) for c in numeric])


def as_entries(features: DataFrame, group: str, updated_at: Column) -> DataFrame:
    """One store entry per row of `features` (zone and feature columns)."""
    names = [c for c in features.columns if c != "zone"]
    return features.select(
        "zone", F.lit(group).alias("feature_group"), feature_map(names).alias("features"),
        updated_at.cast("timestamp").alias("updated_at"),
    )


BUCKETS = 64
_STORED = T.StructType([*ONLINE.fields, T.StructField("bucket", T.IntegerType())])


def bucket_of_key(zone: Column, group: Column) -> Column:
    return F.pmod(F.xxhash64(zone, group), F.lit(BUCKETS)).cast("int")


class OnlineStore:
    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = fv.ONLINE_TTL_SECONDS, keep_versions: int = 8, compact_after: int = 16):
        self.spark = spark
        self.path = path.rstrip("/")
        self.ttl = ttl_seconds
        self.keep = keep_versions
        self.compact_after = compact_after

    def _folder(self, name: str = ""):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _finished(self, kind: str) -> list[int]:
        fs, folder = self._folder()
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[0] == kind and n[1:].isdigit() and fs.exists(self._folder(f"{n}/_SUCCESS")[1]))

    def versions(self) -> list[int]:
        """Finished writes, oldest first, that still have a folder of their own."""
        return self._finished("d")

    def _needed(self) -> list[str]:
        """The folders that make up the store: the newest base and the deltas after it."""
        bases = self._finished("b")
        deltas = [n for n in self.versions() if not bases or n > bases[-1]]
        return [f"b{n:012d}" for n in bases[-1:]] + [f"d{n:012d}" for n in deltas]

    def _stored(self, folders: Sequence[str]) -> DataFrame:
        """Entries of the folders, at most `compact_after` and a base, with their bucket and the number of the write."""
        rows = self.spark.createDataFrame([], T.StructType([*_STORED.fields, T.StructField("_write", T.LongType())]))
        for folder in folders:
            part = self.spark.read.schema(_STORED).parquet(f"{self.path}/{folder}")
            rows = rows.unionByName(part.withColumn("_write", F.lit(int(folder[1:])).cast("long")))
        return rows

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("zone", "feature_group").orderBy(F.desc("updated_at"), F.desc("_write"), F.desc(F.to_json("features")))
        return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_write")

    def entries(self) -> DataFrame:
        """The newest entry of every key, expired ones included."""
        return self._newest(self._stored(self._needed())).select(*ONLINE.names)

    def write(self, entries: DataFrame, batch_id: str | None = None) -> None:
        """Upsert: per (zone, group) the newest entry stays, the later write's on a tie."""
        done = self.versions()
        fs, _ = self._folder()
        if batch_id is not None and any(fs.exists(self._folder(f"d{n:012d}/_batch_{batch_id}")[1]) for n in done):
            return
        number = max([-1, *done, *self._finished("b")]) + 1
        name = f"d{number:012d}"
        own = self._newest(entries.select(*ONLINE.names, F.lit(number).cast("long").alias("_write")))
        dealt = own.withColumn("bucket", bucket_of_key(F.col("zone"), F.col("feature_group"))).repartition("bucket")
        self._put(dealt, name)
        if batch_id is not None:
            fs.create(self._folder(f"{name}/_batch_{batch_id}")[1], True).close()
        if len([f for f in self._needed() if f[0] == "d"]) >= self.compact_after:
            self.compact()

    def _put(self, rows: DataFrame, name: str) -> None:
        # Static, so that a folder left by a failed write is replaced as a whole, and marked when it is whole.
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def compact(self) -> None:
        """Merge the base and all deltas into a new base, without entries past their life."""
        needed = self._needed()
        if not needed:
            return
        last = int(needed[-1][1:])
        if needed[-1][0] == "d":
            newest = self._newest(self._stored(needed))
            alive = F.col("updated_at") > newest.agg(F.max("updated_at").alias("t")).scalar() - F.make_dt_interval(secs=F.lit(self.ttl))
            self._put(newest.where(alive).repartition("bucket"), f"b{last:012d}")
        fs, _ = self._folder()
        for n in [n for n in self.versions() if n <= last][: -self.keep or None]:
            fs.delete(self._folder(f"d{n:012d}")[1], True)
        for n in self._finished("b")[:-2]:
            fs.delete(self._folder(f"b{n:012d}")[1], True)

    def push(self, zone: str, features: dict[str, object], now: Column | None = None, group: str = GROUP) -> None:
        """Write the features of one zone."""
        text = {k: str(v) for k, v in features.items()}
        row = self.spark.createDataFrame([(zone, group, text)], "zone string, feature_group string, features map<string,string>")
        self.write(row.withColumn("updated_at", (F.current_timestamp() if now is None else now).cast("timestamp")))

    def read(self, zone: str, group: str = GROUP, now: Column | None = None) -> DataFrame:
        """The entry of one zone; no row when it is missing or stale."""
        return self.read_many([zone], group, now)

    def read_many(self, zones: Sequence[str], group: str = GROUP, now: Column | None = None) -> DataFrame:
        """The entries of some zones; only the files of their buckets are opened."""
        limit = (F.current_timestamp() if now is None else now.cast("timestamp")) - F.make_dt_interval(secs=F.lit(self.ttl))
        # Of constants, so the planner knows the buckets before it lists files.
        buckets = F.col("bucket").isin([bucket_of_key(F.lit(z), F.lit(group)) for z in zones]) if zones else F.lit(False)
        own = self._stored(self._needed()).where(buckets & F.col("zone").isin(list(zones)) & (F.col("feature_group") == group))
        return self._newest(own).where(F.col("updated_at") > limit).select(*ONLINE.names)


def materialize(df: DataFrame, offline, online: OnlineStore, now: Column | None = None) -> None:
    """Write the offline months, then the latest features of every zone.

    The online part reads back the months just written instead of computing the
    features a second time.
    """
    before = offline.modified()
    offline.write(df)
    touched = [m for m, at in offline.modified().items() if before.get(m) != at]
    month = F.col("year") * 12 + F.col("month")
    fresh = offline.table().where(month.isin([y * 12 + m for y, m in touched])).drop("year", "month") if touched else df.limit(0)
    online.write(as_entries(latest_features(fresh), GROUP, F.current_timestamp() if now is None else now))
