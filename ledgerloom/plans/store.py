"""A ledger in a folder: several tables that change together, in versions.

A commit writes what it adds to each table aside, as Parquet, and then publishes a version: a small file, renamed to the
version's number, that lists the parts of all tables. A reader takes one version, so it sees a commit in all tables or in none;
a writer that dies before the rename leaves parts that no version lists, and one that lost the race for a number raises
Conflict. (The rename must be atomic, as on HDFS or a local disk.)

A row of a later part replaces the row of the same id of earlier ones, and a part may name ids that are gone. So a change of a
few lines doesn't rewrite a table; compact() does, by a commit of its own.

What must hold of a commit is counted while its parts are written, by observations of the writing jobs, and a commit with a
count above zero is refused before the rename: entries that don't balance or have fewer than two lines, lines of no entry,
lines without a base amount, matches of a line with itself, and lines of several matches.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BALANCE_TOLERANCE

#: The tables of a ledger and their columns; each has an id.
TABLES = {
    "batches": "id string, record_count long, created long, duplicated long, review long, failed long, status string",
    "rows": "id long, batch_id long, line_number long, account_id long, raw_description string, raw_amount long, currency string, raw_date date, occurrence_index int, fingerprint string, status string, error_message string, entry_id long",
    "entries": "id long, entry_date date, description string, is_transfer boolean",
    "lines": "id long, entry_id long, sort_order int, account_id long, amount long, currency string, amount_base decimal(18,4), category_id long, is_synthesized boolean, transfer_match_id long",
    "matches": "id long, out_id long, in_id long, method string, confidence decimal(3,2)",
    "reviews": "id long, reason string, candidates array<long>",
}


class Conflict(Exception):
    """Another writer has published this version."""


class Refused(Exception):
    """A commit breaks a rule; the counts are in `broken`."""

    def __init__(self, broken: dict[str, int]) -> None:
        super().__init__(f"commit refused: {broken}")
        self.broken = broken


@dataclass
class Change:
    """What a commit adds to a table (rows that replace those of the same id), and the ids that go."""

    rows: DataFrame
    gone: DataFrame | None = None


@dataclass
class Version:
    number: int
    #: Of each table: parts in order, as (sequence, path of rows or None, path of ids that are gone or None).
    parts: dict[str, list[list]] = field(default_factory=dict)


class LedgerStore:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] = TABLES) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = {name: T._parse_datatype_string(ddl) for name, ddl in tables.items()}

    # Versions ---------------------------------------------------------------------------------------

    def _path(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> Version:
        """The latest version; 0, which is empty, before any."""
        folder, fs = self._path(f"{self.root}/versions")
        numbers = [int(x.getPath().getName()) for x in fs.listStatus(folder)] if fs.exists(folder) else []
        if not numbers:
            return Version(0)
        file, _ = self._path(f"{self.root}/versions/{max(numbers):08d}")
        stream = fs.open(file)
        try:
            return Version(max(numbers), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, number: int, parts: dict[str, list[list]]) -> None:
        aside, fs = self._path(f"{self.root}/aside/{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        try:
            stream.write(json.dumps(parts).encode())
        finally:
            stream.close()
        target, _ = self._path(f"{self.root}/versions/{number:08d}")
        fs.mkdirs(target.getParent())
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, options)
        except Exception:
            if not fs.exists(target):
                raise
            fs.delete(aside, False)
            raise Conflict(number) from None

    # Rows -------------------------------------------------------------------------------------------

    def read(self, table: str, version: Version | None = None) -> DataFrame:
        """A table as of a version, the latest by default."""
        version, schema = version or self.version(), self.schemas[table]
        parts = version.parts.get(table, [])
        held = [(n, rows) for n, rows, _ in parts if rows]
        if not held:
            return self.spark.createDataFrame([], schema)
        if len(parts) == 1:
            return self.spark.read.schema(schema).parquet(held[0][1])
        numbered = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_part", T.LongType())])).parquet(*[rows for _, rows in held])
        gone = [g for _, _, g in parts if g]
        if gone:
            ids = self.spark.read.schema(T.StructType([schema["id"], T.StructField("_part", T.LongType())])).parquet(*gone)
            numbered = numbered.withColumn("_row", F.struct(*schema.names)).select("id", "_part", "_row").unionByName(ids, allowMissingColumns=True)
        else:
            numbered = numbered.select("id", "_part", F.struct(*schema.names).alias("_row"))
        latest = numbered.groupBy("id").agg(F.max_by("_row", "_part").alias("_row"))
        return latest.where("_row is not null").select("_row.*")

    def _write(self, df: DataFrame, what: str, counts: dict[str, Column], broken: dict[str, int]) -> str:
        """Write df to a fresh path; counts of it, made on the way, are put into broken."""
        path = f"{self.root}/parts/{what}-{uuid.uuid4().hex}"
        if counts:
            seen = Observation()
            df = df.observe(seen, *[F.sum(c.cast("long")).alias(name) for name, c in counts.items()])
        df.write.parquet(path)
        if counts:
            broken.update({name: n or 0 for name, n in seen.get.items()})
        return path

    def stage(self, table: str, change: Change, number: int, broken: dict[str, int]) -> list:
        """A change's files, written under no version yet."""
        schema = self.schemas[table]
        rows = change.rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).withColumn("_part", F.lit(number).cast("long"))
        counts = {"no_base_amount": F.col("amount_base").isNull()} if table == "lines" else {"self_match": F.col("out_id") == F.col("in_id")} if table == "matches" else {}
        gone = None
        if change.gone is not None:
            ids = change.gone.select(F.col("id").cast(schema["id"].dataType).alias("id")).distinct()
            # A row that goes and comes back in one commit is there.
            ids = ids.join(rows.select("id"), "id", "left_anti")
            gone = self._write(ids.withColumn("_part", F.lit(number).cast("long")), f"{table}-gone", {}, broken)
        return [number, self._write(rows, table, counts, broken), gone]

    def commit(self, changes: dict[str, Change], base: Version | None = None) -> int:
        """Publish changes of tables on top of a version (the latest by default): all of them or, if they break a rule or
        another writer was first, none. Returns the version's number."""
        base = base or self.version()
        number, broken = base.number + 1, {}
        parts = {name: list(base.parts.get(name, [])) for name in self.schemas}
        for table, change in changes.items():
            parts[table].append(self.stage(table, change, number, broken))
        after = Version(number, parts)
        if {"entries", "lines"} & set(changes):
            self._write(*self._balance(after, changes, number), broken)
        if {"matches", "lines"} & set(changes):
            self._write(*self._matched(after), broken)
        if any(broken.values()):
            raise Refused({k: n for k, n in broken.items() if n})
        self._publish(number, parts)
        return number

    def _balance(self, after: Version, changes: dict[str, Change], number: int):
        """The sums of the entries that this commit touches, to be written and observed."""
        touched = []
        for table, column in (("entries", F.col("id").alias("entry_id")), ("lines", F.col("entry_id"))):
            if table in changes:
                touched.append(self.spark.read.parquet(after.parts[table][-1][1]).select(column))
        if "lines" in changes:  # entries that lose lines, or whose lines move to others
            _, rows, gone = after.parts["lines"][-1]
            moved = [self.spark.read.parquet(p).select("id") for p in (rows, gone) if p]
            before = Version(number - 1, {"lines": after.parts["lines"][:-1]})
            touched += [self.read("lines", before).join(ids, "id", "left_semi").select("entry_id") for ids in moved]
        ids = touched[0]
        for t in touched[1:]:
            ids = ids.union(t)
        ids = ids.distinct()
        sums = self.read("lines", after).join(ids, "entry_id", "left_semi").groupBy("entry_id").agg(F.count("*").alias("n_lines"), F.sum("amount_base").alias("total"))
        entries = self.read("entries", after).select(F.col("id").alias("entry_id"), F.lit(True).alias("there")).join(ids, "entry_id", "left_semi")
        joined = entries.join(sums, "entry_id", "full_outer")
        there, n, total = F.coalesce("there", F.lit(False)), F.coalesce("n_lines", F.lit(0)), F.coalesce("total", F.lit(0))
        off = F.abs(total) > F.expr(f"{BALANCE_TOLERANCE}BD")
        return joined, "balance", {"no_entry": ~there, "few_lines": there & (n < 2), "unbalanced": there & off}

    def _matched(self, after: Version):
        """How many matches each matched line is in, to be written and observed."""
        ends = self.read("matches", after).select(F.explode(F.array("out_id", "in_id")).alias("line_id")).groupBy("line_id").agg(F.count("*").alias("n"))
        return ends, "matched", {"matched_twice": F.col("n") > 1}

    def compact(self) -> int:
        """Rewrite each table of several parts as one."""
        base = self.version()
        number, parts = base.number + 1, {}
        for name, held in base.parts.items():
            parts[name] = [self.stage(name, Change(self.read(name, base)), number, {})] if len(held) > 1 else held
        self._publish(number, parts)
        return number
