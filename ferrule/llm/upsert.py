"""Copy-on-write keyed upsert into a folder of sorted Parquet files, with parallel coalescing of what it rewrites.

A change is joined to its row by key; an absent key goes to its home, the last file that begins at or below it.
Only files whose rows differ afterwards are written anew, cut into the fewest pieces of at most `size` rows. Pieces
that stand side by side are then put together from left to right as long as they fit into `size` rows:

* prefix sums over the ordered pieces give each one's rows before it and the run of rewritten files that it is in,
* a binary search in the sums finds for every piece the piece at which the next group would begin, if one began here,
* doubling these pointers marks the starts that a run's first piece reaches, in a logarithmic number of joins,
* one shuffle brings each row to its final file, whose number follows from the row's place in its old file.

Pieces of one old file never meet again (they are the fewest possible), so its later pieces are starts, too.

Nothing is counted through one task: places come from range partitions, which are numbered within and shifted by the
sums of the partitions before them (a row a partition). Tables of files are joined by sort and merge, also while small.
A group of the binary search holds the pieces that end within 2 * `size` rows, and no more pieces than files.
A final file is written and digested by one task, which streams its sorted rows.

Defined cases: rows without a key stand first and are never changed; changes without a key are ignored; of repeated or
tied changes the greatest by all columns wins; rows that share a key are all set or all deleted; where such rows fill
several files, the last of these is the key's home. Other columns, of any name, are kept, and null in inserted rows.
An empty table has no files, so no homes, and no change applies; all rows deleted leave an empty folder and result.
A long text is a value like others. Files that were read stay until the new ones are committed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import Workspace, base_dir, read

LOCAL = (1 << 33) - 1
SCHEMES = {"s3a": "s3", "s3n": "s3"}
SET = ("source", "segment", "city", "balance")


def numbered(df: DataFrame, work: Workspace, name: str, *order: str | Column, **sums: Column) -> DataFrame:
    """`df` with _at, its rows' places in the given order, and running sums, the row's own value included."""
    saved = work.save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33)
    ends = saved.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_all_{k}") for k, v in sums.items()])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    shifts = ends.select("_p", F.coalesce(F.sum("_n").over(before), zero).alias("_n"), *[F.coalesce(F.sum(f"_all_{k}").over(before), zero).alias(f"_before_{k}") for k in sums])
    out = saved.withColumn("_p", part).join(F.broadcast(shifts), "_p")  # as many rows as the shuffle has partitions
    upto = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"_at": F.col("_n") + F.col("_m").bitwiseAND(LOCAL), **{k: F.col(f"_before_{k}") + F.sum(v).over(upto) for k, v in sums.items()}})
    return out.drop("_p", "_m", "_n", *[f"_before_{k}" for k in sums])


def write_files(rows: DataFrame, number: str, n: int, order: tuple[str, ...], folder: str) -> None:
    """Adds n files; `number` says which one a row goes to, `_row` holds its columns."""
    if n:
        rows.repartitionById(n, F.col(number).cast("int")).sortWithinPartitions(*order).select("_row.*").write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)


def packed(df: DataFrame, key: str) -> list[Column]:
    return [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{key}`").alias("_key")]


def lay_out(rows: DataFrame, key: str, size: int, folder: str) -> int:
    """Writes `rows` sorted by `key` as files of `size` rows (the last one: the rest); how many files."""
    work = Workspace(rows.sparkSession, "upsert-start")
    slim = rows.select(*packed(rows, key), F.monotonically_increasing_id().alias("_tie"))
    placed = numbered(slim, work, "rows", "_key", "_tie").withColumn("_file", F.floor(F.col("_at") / size))
    n = -(-placed.count() // size)
    write_files(placed, "_file", n, ("_key", "_tie"), folder)
    work.drop()
    return n


class Folder:
    """Parquet files that are sorted by `key`, each of at most `size` rows."""

    def __init__(self, spark: SparkSession, path: str, key: str, size: int):
        self.spark, self.path, self.key, self.size = spark, path, key, size
        self.work = Workspace(spark, "upsert")
        stored = spark.read.parquet(path)
        self.columns = stored.columns
        self.schema = stored.schema
        self.rows = stored.select(*packed(stored, key), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_tie"))
        ranges = self.rows.groupBy("_path").agg(F.min("_key").alias("_from"), F.max("_key").alias("_to"), F.max(F.col("_key").isNull()).alias("_bare"), F.count("*").alias("_rows"))
        ranges = ranges.withColumn("_from", F.when(~F.col("_bare"), F.col("_from")))
        files = numbered(ranges, self.work, "ranges", F.col("_from").asc_nulls_first(), F.col("_to").asc_nulls_first(), "_path")
        self.files = self.work.save(files.select(F.col("_at").alias("_file"), "_path", "_from", "_rows"), "files")

    def homes(self, changes: DataFrame) -> DataFrame:
        """Changes with _path and _from: the file in which their key belongs, and its first key."""
        kept = F.struct(*[F.col(f"`{c}`") for c in changes.columns]).alias("_row")
        keys = changes.filter(F.col(f"`{self.key}`").isNotNull()).select(F.col(f"`{self.key}`").alias("_key"), kept, F.lit(0).alias("_start"))
        starts = self.files.select(F.col("_from").cast(keys.schema["_key"].dataType).alias("_key"), F.lit(None).cast(keys.schema["_row"].dataType).alias("_row"), F.lit(1).alias("_start"))
        both = numbered(keys.unionByName(starts), self.work, f"homes-{uuid.uuid4().hex}", F.col("_key").asc_nulls_first(), F.col("_start").desc(), begun=F.col("_start").cast("long"))
        found = both.filter("_start = 0").select("_row", (F.greatest("begun", F.lit(1)) - 1).alias("_file"))
        return found.join(self.files.select("_file", "_path", "_from").hint("merge"), "_file").select("_row.*", "_path", "_from")

    def applied(self, changes: DataFrame, deleted: str, put: tuple[str, ...]) -> DataFrame:
        """All rows, and those inserted, after the changes: _row, _key, _path, _tie, whether changed and whether there."""
        new = changes.select(F.col(f"`{self.key}`").alias("_id"), F.col(f"`{deleted}`").alias("_gone"), F.struct(*[F.col(f"`{c}`") for c in put]).alias("_set"), F.col("_path").alias("_home"))
        joined = self.rows.join(new.hint("merge"), F.col("_key") == F.col("_id"), "left")
        named = F.col("_id").isNotNull()
        other = F.coalesce(F.col("_gone"), F.lit(False))
        for c in put:
            other = other | ~F.col(f"_row.`{c}`").eqNullSafe(F.col(f"_set.`{c}`"))
        row = F.struct(*[(F.when(named, F.col(f"_set.`{c}`")).otherwise(F.col(f"_row.`{c}`")) if c in put else F.col(f"_row.`{c}`")).alias(c) for c in self.columns])
        old = joined.select(row.alias("_row"), "_key", "_path", "_tie", (named & other).alias("_differs"), (~(named & F.coalesce("_gone", F.lit(False)))).alias("_there"))
        known = self.rows.select(F.col("_key").alias("_id")).filter("_id is not null").groupBy("_id").agg(F.lit(1).alias("_known"))
        extra = new.filter(~F.col("_gone")).join(known.hint("merge"), "_id", "left_anti")
        types = {f.name: f.dataType for f in self.schema.fields}
        values = [F.col("_id") if c == self.key else F.col(f"_set.`{c}`") if c in put else F.lit(None) for c in self.columns]
        made = F.struct(*[v.cast(types[c]).alias(c) for v, c in zip(values, self.columns, strict=True)])
        extra = extra.select(made.alias("_row"), F.col("_id").alias("_key"), F.col("_home").alias("_path"), F.lit(-1).cast("long").alias("_tie"), F.lit(True).alias("_differs"), F.lit(True).alias("_there"))
        return self.work.save(old.unionByName(extra), "applied")

    def upsert(self, changes: DataFrame, deleted: str, put: tuple[str, ...]) -> None:
        """Applies changes that `homes` returned, one a key: rows go where `deleted` is true, else their `put` columns are set."""
        rows = self.applied(changes, deleted, put)
        after = rows.groupBy("_path").agg(F.max("_differs").alias("_differs"), F.sum(F.col("_there").cast("long")).alias("_left"))
        files = self.work.save(self.files.join(after.hint("merge"), "_path"), "after")
        old, groups = coalesced(files, self.size, self.work)
        alive = rows.filter("_there").join(old.hint("merge"), "_path")
        place = numbered(alive, self.work, "alive", "_file", "_key", "_tie")
        at, wide = F.col("_at") - F.col("_before"), F.col("_extra") * (F.col("_base") + 1)
        piece = F.when(at < wide, F.floor(at / (F.col("_base") + 1))).otherwise(F.col("_extra") + F.floor((at - wide) / F.greatest("_base", F.lit(1))))
        write_files(place.withColumn("_out", F.col("_group") + piece), "_out", groups, ("_file", "_key", "_tie"), self.path)
        remove_files(files.filter("_differs").select("_path"))

    def written(self) -> DataFrame:
        """(path, rewritten, _key, _row, _tie) of all rows now in the folder."""
        now = self.spark.read.schema(self.schema).parquet(self.path)
        return now.select(*packed(now, self.key), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_tie"))


def pieces_of(files: DataFrame, size: int) -> DataFrame:
    """Kept files, and the pieces into which rewritten ones are cut, larger ones first."""
    n = F.ceil(F.col("_left") / size)
    cut = files.filter(F.col("_differs") & (F.col("_left") > 0)).withColumns({"_base": F.floor(F.col("_left") / n), "_extra": F.col("_left") % n})
    cut = cut.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    cut = cut.select("_file", "_path", "_piece", "_base", "_extra", (F.col("_base") + (F.col("_piece") < F.col("_extra")).cast("long")).alias("_size"))
    zero = F.lit(0).cast("long")
    kept = files.filter(~F.col("_differs")).select("_file", "_path", zero.alias("_piece"), zero.alias("_base"), zero.alias("_extra"), zero.alias("_size"))
    return cut.withColumn("_kept", zero).unionByName(kept.withColumn("_kept", F.lit(1).cast("long")))


def next_starts(pieces: DataFrame, size: int) -> DataFrame:
    """(_at, _to): where a group that begins at a piece ends and the next begins, in the same run."""
    sought = (F.col("_upto") - F.col("_size") + size).alias("_sought")
    asked = pieces.select("_at", "_run", sought).withColumn("_block", F.floor(F.col("_sought") / size))
    block = F.floor(F.col("_upto") / size)
    sums = pieces.select("_at", "_run", "_upto", F.explode(F.array(block, block - 1)).alias("_block"))  # the end sought is at most `size` further on

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("_upto")
        at = np.searchsorted(right["_upto"].to_numpy(), left["_sought"].to_numpy(), "right")
        found = at < len(right)
        left, at = left[found], at[found]
        same = right["_run"].to_numpy()[at] == left["_run"].to_numpy()
        return pd.DataFrame({"_at": left["_at"].to_numpy()[same], "_to": right["_at"].to_numpy()[at[same]]})

    return asked.groupBy("_block").cogroup(sums.groupBy("_block")).applyInPandas(search, "_at long, _to long")


def reached(first: DataFrame, jump: DataFrame, work: Workspace) -> DataFrame:
    """(_at): all places on the chains of pointers from `first`, by doubling the pointers."""
    turn = 0
    first, jump = work.save(first, "reach-0"), work.save(jump, "jump-0")
    while not jump.isEmpty():
        turn += 1
        more = first.join(jump.hint("merge"), "_at").select(F.col("_to").alias("_at"))
        far = jump.select("_at", F.col("_to").alias("_via")).join(jump.select(F.col("_at").alias("_via"), "_to").hint("merge"), "_via").select("_at", "_to")
        first, jump = work.save(first.unionByName(more), f"reach-{turn}"), work.save(far, f"jump-{turn}")
    return first


def coalesced(files: DataFrame, size: int, work: Workspace) -> tuple[DataFrame, int]:
    """For each rewritten file that keeps rows its first group and cut, and the number of groups."""
    pieces = numbered(pieces_of(files, size), work, "pieces", "_file", "_piece", _upto=F.col("_size"), _run=F.col("_kept"))
    pieces = work.save(pieces.filter("_kept = 0").drop("_kept"), "sums")
    starts = reached(pieces.groupBy("_run").agg(F.min("_at").alias("_at")).select("_at"), next_starts(pieces, size), work)
    marked = pieces.withColumnRenamed("_at", "_place").join(starts.select(F.col("_at").alias("_place"), F.lit(1).cast("long").alias("_begins")).hint("merge"), "_place", "left").fillna(0, ["_begins"])
    groups = numbered(marked, work, "groups", "_place", _group=F.col("_begins"))
    old = groups.filter("_piece = 0").select("_path", "_file", "_base", "_extra", (F.col("_upto") - F.col("_size")).alias("_before"), (F.col("_group") - 1).alias("_group"))
    return old, starts.count()


def remove_files(paths: DataFrame) -> None:
    """Deletes files from the tasks; what is gone already does not matter, so a task may run twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                scheme, _, rest = uri.partition(":")
                store, at = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{'//' + rest if scheme == 'file' and not rest.startswith('//') else rest}")
                head, _, name = at.rpartition("/")
                for one in (at, *([f"{head}/.{name}.crc"] if scheme == "file" else [])):
                    try:
                        store.delete_file(one)
                    except FileNotFoundError:
                        pass
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    paths.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def digests(rows: DataFrame) -> DataFrame:
    """Per file, from (_path, _tie, id, cents, crc): first_id, n_rows, sums, and the digest of its ids in file order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_path", "first_id", "n_rows", "cents", "rows_crc", "ids_sha256"]
        state = None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(names, ([x] for x in (*state[:5], state[5].hexdigest())), strict=True)), pa.schema([("_path", pa.string()), *((c, pa.int64()) for c in names[1:5]), ("ids_sha256", pa.string())]))

        for batch in batches:
            path, ids = batch.column("_path").to_pylist(), batch.column("id")
            cents, crc = batch.column("cents").to_numpy(zero_copy_only=False), batch.column("crc").to_numpy(zero_copy_only=False)
            cuts = [i for i in range(len(path)) if i == 0 or path[i] != path[i - 1]] + [len(path)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                part = ids.slice(low, high - low).to_pylist()
                text = ",".join("" if x is None else str(x) for x in part).encode()
                if state is None or state[0] != path[low]:
                    if state is not None:
                        yield closed()
                    state = [path[low], part[0], 0, 0, 0, hashlib.sha256()]
                else:
                    state[5].update(b",")
                state[5].update(text)
                state[2] += high - low
                state[3] += int(cents[low:high].sum())
                state[4] += int(crc[low:high].sum())
        if state is not None:
            yield closed()

    dealt = rows.repartitionByRange("_path").sortWithinPartitions("_path", "_tie")
    return dealt.mapInArrow(run, "_path string, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string")


def crc(value: Column) -> Column:
    return F.crc32(value.cast("string"))


def winners(changes: DataFrame) -> DataFrame:
    """The last change of each client: highest seq, then change_id."""
    best = F.max(F.struct("seq", "change_id", "op", *SET)).alias("_best")
    return changes.filter("client_id is not null").groupBy("client_id").agg(best).select("client_id", "_best.*")


RESULT = "first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string, columns string, path string, rewritten boolean"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, changes = read(spark, sf_dir, "clients"), read(spark, sf_dir, "client_changes")
    size = 1 + clients.count() // 1000
    folder = f"{base_dir(spark)}/op11-{uuid.uuid4().hex}"
    if not lay_out(clients.filter(crc(F.col("client_id")) % 7 > 3), "client_id", size, folder):
        return spark.createDataFrame([], RESULT)
    table = Folder(spark, folder, "client_id", size)
    due = table.homes(winners(changes)).withColumn("_h", crc(F.col("_from")) % 16).filter("_h <= 7")
    gone = F.coalesce(F.col("op") == "D", F.lit(False)) | F.coalesce(crc(F.col("change_id")) % 8 < F.col("_h"), F.lit(False))
    table.upsert(table.work.save(due.withColumn("_deleted", gone), "due"), "_deleted", SET)
    text = F.concat_ws("|", *[F.coalesce(F.col(f"_row.{c}"), F.lit("")) for c in ("source", "segment", "city")])
    cents = F.coalesce(F.floor(100 * F.col("_row.balance") + 0.5).cast("long"), F.lit(0).cast("long"))
    rows = table.written().select("_path", "_tie", F.col("_key").cast("long").alias("id"), cents.alias("cents"), F.crc32(text).alias("crc"))
    out = digests(rows).join(table.files.select("_path", F.lit(False).alias("_new")).hint("merge"), "_path", "left")
    columns = F.lit(",".join(table.columns)).alias("columns")
    return out.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", columns, F.regexp_replace("_path", "^file:/+", "/").alias("path"), F.coalesce("_new", F.lit(True)).alias("rewritten"))
