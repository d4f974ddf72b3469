"""A store of records, vectors, an inverted index and a registry: the calls and commands of the engine.

A store is a folder: `system/<table>` is read-only, `user/<table>` is a log of writes, a folder for each batch.
The last write of a key counts. A batch is written whole by Spark's commit protocol, and commands write in an order
that leaves a store usable if they stop half-way: vectors go before records, records are the last to be
removed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import records as rec
from ferrule.operators import embedding, index, maintenance, upkeep
from ferrule.sources import archive, layers, shared, snapshot

SCHEMAS = {
    "records": "uk string, theory string, kind int, name string, expr string, interpretation string, constituents array<string>, goal_patterns array<string>, persistent boolean",
    "vectors": "uk string, model string, q array<int>",
    "index": "uk string, part string",
    "registry": "theory string, name string, ts long",
}
KEYS = {"records": ["uk"], "vectors": ["uk", "model"], "index": ["uk", "part"], "registry": ["theory"]}


@dataclass
class Store:
    spark: SparkSession
    path: str

    def system(self, table: str) -> DataFrame:
        at = f"{self.path}/system/{table}"
        return self.spark.read.schema(SCHEMAS[table]).parquet(at) if snapshot.exists(self.spark, at) else self.spark.createDataFrame([], SCHEMAS[table])

    def user(self, table: str) -> DataFrame:
        """The last write of each key, with `deleted`; of a key's rows in one call the last one. A null there takes an entry back."""
        schema, at = f"{SCHEMAS[table]}, deleted boolean, seq long, place long", f"{self.path}/user/{table}"
        if not snapshot.exists(self.spark, at):
            return self.spark.createDataFrame([], schema).drop("seq", "place")
        log = self.spark.read.schema(schema).parquet(at)
        rest = [c for c in log.columns if c not in KEYS[table]]
        return log.groupBy(*KEYS[table]).agg(F.max_by(F.struct(*rest), F.struct("seq", "place")).alias("_r")).select(*KEYS[table], "_r.*").filter("deleted is not null").drop("seq", "place")

    def view(self, table: str) -> DataFrame:
        user, system = self.user(table), self.system(table)
        own = user.select(*(F.col(k).alias(f"_{k}") for k in KEYS[table]))
        same = F.lit(True)
        for k in KEYS[table]:
            same = same & system[k].eqNullSafe(own[f"_{k}"])
        return user.filter(~F.col("deleted")).drop("deleted").unionByName(system.join(own, same, "left_anti"))

    def append(self, table: str, rows: DataFrame, deleted: bool = False) -> None:
        have = {f.split(" ")[0] for f in SCHEMAS[table].replace(", ", ",").split(",")}
        names = [f.split(" ")[0] for f in SCHEMAS[table].split(", ")]
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        full = rows.select(*(F.col(c).cast(schema[c].dataType) if c in rows.columns and c in have else F.lit(None).cast(schema[c].dataType).alias(c) for c in names))
        full = full.withColumns({"deleted": F.lit(deleted), "seq": F.lit(time.time_ns()), "place": F.monotonically_increasing_id()})
        saved = shared.tables(self.spark, "append")(full, table)  # rows may depend on the log they are written to
        saved.write.mode("append").parquet(f"{self.path}/user/{table}")

    # records
    def put(self, rows: DataFrame) -> None:
        """Vectors of changed records go first, then the records."""
        self.drop_vectors(rows.select("uk"))
        self.append("records", rows)

    def get(self, keys: DataFrame) -> DataFrame:
        return layers.multi_get(keys, self.view("records"), "uk")

    def contains(self, keys: DataFrame) -> DataFrame:
        return layers.contains(keys, self.view("records"), "uk")

    def delete(self, keys: DataFrame) -> DataFrame:
        """(uk, was_visible); vectors and index entries go first."""
        found = shared.tables(self.spark, "delete")(layers.delete(self.view("records"), keys, "uk")[0].select("uk", "was_visible"), "keys")
        self.drop_vectors(found)
        self.append("index", self.view("index").join(found.select("uk"), "uk", "left_semi"), deleted=True)
        self.append("records", found.select("uk"), deleted=True)
        return found

    def backfill(self, field: str, entries: DataFrame) -> dict:
        rows, counts = layers.backfill(self.view("records"), entries, "uk", field)
        out = counts.first().asDict()
        self.append("records", rows)
        return out

    # vectors
    def models(self) -> list[str]:
        return [r[0] for r in layers.store_names(*(v.select(F.col("model").alias("name")) for v in (self.user("vectors"), self.system("vectors")))).collect()]  # a row for each model

    def drop_vectors(self, keys: DataFrame) -> None:
        """Tombstones in every model's vectors."""
        self.append("vectors", self.view("vectors").select("uk", "model").join(keys.select("uk").distinct(), "uk", "left_semi"), deleted=True)

    def documents(self) -> DataFrame:
        """(uk, text); null texts are not embedded."""
        label = F.concat_ws(" ", F.col("kind").cast("string"), F.concat("name", F.lit(":")), F.col("expr"))
        return self.view("records").select("uk", rec.document_text(F.col("kind"), label, F.col("interpretation"), F.col("goal_patterns")).alias("text"))

    def embed_missing(self, provider: str, keys: DataFrame | None = None, force: bool = False) -> dict:
        docs = self.documents() if keys is None else self.documents().join(keys.select("uk"), "uk", "left_semi")
        have = self.view("vectors").filter(F.col("model") == provider)
        new, counts = embedding.complete(docs, have.limit(0) if force else have, "uk", "text", provider)
        out = counts.first().asDict()
        self.append("vectors", new.withColumn("model", F.lit(provider)))
        return out

    def query_knn(self, queries: DataFrame, provider: str, k: int, kinds: Sequence[int] | None = None, loaded: Sequence[str] | None = None) -> DataFrame:
        """(query_id, uk, score, rank) over records of the kinds, and of experiences those whose constituents are all loaded; what has no vector gets one first."""
        rows = self.view("records")
        if kinds is not None:
            rows = rows.filter(F.col("kind").isin(*kinds))
        if loaded is not None:
            have = F.array(*map(F.lit, loaded)).cast("array<string>")
            rows = rows.filter((F.col("kind") != rec.EXPERIENCE) | (F.size(F.array_except("constituents", have)) == 0))
        domain = rows.select("uk").distinct()
        self.embed_missing(provider, domain)
        numbered = shared.tables(self.spark, "knn")(domain.orderBy("uk").withColumn("n", F.monotonically_increasing_id()), "keys")  # in the order of keys, for ties
        have = self.view("vectors").filter(F.col("model") == provider).join(numbered, "uk").select(F.col("n").alias("vec_id"), "q")
        asked = embedding.embed(queries.select("query_id", "text"), "text", provider).select(F.col("query_id").alias("vec_id"), "q")
        from ferrule.operators.relational import top_k

        hits = top_k(have, asked, k)
        return hits.join(numbered.withColumnRenamed("n", "vec_id"), "vec_id").select("query_id", "uk", "score", "rank")

    # commands
    def status(self) -> dict:
        """Rows of each table and layer."""
        return {t: {"user": self.user(t).filter("not deleted").count(), "tombstones": self.user(t).filter("deleted").count(), "system": self.system(t).count()} for t in SCHEMAS}

    def list(self) -> DataFrame:
        """(theory, name, n) of visible records; unnamed ones show their hash."""
        counts = self.view("records").groupBy("theory").agg(F.count("*").alias("n"))
        return counts.join(self.view("registry").select("theory", "name"), "theory", "left").withColumn("name", F.coalesce("name", F.lit("?"))).orderBy(F.coalesce("name", "theory"), "theory")

    def resolve(self, identifiers: Sequence[str]) -> list[str]:
        """Hashes of theories by exact name, else by the start of one hash; an error where none or several fit."""
        asked = self.spark.createDataFrame([(x,) for x in identifiers], "asked string")
        found = maintenance.resolve(self.view("registry").select("name", F.col("theory").alias("hex")), asked).collect()  # a row for each identifier
        wrong = sorted(f"{r['asked']}: {r['state']}" for r in found if r["hex"] is None)
        if wrong:
            raise ValueError("; ".join(wrong))
        return [r["hex"] for r in found]

    def remove(self, identifiers: Sequence[str], dry: bool = False) -> int:
        theories = self.resolve(identifiers)
        chosen = F.array(*map(F.lit, theories))
        keys = self.view("records").filter(rec.belongs(F.col("theory"), F.col("constituents"), chosen)).select("uk")
        return keys.count() if dry else self.delete(keys).count()

    def generations(self, keep: int) -> DataFrame:
        """(theory, name, doomed): theories that have records, the newest of each name first."""
        have = self.view("registry").join(self.view("records").select("theory").distinct(), "theory", "left_semi")
        return upkeep.prune_plan(have, "name", [F.desc("ts"), F.asc("theory")], keep).select("theory", "name", "doomed")

    def prune(self, keep: int, dry: bool = True) -> int:
        """Records of all but the newest generations; experiences stay."""
        doomed = self.generations(keep).filter("doomed").select("theory")
        keys = self.view("records").filter(F.col("kind") != rec.EXPERIENCE).join(doomed, "theory", "left_semi").select("uk")
        return keys.count() if dry else self.delete(keys).count()

    def reindex(self) -> int:
        """The index from all experiences: entries that none has go, missing ones come."""
        want = index.build(self.view("records").filter(F.col("kind") == rec.EXPERIENCE), "uk", "constituents")
        have, pair = self.view("index"), lambda a, b: a["uk"].eqNullSafe(b["uk"]) & a["part"].eqNullSafe(b["part"])
        self.append("index", have.join(want, pair(have, want), "left_anti"), deleted=True)
        self.append("index", want)
        return want.count()

    def fsck(self, fix: bool = False) -> dict:
        live = self.view("records").select("uk")
        experiences = self.view("records").filter((F.col("kind") == rec.EXPERIENCE) & F.col("constituents").isNotNull()).select("uk")
        report = {r["fact"]: r["n"] for r in upkeep.store_check(live, self.view("vectors").select("uk"), self.view("index").select("uk").distinct(), "uk").collect() if r["fact"] in ("records", "orphan vectors")}
        report |= {r["state"]: r["count"] for r in index.reconcile(self.view("index"), experiences, "uk").groupBy("state").count().collect()}
        if fix:
            self.reindex()
            self.drop_vectors(self.view("vectors").select("uk").join(live, "uk", "left_anti"))
        return report

    def clean_unfinished(self) -> int:
        """Records that aren't persistent go, with their vectors and index entries."""
        return self.delete(self.view("records").filter(~F.coalesce("persistent", F.lit(True))).select("uk")).count()

    def purge_experiences(self) -> None:
        self.drop_vectors(self.view("records").filter(F.col("kind") == rec.EXPERIENCE))

    def put_experience(self, rows: DataFrame, provider: str) -> None:
        """Record, index, vector, in this order; deleting goes the other way round."""
        self.put(rows)
        self.append("index", index.build(rows, "uk", "constituents"))
        self.embed_missing(provider, rows)

    def export(self, path: str) -> dict:
        """A snapshot of what is visible and persistent; theories without a name stop it."""
        kept = self.view("records").filter(F.coalesce("persistent", F.lit(True)))
        gap = maintenance.registry_gaps(kept.filter("theory is not null"), "theory", self.view("registry"))
        tables = {t: self.view(t) if t == "registry" else self.view(t).join(kept.select("uk"), "uk", "left_semi") for t in SCHEMAS}
        return snapshot.export(self.spark, tables, path, {"theories without a name": gap})

    def pull(self, payload: str, force: bool = False) -> bool:
        """Installs a snapshot as the system layer, then drops vectors of no record."""
        new = snapshot.install(self.spark, payload, f"{self.path}/system", force)
        if new:
            self.drop_vectors(self.user("vectors").filter("not deleted").select("uk").join(self.view("records").select("uk"), "uk", "left_anti"))
        return new

    def pull_channel(self, channel: str, package: str, prefix: str, force: bool = False) -> bool:
        """Installs the newest build of a package."""
        return self.pull(archive.fetch(self.spark, channel, package, f"{self.path}/downloads", prefix)[0], force)

    def dump_keys(self, path: str) -> None:
        self.view("records").select("uk").write.mode("overwrite").json(path)


def main(argv: Sequence[str], spark: SparkSession) -> str:
    """`python -m ferrule STORE COMMAND [ARGUMENT...]`: status, list, remove, prune, orphans, reindex, fsck, embed, pull, export, fetch, pack, unpack."""
    path, command, *rest = argv
    store = Store(spark, path)
    flags, args = {x for x in rest if x.startswith("--")}, [x for x in rest if not x.startswith("--")]
    if command == "list":
        return "\n".join(f"{r['name']} {r['theory']} {r['n']}" for r in store.list().toLocalIterator())
    if command == "orphans":
        members = store.view("records").select("uk", F.explode_outer("constituents").alias("theory"))
        return "\n".join(f"{r['theory']} {r['n']} {r['samples']}" for r in maintenance.orphan_groups(members, "uk", "theory", store.view("registry")).orderBy(F.desc("n")).toLocalIterator())
    commands = {
        "status": store.status, "reindex": store.reindex, "fsck": lambda: store.fsck("--fix" in flags), "remove": lambda: store.remove(args, "--dry-run" in flags), "prune": lambda: store.prune(int(args[0]), "--apply" not in flags),
        "embed": lambda: store.embed_missing(args[0], force="--force" in flags), "export": lambda: store.export(args[0]), "pull": lambda: store.pull(args[0], "--force" in flags),
        "fetch": lambda: store.pull_channel(*args, force="--force" in flags), "pack": lambda: archive.pack(spark, *args), "unpack": lambda: archive.unpack(spark, *args),
    }
    if command not in commands:
        raise SystemExit(f"unknown command: {command}")
    return json.dumps(commands[command]())
