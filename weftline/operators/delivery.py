"""Messages delivered more than once: keep exactly one copy of each.

Identifiers are encoded exactly by a dictionary that grows with the batches: the code of an identifier is the dictionary
part that brought it, numbered by its version, and its place there. Codes fall into containers of 65,536 consecutive places of a part, and each
container has a compressed bitmap of the codes seen, so new parts bring new containers and none ever grows. A batch is
reduced to its first arrivals in chunks of each task before anything is shuffled, so an identifier that holds a third of
all rows costs one row a chunk. First its unknown identifiers are published in the dictionary; then the earliest
arrival of every code whose bit is unset is taken, and the new bits are united with the old ones. Both steps become
visible by the rename of a manifest that must not exist yet: a committer that comes second starts again from the other's
state, and a batch that died between the steps finds its codes there with their bits still unset.

A manifest also names the batch and the rows it took. A batch that is run again, because its result was lost, is answered
with the same rows.

Defined results: letter case and surrounding white space (Unicode) of id and kind do not count. A row whose id is
null, empty or blank takes the id that rows with the same run_id and kind carry (of several the smallest); if none
does, the rows of that run_id and kind without an id are one message. A null run_id or kind equals another null. An
empty table gives no rows. Other columns are ignored. The smallest seq of a message is the copy that is kept; seq
names a stored row, so rows of one seq are one row. Of a message whose rows all have a null seq any one row is kept, and
rows with a null seq cannot be reported.

Over batches the same holds against all rows seen so far: rows without an id take the smallest id that this or an earlier
batch has for their run_id and kind, and the first id that comes after a row without one was kept is that row's message.
What was returned is not taken back: if two such rows of different run_id or kind turn out to carry one id, both stay.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.columns import stripped
from weftline.session import cut_lineage, shared_folder

CHUNK_ROWS = 200_000
MOST_PARTS = 32
#: The batches in which a whole table is taken, in order of arrival.
BATCHES = 2
CONTAINER_BITS = 16
CONTAINER = 1 << CONTAINER_BITS
#: A batch whose keys take no more is broadcast to the dictionary, which then stays where it is.
BROADCAST_BYTES = 4 << 20
#: Stands for the seq of a copy that was returned before; it comes before all others.
RETURNED = -(1 << 63)
KEY_SCHEMA = "key BINARY, part INT, place BIGINT"
NAME_SCHEMA = "run_id STRING, kind STRING, key BINARY, at BIGINT, changed BOOLEAN"
TAKEN_SCHEMA = "seq BIGINT, part INT, container BIGINT, bits BINARY"


def _identifier(text: Column) -> Column:
    """Exact binary form: a 64-digit hexadecimal text takes 33 bytes, any other its UTF-8 bytes and a mark."""
    clean = F.lower(stripped(text))
    packed = F.when(
        clean.rlike("^[0-9a-f]{64}$"), F.concat(F.unhex(F.lit("01")), F.unhex(clean))
    ).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(clean, "UTF-8")))
    return F.when(clean != "", packed)


def _rows(events: DataFrame) -> DataFrame:
    """(seq, key, run_id, kind) with a null key where a row has no id."""
    return events.select(
        "seq",
        _identifier(F.col("id")).alias("key"),
        F.coalesce("run_id", F.lit("\x00")).alias("run_id"),
        F.coalesce(F.lower(stripped(F.col("kind"))), F.lit("\x00")).alias("kind"),
    )


def _own() -> Column:
    """The key of rows without an id if no row of their run_id and kind has one."""
    return F.concat(F.unhex(F.lit("02")), F.encode(F.concat_ws(":", F.length("run_id"), "run_id", "kind"), "UTF-8"))


def named_pairs(events: DataFrame, names: DataFrame) -> DataFrame:
    """(run_id, kind, before, named, key, nameless, seq) of each run_id and kind of a batch: its key in names (run_id, kind,
    key), the batch's smallest id, the key from now on, whether rows have no id and the first of these."""
    missing = F.col("key").isNull()
    here = _rows(events).groupBy("run_id", "kind").agg(
        F.min("key").alias("named"), F.max(missing).alias("nameless"), F.min(F.when(missing, F.col("seq"))).alias("seq")
    )
    known = F.when(~_waits(), F.col("before"))
    key = F.coalesce(F.least(known, "named"), "before", _own())
    return here.join(names.withColumnRenamed("key", "before"), ["run_id", "kind"], "left").withColumn("key", key)


def _waits() -> Column:
    """A row without an id was kept before, and no id has come for it yet."""
    return F.coalesce(F.substring("before", 1, 1) == F.unhex(F.lit("02")), F.lit(False))


def batch_keys(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, seq) of the rows that carry an id and of the first row without one of each run_id and kind, by the keys of
    named_pairs, and RETURNED where an id came for a row that was kept without one."""
    named = _rows(events).where(F.col("key").isNotNull()).select("key", "seq")
    came = pairs.where(_waits() & F.col("named").isNotNull()).select("key", F.lit(RETURNED).cast("bigint").alias("seq"))
    return named.unionByName(pairs.where("nameless").select("key", "seq")).unionByName(came)


class Behind(Exception):
    """Another committer was faster."""


@dataclass(frozen=True)
class SeenState:
    """Dictionary, names and seen-bitmaps below a path.

    All three grow by appended parts: identifiers a batch brought (key, place), the key of each run_id and kind (of several
    the newest holds), and bits to unite. After MOST_PARTS of a kind one part with all of them takes their place.
    manifest/<version>.json names the parts; the greatest version is the state.
    """

    path: str

    def _fs(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read_json(self, spark: SparkSession, name: str) -> dict | None:
        path, fs = self._fs(spark)
        if not fs.exists(path(name)):
            return None
        stream = fs.open(path(name))
        try:
            return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_json(self, spark: SparkSession, name: str, value: dict) -> None:
        path, fs = self._fs(spark)
        stream = fs.create(path(name), True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def manifest(self, spark: SparkSession, version: int | None = None) -> dict:
        path, fs = self._fs(spark)
        if version is None:
            folder = path(f"{self.path}/manifest")
            names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
            version = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)
        found = self._read_json(spark, f"{self.path}/manifest/{version}.json") if version else None
        return found or {"version": 0, "keys": [], "names": [], "seen": [], "batch": None, "taken": None}

    def commit(self, spark: SparkSession, found: dict, **changes) -> dict:
        """The next manifest after found; Behind if there is one already."""
        made = {**found, "batch": None, "taken": None, **changes, "version": found["version"] + 1}
        path, fs = self._fs(spark)
        fs.mkdirs(path(f"{self.path}/manifest"))
        draft = f"{self.path}/manifest/{uuid.uuid4().hex}.draft"
        self._write_json(spark, draft, made)
        jvm = spark.sparkContext._jvm
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(self.path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(path(draft), path(f"{self.path}/manifest/{made['version']}.json"), options)
        except Exception as error:
            fs.delete(path(draft), False)
            if "FileAlreadyExists" in str(error):
                raise Behind from error
            raise
        return made

    def keys(self, spark: SparkSession, found: dict) -> DataFrame:
        """(key, part, place): the dictionary."""
        if not found["keys"]:
            return spark.createDataFrame([], KEY_SCHEMA)
        return spark.read.schema(KEY_SCHEMA).parquet(*[f"{self.path}/{p}" for p in found["keys"]])

    def _newest(self, spark: SparkSession, parts: list) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], NAME_SCHEMA)
        rows = spark.read.schema(NAME_SCHEMA).parquet(*[f"{self.path}/{p}" for p in parts]).where("changed")
        newest = rows.groupBy("run_id", "kind").agg(F.max(F.struct("at", "key")).alias("n"))
        return newest.select("run_id", "kind", "n.key", "n.at", F.lit(True).alias("changed"))

    def names(self, spark: SparkSession, found: dict) -> DataFrame:
        """(run_id, kind, key) of all rows so far."""
        return self._newest(spark, found["names"]).drop("at", "changed")

    def seen(self, spark: SparkSession, found: dict) -> DataFrame:
        """(part, container, bits): pieces of bitmaps, of which a container may have several to be united."""
        if not found["seen"]:
            return spark.createDataFrame([], "part INT, container BIGINT, bits BINARY")
        rows = spark.read.schema(TAKEN_SCHEMA).parquet(*[f"{self.path}/{p}" for p in found["seen"]])
        return rows.where(F.col("bits").isNotNull()).select("part", "container", "bits")

    def taken(self, spark: SparkSession, batch: str) -> DataFrame | None:
        """(seq) of the rows a committed batch took; None if it was not committed."""
        hint = self._read_json(spark, f"{self.path}/batch/{batch}.json")
        made = self.manifest(spark, hint["version"]) if hint else None
        return self._taken(spark, made["taken"]) if made and made["batch"] == batch else None

    def _taken(self, spark: SparkSession, *folders: str) -> DataFrame:
        rows = spark.read.schema(TAKEN_SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])
        return rows.where(F.col("seq").isNotNull()).select("seq")

    def encode(self, spark: SparkSession, found: dict, arrivals: DataFrame, few: bool = False) -> dict:
        """Publish the identifiers of arrivals (key) that the dictionary does not have; few of them are broadcast to it."""
        folder, part = f"keys/{uuid.uuid4().hex}", F.lit(found["version"] + 1).alias("part")
        keys, known = arrivals.select("key").distinct(), self.keys(spark, found).select("key")
        fresh = keys.join(known.join(F.broadcast(keys), "key", "left_semi") if few else known, "key", "left_anti")
        fresh.select("key", part, F.monotonically_increasing_id().alias("place")).write.parquet(f"{self.path}/{folder}")
        parts = [*found["keys"], folder]
        if len(parts) > MOST_PARTS:
            whole = f"keys/{uuid.uuid4().hex}"
            self.keys(spark, {"keys": parts}).write.parquet(f"{self.path}/{whole}")
            parts = [whole]
        return self.commit(spark, found, keys=parts)

    def name(self, spark: SparkSession, found: dict, pairs: DataFrame) -> tuple[str, DataFrame]:
        """Write named_pairs of a batch, which is its part of the names too, and give the part and what it holds."""
        folder = f"names/{uuid.uuid4().hex}"
        at, changed = F.lit(found["version"]).cast("bigint").alias("at"), (~F.col("key").eqNullSafe(F.col("before"))).alias("changed")
        pairs = pairs.select("*", at, changed)
        pairs.write.parquet(f"{self.path}/{folder}")
        return folder, spark.read.schema(pairs.schema).parquet(f"{self.path}/{folder}")

    def unite(self, spark: SparkSession, found: dict, batch: str, taken: DataFrame, names: str) -> DataFrame:
        """Commit what a batch took, (seq, part, container, bits), and its part of the names."""
        folder = f"seen/{uuid.uuid4().hex}"
        taken.write.parquet(f"{self.path}/{folder}")
        parts = {"seen": [*found["seen"], folder], "names": [*found["names"], names]}
        if len(parts["seen"]) > MOST_PARTS:
            every, parts = parts, {kind: [f"{kind}/{uuid.uuid4().hex}"] for kind in parts}
            united = self.seen(spark, every).groupBy("part", "container").applyInPandas(_united, TAKEN_SCHEMA)
            united.write.parquet(f"{self.path}/{parts['seen'][0]}")
            self._newest(spark, every["names"]).write.parquet(f"{self.path}/{parts['names'][0]}")
        # Where to look for the batch; it counts only if the manifest of that version is the batch's.
        self._write_json(spark, f"{self.path}/batch/{batch}.json", {"version": found["version"] + 1})
        self.commit(spark, found, **parts, batch=batch, taken=folder)
        return self._taken(spark, folder)


def packed(seen: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(seen).tobytes(), 1)


def unpacked(pieces: list[bytes]) -> np.ndarray:
    """The union of a container's pieces."""
    seen = np.zeros(CONTAINER // 8, dtype=np.uint8)
    for piece in pieces:
        seen |= np.frombuffer(zlib.decompress(piece), dtype=np.uint8)
    return np.unpackbits(seen).astype(bool)


def take_unseen(slots: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which arrivals of one container, given by their bits in order of arrival, are the first of an unset bit."""
    first = np.zeros(len(slots), dtype=bool)
    first[np.unique(slots, return_index=True)[1]] = True
    return first & ~seen[slots]


def _united(pieces: pd.DataFrame) -> pd.DataFrame:
    bits = packed(unpacked([bytes(b) for b in pieces["bits"]]))
    out = pd.DataFrame({"seq": [None], "part": pieces["part"].iloc[:1], "container": pieces["container"].iloc[:1], "bits": [bits]})
    return out.astype({"seq": "Int64"})


def first_of_chunks(arrivals: DataFrame, keys: list[str]) -> DataFrame:
    """Arrivals (keys..., seq) reduced to the first of each key in each chunk of a task."""

    def first(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        one = pa.Table.from_batches(rows).group_by(keys).aggregate([("seq", "min")])
        return one.select([*keys, "seq_min"]).rename_columns([*keys, "seq"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK_ROWS:
                yield from first(held)
                held, size = [], 0
        if held:
            yield from first(held)

    chosen = arrivals.select(*keys, "seq")
    return chosen.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema))


def unseen_arrivals(arrivals: DataFrame, dictionary: DataFrame, seen: DataFrame) -> DataFrame:
    """Of arrivals (key, seq): a row (seq) for each copy to keep, and a row (part, container, bits) for each container
    with new bits. dictionary has (key, part, place) of all their keys, seen the bits so far (part, container, bits)."""
    coded = first_of_chunks(arrivals.join(dictionary, "key").select("part", "place", "seq"), ["part", "place"])
    placed = coded.withColumn("container", F.shiftright("place", CONTAINER_BITS))

    def step(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        new = new.sort_values("seq")
        slots, seq = (new["place"] % CONTAINER).to_numpy(), new["seq"].to_numpy()
        take = take_unseen(slots, unpacked([bytes(b) for b in old["bits"]]))
        bits = np.zeros(CONTAINER, dtype=bool)
        bits[slots[take]] = True
        kept = seq[take & (seq != RETURNED)]
        rows = [(int(s), None, None, None) for s in kept] + ([(None, *key, packed(bits))] if take.any() else [])
        out = pd.DataFrame(rows, columns=["seq", "part", "container", "bits"], dtype=object)
        return out.astype({"seq": "Int64", "part": "Int32", "container": "Int64"})

    container = ["part", "container"]
    return placed.groupBy(*container).cogroup(seen.groupBy(*container)).applyInPandas(step, TAKEN_SCHEMA)


def select_batch(events: DataFrame, state: SeenState, batch_id: str | None = None) -> DataFrame:
    """(seq) of the first arrivals of a batch against everything seen before; the state has them when this returns.

    A batch_id that was committed before gives the rows it gave then. Without one the batch is a new one. Rows with a null
    seq are passed over.
    """
    spark = events.sparkSession
    batch = hashlib.sha256((batch_id or uuid.uuid4().hex).encode()).hexdigest()
    events = events.where(F.col("seq").isNotNull())
    while (taken := state.taken(spark, batch)) is None:
        found = state.manifest(spark)
        names, pairs = state.name(spark, found, named_pairs(events, state.names(spark, found)))
        arrivals = cut_lineage(first_of_chunks(batch_keys(events, pairs), ["key"]))
        few = (arrivals.agg(F.sum(F.octet_length("key") + 16)).first()[0] or 0) <= BROADCAST_BYTES
        try:
            found = state.encode(spark, found, arrivals, few)
            result = unseen_arrivals(F.broadcast(arrivals) if few else arrivals, state.keys(spark, found), state.seen(spark, found))
            return state.unite(spark, found, batch, result, names)
        except Behind:
            continue
    return taken


def deduplicate_batch(events: DataFrame, state: SeenState, batch_id: str | None = None) -> DataFrame:
    """The rows of select_batch with all columns."""
    return _kept(events, select_batch(events, state, batch_id))


def _kept(events: DataFrame, kept: DataFrame) -> DataFrame:
    # Both steps need the rows of a seq together, so they share one shuffle.
    return events.join(kept, "seq", "left_semi").dropDuplicates(["seq"])


def select_all(events: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, SeenState]:
    """(seq) of the copies to keep of a whole table, taken in batches of about equal size in order of seq, and the state."""
    spark = events.sparkSession
    state = SeenState(shared_folder(spark, "seen"))
    shares = [i / batches for i in range(1, batches)]
    bounds = (events.agg(F.percentile_approx("seq", shares, 1000)).first()[0] if shares else None) or []
    edges = [None, *sorted(set(bounds)), None]
    kept = spark.createDataFrame([], "seq BIGINT")
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        part = events if low is None else events.where(F.col("seq") > low)
        kept = kept.unionByName(select_batch(part if high is None else part.where(F.col("seq") <= high), state, str(i)))
    return kept, state


def repeated_rows(events: DataFrame) -> DataFrame:
    """(seq) of every row but the first of its message."""
    kept, _ = select_all(events)
    return events.select("seq").where(F.col("seq").isNotNull()).join(kept, "seq", "left_anti").distinct()


def kept_rows(events: DataFrame) -> DataFrame:
    """The one copy of each message, with all columns."""
    kept, state = select_all(events)
    rows = _kept(events, kept)
    unplaced = events.where(F.col("seq").isNull())
    if unplaced.isEmpty():
        return rows
    # Rows without a seq: one of each message that no other row belongs to.
    spark = events.sparkSession
    pairs = named_pairs(events, spark.createDataFrame([], "run_id STRING, kind STRING, key BINARY")).select("run_id", "kind", F.col("key").alias("_known"))
    own = {"run_id": F.coalesce("run_id", F.lit("\x00")), "kind": F.coalesce(F.lower(stripped(F.col("kind"))), F.lit("\x00"))}
    keyed = unplaced.select(F.struct(*unplaced.columns).alias("_row"), _identifier(F.col("id")).alias("_own"), *[e.alias(c) for c, e in own.items()])
    keyed = keyed.join(pairs, ["run_id", "kind"]).withColumn("key", F.coalesce("_own", "_known"))
    # After the last batch the dictionary has every key that came with a seq.
    fresh = keyed.join(state.keys(spark, state.manifest(spark)), "key", "left_anti").dropDuplicates(["key"])
    return rows.unionByName(fresh.select("_row.*"))
