"""A log in a folder: month-partitioned Parquet, one writer at a time, append-only unless an administrator.

Everything goes through the Hadoop file system of the path, so the folder may be in any store
that Spark reads. Every write goes to folders of its own, which nobody reads until a manifest
names them; a manifest is a small numbered file that is made once and never changed. So a commit
happens whole or not at all: rows, the number of the last id, the chain's tip and the streams'
places go together, and what a crash leaves behind is not part of the log. Contexts are committed with the events that
have them. A purge writes what it keeps of the cutoff's month beside the old rows, and what a
later check needs to know of those that go, and then commits a manifest without them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from ..context import current_context
from ..functions.intervals import cutoff, month_bounds
from ..operators import blame as blame_ops, chain, contexts as context_ops, keyframes, retention, timetravel, tree
from ..operators.capture import capture_cdc, with_ids
from ..operators.history import History
from ..plans.months import MONTH, before, moment_column, since, utc, with_month
from ..schema import AUDIT_LOG, CONTEXT
from ..spec import Capture
from . import fileindex
from .folders import fresh_folder
from .importers import conform

FORMAT_VERSION, BATCH = 3, "batch"
#: Seconds after which a lock that its owner has not given back may be taken over.
LOCK_SECONDS = 6 * 3600
#: Older manifests that are kept.
OLD_MANIFESTS = 20
EMPTY = {"number": 0, "parts": [], "last_id": 0, "tip": None, "chain_from": None, "anchor": None, "streams": {}, "gaps": [], "contexts": [], "context_seq": 0, "tree": None, "tree_nodes": [], "tree_gone": [], "keyframes": [], "index": None}


class Locked(RuntimeError):
    pass


def _batch_name(now: dict[str, Any]) -> str:
    """A batch's name begins with the number of its commit."""
    return f"{now['number'] + 1:012d}-{uuid.uuid4().hex}"


def commit_of(batch: str) -> int:
    """The commit of a batch; 0 for batches of older formats."""
    number, _, rest = batch.partition("-")
    return int(number) if rest and number.isdigit() else 0


class Engine:
    """``hash_chain=True`` switches the log's chain on, ``history_tree=True`` its tree of digests,
    ``indexed=True`` its index of files; that is kept with the log and holds for every later writer."""

    def __init__(self, spark: SparkSession, path: str, admin: bool = False, hash_chain: bool = False, history_tree: bool = False, indexed: bool = False):
        self._index_wanted = indexed
        self.spark, self.path, self.admin, self._chain_wanted, self._tree_wanted = spark, path.rstrip("/"), admin, hash_chain, history_tree
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Files

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _exists(self, *parts: str) -> bool:
        return self._fs.exists(self._at(*parts))

    def _put(self, name: str, text: str, overwrite: bool = True) -> None:
        out = self._fs.create(self._at(name), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def _get(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._exists(folder) else []

    @contextmanager
    def lock(self, name: str = "writer") -> Iterator[None]:
        """Made exclusively; a second writer fails at once instead of waiting. The file says whose
        lock it is and until when, so that one left by a crash can be taken over after that."""
        file, owner = f"_{name}.lock", uuid.uuid4().hex
        note = json.dumps({"owner": owner, "until": time.time() + LOCK_SECONDS})
        try:
            self._put(file, note, overwrite=False)
        except Exception as why:
            if not self._lock_is_old(file):
                raise Locked(f"another writer holds {name}") from why
            self._fs.delete(self._at(file), False)
            try:
                self._put(file, note, overwrite=False)
            except Exception as again:
                raise Locked(f"another writer holds {name}") from again
        try:
            yield
        finally:
            if self._exists(file) and owner in self._get(file):
                self._fs.delete(self._at(file), False)

    def _lock_is_old(self, file: str) -> bool:
        try:
            return json.loads(self._get(file))["until"] < time.time()
        except Exception:  # noqa: BLE001 - being written, or gone
            return False

    # Manifests

    def _manifest_numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict[str, Any]:
        """What is committed."""
        numbers = self._manifest_numbers()
        return EMPTY | json.loads(self._get(f"manifests/{numbers[-1]:012d}.json")) if numbers else dict(EMPTY)

    def _commit(self, now: dict[str, Any], **changes: Any) -> None:
        """The manifest after ``now``. Its file must not exist: of two writers one fails."""
        number = now["number"] + 1
        self._put(f"manifests/{number:012d}.json", json.dumps(now | changes | {"number": number}, default=str), overwrite=False)
        for old in self._manifest_numbers()[:-OLD_MANIFESTS]:
            self._fs.delete(self._at(f"manifests/{old:012d}.json"), False)

    # Set-up

    def bootstrap(self) -> None:
        """Makes the folder's tables; again and again without harm."""
        for name in ("log", "contexts", "registry", "manifests"):
            self._fs.mkdirs(self._at(name))
        if not self._exists("_version.json"):
            self._put("_version.json", json.dumps({"format": FORMAT_VERSION}))
        if self._chain_wanted:
            self.enable_chain()
        if self._tree_wanted:
            self.enable_tree()
        if self._index_wanted:
            self.enable_index()

    def version(self) -> int:
        return int(json.loads(self._get("_version.json"))["format"]) if self._exists("_version.json") else 0

    def upgrade(self) -> list[str]:
        """Brings an older folder to today's format; gives the steps taken. Folders of format 1 had
        months without batches: their files move into a batch of their own, then are committed.
        Those of format 2 had contexts that no manifest named."""
        steps, version = [], self.version()
        if version == 1:
            with self.lock():
                parts = []
                for folder in (n for n in self._names("log") if n.startswith(f"{MONTH}=")):
                    files = [n for n in self._names(f"log/{folder}") if n.endswith(".parquet")]
                    self._fs.mkdirs(self._at("log", folder, f"{BATCH}=format1"))
                    for name in files:
                        self._fs.rename(self._at("log", folder, name), self._at("log", folder, f"{BATCH}=format1", name))
                    parts.append([folder.split("=", 1)[1], "format1"])
                self._fs.mkdirs(self._at("manifests"))
                rows = self._read(parts)
                tip = chain.chain_tip(rows).collect() if parts else []
                first = rows.where("row_hash is not null").agg(F.min("id")).first()[0] if parts else None
                last = rows.agg(F.max("id")).first()[0] if parts else 0
                self._commit(dict(EMPTY), parts=parts, last_id=last or 0, tip=tip[0].asDict() if tip else None, chain_from=first)
            steps.append("batches and manifests")
        if version in (1, 2):
            with self.lock():
                files = [n for n in self._names("contexts") if n.endswith(".parquet")]
                if files:
                    self._fs.mkdirs(self._at("contexts", "format2"))
                    for name in files:
                        self._fs.rename(self._at("contexts", name), self._at("contexts", "format2", name))
                    seq = self.spark.read.schema(CONTEXT).parquet(f"{self.path}/contexts/format2").agg(F.max("seq")).first()[0]
                    self._commit(self.manifest(), contexts=["format2"], context_seq=seq or 0)
                    steps.append("contexts")
        if version < FORMAT_VERSION:
            self.bootstrap()
            self._put("_version.json", json.dumps({"format": FORMAT_VERSION}))
            steps.append("tables")
        return steps

    def enable_chain(self) -> None:
        """Chains every row from here on, whoever writes it; it cannot be switched off."""
        now = self.manifest()
        if now["chain_from"] is None:
            with self.lock():
                now = self.manifest()
                if now["chain_from"] is None:
                    self._commit(now, chain_from=now["last_id"] + 1)

    def enable_tree(self) -> None:
        """Puts every row from here on into the history tree, whoever writes it."""
        if self.manifest()["tree"] is None:
            with self.lock():
                now = self.manifest()
                if now["tree"] is None:
                    self._commit(now, tree={"first": now["last_id"] + 1, "size": 0, "peaks": []})

    def enable_index(self) -> None:
        """Indexes the log's files, and those of every later commit."""
        if self.manifest()["index"] is None:
            with self.lock():
                now = self.manifest()
                if now["index"] is None:
                    self._commit(now, index=self._indexed([], now["parts"]))

    def _indexed(self, names: list[str], parts: list[list[str]]) -> list[str]:
        """The index with the files of more parts."""
        if not parts:
            return names
        name, rows = uuid.uuid4().hex, self._read(parts)
        fileindex.object_ranges(rows).coalesce(1).write.parquet(f"{self.path}/ranges/{name}")
        fileindex.value_files(rows).write.parquet(f"{self.path}/values/{name}")
        return [*names, name]

    @property
    def hash_chain(self) -> bool:
        return self._chain_wanted or self.manifest()["chain_from"] is not None

    # Reading

    def _read(self, parts: list[list[str]], batches: bool = False) -> DataFrame:
        rows = self._read_paths([f"{self.path}/log/{MONTH}={month}/{BATCH}={batch}" for month, batch in parts])
        return rows if batches else rows.drop(BATCH)

    def _read_paths(self, paths: list[str]) -> DataFrame:
        if not paths:
            return with_month(self.spark.createDataFrame([], AUDIT_LOG))
        schema = StructType([*AUDIT_LOG.fields, StructField(MONTH, StringType()), StructField(BATCH, StringType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/log").parquet(*paths)

    @property
    def log(self) -> DataFrame:
        return self._read(self.manifest()["parts"])

    @property
    def context_versions(self) -> DataFrame:
        return self._parts("contexts", self.manifest()["contexts"], CONTEXT)

    def _parts(self, folder: str, names: list[str], schema: StructType | str) -> DataFrame:
        """The folders of one kind that a manifest names."""
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}/{n}" for n in names])

    @property
    def contexts(self) -> DataFrame:
        return context_ops.resolve(self.context_versions)

    def history(self) -> History:
        return History(self.log)

    def for_object(self, table: str, pk: Any) -> History:
        return self._in_files("ranges", fileindex.RANGES, lambda x: fileindex.with_object(x, table, str(pk))).for_object(table, pk)

    def for_user(self, user_id: int | None) -> History:
        if user_id is None:
            return self.history().for_user(None)
        return self._in_files("values", fileindex.KEYS, lambda x: fileindex.with_value(x, "user", str(int(user_id)))).for_user(user_id)

    def for_context(self, context_id: Any) -> History:
        return self._in_files("values", fileindex.KEYS, lambda x: fileindex.with_value(x, "context", str(context_id))).for_context(context_id)

    def _in_files(self, folder: str, schema: str, find: Callable[[DataFrame], DataFrame]) -> History:
        """The log's rows in the files that an index names; all of it without an index."""
        now = self.manifest()
        if now["index"] is None:
            return History(self._read(now["parts"]))
        found = find(self._parts(folder, now["index"], schema)).distinct().limit(fileindex.MOST_FILES + 1).collect()
        if len(found) > fileindex.MOST_FILES:
            return History(self._read(now["parts"]))
        live = {f"{MONTH}={m}/{BATCH}={b}" for m, b in now["parts"]}
        return History(self._read_paths([f"{self.path}/log/{r['path']}" for r in found if r["path"].rsplit("/", 1)[0] in live]).drop(BATCH))

    def as_of(self, table: str, at: datetime | str) -> DataFrame:
        """From the last keyframe before the moment, if there is one."""
        now = self.manifest()
        frame, since = self._since_keyframe(now, table, at)
        if frame is None:
            return timetravel.table_as_of(self._read(now["parts"]), table, at)
        return keyframes.table_as_of(frame, since, table, at)

    def _since_keyframe(self, now: dict[str, Any], table: str, at: datetime | str) -> tuple[DataFrame | None, DataFrame | None]:
        """A table's last keyframe up to a moment, and all events that it does not know: those of
        its month and later, and those of earlier months that were committed after it."""
        frames = sorted((f for f in now["keyframes"] if f["table"] == table), key=lambda f: f["at"])
        if frames:
            micros = self.spark.range(1).select(F.unix_micros(moment_column(at, TimestampType()))).first()[0]
            frames = [f for f in frames if f["at"] <= micros]
        if not frames:
            return None, None
        last = frames[-1]
        since = [p for p in now["parts"] if p[0] >= last["month"] or commit_of(p[1]) > last["commit"]]
        return self._parts("keyframes", [last["name"]], keyframes.KEYFRAME), self._read(since)

    def write_keyframe(self, table: str, month: str) -> None:
        """Keeps the state of a table at the beginning of a month (UTC); made from the last one."""
        start = datetime.strptime(month, "%Y-%m").replace(tzinfo=timezone.utc)
        with self.lock():
            now = self.manifest()
            earlier, events = self._since_keyframe(now, table, start)
            name = uuid.uuid4().hex
            rows = keyframes.keyframe(self._read(now["parts"]) if events is None else events, table, start, earlier)
            rows.repartitionByRange("object_id").sortWithinPartitions("object_id").write.parquet(f"{self.path}/keyframes/{name}")
            own = {"table": table, "at": int(start.timestamp()) * 1_000_000, "month": month, "commit": now["number"], "name": name}
            self._commit(now, keyframes=[*(f for f in now["keyframes"] if (f["table"], f["month"]) != (table, month)), own])

    def row_as_of(self, table: str, object_id: str, at: datetime | str) -> DataFrame:
        return timetravel.row_as_of(self.log, table, object_id, at)

    def blame(self, table: str, object_id: str, field: str | None = None, limit: int = 200) -> DataFrame:
        """Only contexts of the row's own events are resolved."""
        log = self.log
        versions = context_ops.used_only(self.context_versions, blame_ops.own_events(log, table, object_id, limit))
        return blame_ops.blame(log, context_ops.resolve(versions), table, object_id, field, limit)

    def chain_tip(self) -> dict[str, Any]:
        found = chain.chain_tip(self.log).collect()
        return found[0].asDict() if found else dict.fromkeys(("id", "chain_seq", "row_hash", "changed_at"))

    def verify(self, expected_tip: dict[str, Any] | None = None) -> dict[str, Any]:
        """Held against the tip that was noted with the last commit unless another is given; rows
        that came without a hash after the chain was switched on are broken as well."""
        now = self.manifest()
        left = self._parts("gaps", now["gaps"], chain.GAP) if now["gaps"] else None
        # Logs of older formats have the last purged row only.
        anchor = None if left is not None else now["anchor"]
        return chain.verify_summary(self._read(now["parts"]), expected_tip or now["tip"], now["chain_from"], anchor, left=left)

    @property
    def tree_nodes(self) -> DataFrame:
        return self._parts("tree", self.manifest()["tree_nodes"], tree.NODES)

    def tree_root(self, size: int | None = None) -> dict[str, Any]:
        """Size and root of the history tree, now or when it had ``size`` rows, to be noted elsewhere."""
        state = self.manifest()["tree"] or {"size": 0, "peaks": []}
        if size is None or size == state["size"]:
            return {"size": state["size"], "root": tree.root(state["size"], [bytes.fromhex(h) for _, _, h in state["peaks"]])}
        return {"size": size, "root": tree.root_at(self.tree_nodes, size)}

    def verify_tree(self, expected: dict[str, Any] | None = None) -> DataFrame:
        """Broken rows (``id``, ``reason``) against the tree, and the tree against its root and, if
        given, one that was noted when the log was smaller."""
        now = self.manifest()
        state = now["tree"] or {"first": 0, "size": 0, "peaks": []}
        gone = self._parts("tree_gone", now["tree_gone"], "id bigint") if now["tree_gone"] else None
        nodes = self._parts("tree", now["tree_nodes"], tree.NODES)
        broken = tree.verify(self._read(now["parts"]), nodes, state["first"], state["size"], self.tree_root()["root"], gone, self._kept)
        if expected and (expected["size"] > state["size"] or tree.root_at(nodes, expected["size"]) != expected["root"]):
            noted = [(state["first"] + expected["size"] - 1, "root differs from the noted one")]
            broken = broken.unionByName(self.spark.createDataFrame(noted, "id bigint, reason string"))
        return broken

    def _kept(self, df: DataFrame) -> DataFrame:
        """A table of the session's shared folder, as checks may run beside a writer."""
        path = fresh_folder(self.spark, "check")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def months(self) -> list[str]:
        return sorted({month for month, _ in self.manifest()["parts"]})

    def partition_bounds(self, now: datetime, months_ahead: int = 3) -> list[tuple[str, datetime, datetime]]:
        """Folders come on demand; these are the bounds that they will have."""
        return month_bounds(now, months_ahead + 1)

    def status(self) -> dict[str, Any]:
        now = self.manifest()
        counts = self.log.agg(F.count("*").alias("rows"), F.max("id").alias("last_id")).first()
        return {"rows": counts["rows"], "last_id": counts["last_id"] or 0, "months": self.months(), "chain": self.chain_tip(), "chain_from": now["chain_from"], "version": self.version(), "commit": now["number"]}

    # Writing

    def capture(self, changes: DataFrame, spec: Capture) -> int:
        """Appends the events of a batch of changes; the number of events."""
        context = current_context()
        own = self.spark.createDataFrame([(context.id, json.dumps(dict(context.metadata), default=str))], "id string, metadata string") if context else None
        return self.append_events(capture_cdc(changes, spec, context).drop("id"), contexts=own)

    def append_events(self, events: DataFrame, stream: str | None = None, batch_number: int | None = None, contexts: DataFrame | None = None) -> int:
        """Ids and, if they are on, chain and tree continue from the last commit. A stream's batch is
        committed together with its number and is left alone when it comes again; ``contexts`` (id,
        metadata) are committed with the events, if there are any."""
        with self.lock():
            now = self.manifest()
            if stream is not None and now["streams"].get(stream, -1) >= batch_number:
                return 0
            placed, n = with_ids(conform(events).drop("id"), now["last_id"] + 1, self._staged)
            if not n and stream is None:
                self._fs.delete(self._at("_staging"), True)
                return 0
            tip, first = now["tip"], now["chain_from"]
            if self._chain_wanted and first is None:
                first = now["last_id"] + 1
            if first is not None:
                # Images are staged once, for the ids; only ids and hashes are staged for the chain.
                placed = placed.drop(*chain.LINK_COLUMNS).join(chain.links(placed, tip, f"{self.path}/_staging/{uuid.uuid4().hex}"), "id")
            name = _batch_name(now)
            options = fileindex.BLOOM if self._index_wanted or now["index"] is not None else {}
            months = self._written(with_month(conform(placed)), name, options)
            # Read again only where something is derived from the rows.
            rows = self._read([[m, name] for m in months]) if n and (first is not None or now["tree"] is not None or self._tree_wanted) else None
            if n and first is not None:
                tip = chain.chain_tip(rows).first().asDict()
            streams = now["streams"] | ({stream: batch_number} if stream is not None else {})
            more = self._grown_tree(now, rows, n) if rows is not None else {}
            if n and options:
                more |= {"index": self._indexed(now["index"] or [], [[m, name] for m in sorted(months)])}
            if n and contexts is not None:
                more |= self._put_contexts(now, contexts)
            if n or stream is not None:
                self._commit(now, parts=now["parts"] + [[m, name] for m in sorted(months)], last_id=now["last_id"] + n, tip=tip, chain_from=first, streams=streams, **more)
            self._fs.delete(self._at("_staging"), True)
        return n

    def _written(self, rows: DataFrame, name: str, options: dict[str, str]) -> list[str]:
        """Writes rows as a batch and gives its months. Ranges of month, table and object: one month
        does not go to one task."""
        spread = rows.repartitionByRange(MONTH, "table_name", "object_id", "changed_at", "id").sortWithinPartitions(MONTH, "table_name", "object_id", "changed_at")
        spread.withColumn(BATCH, F.lit(name)).write.options(**options).mode("append").partitionBy(MONTH, BATCH).parquet(f"{self.path}/log")
        return sorted(m.split("=", 1)[1] for m in self._names("log") if m.startswith(f"{MONTH}=") and self._exists("log", m, f"{BATCH}={name}"))

    def merge_batches(self, until_commit: int | None = None, at_least: int = 8) -> list[str]:
        """Makes one batch of the batches of each month that has ``at_least`` so many; gives these
        months. Rows, ids, chain and tree stay as they are. A merged batch counts as one of its
        last commit, so ``until_commit`` must not be beyond what any reader of the feed has read."""
        merged = []
        with self.lock():
            state = self.manifest()
            by_month: dict[str, list[str]] = {}
            for month, batch in state["parts"]:
                if until_commit is None or commit_of(batch) <= until_commit:
                    by_month.setdefault(month, []).append(batch)
            for month, batches in sorted(by_month.items()):
                if len(batches) < at_least:
                    continue
                name = f"{max(map(commit_of, batches)):012d}-{uuid.uuid4().hex}"
                self._written(self._read([[month, b] for b in batches]), name, fileindex.BLOOM if state["index"] is not None else {})
                merged.append((month, batches, name))
            if merged:
                old = [[m, b] for m, batches, _ in merged for b in batches]
                new = [[m, name] for m, _, name in merged]
                more = {"index": self._indexed(state["index"], new)} if state["index"] is not None else {}
                self._commit(state, parts=[p for p in state["parts"] if p not in old] + new, **more)
                self._forget(old)
        return [m for m, _, _ in merged]

    def merge_side_tables(self, at_least: int = 8) -> list[str]:
        """Makes one folder of the many that commits have left of contexts, of the tree's nodes and
        of the index; gives the names of those tables."""
        tables = {
            "contexts": {"contexts": (CONTEXT, ["id", "seq"])},
            "tree_nodes": {"tree": (tree.NODES, ["level", "place"])},
            "tree_gone": {"tree_gone": ("id bigint", ["id"])},
            "index": {"ranges": (fileindex.RANGES, ["table_name", "least"]), "values": (fileindex.KEYS, ["kind", "value"])},
        }
        with self.lock():
            state, changes = self.manifest(), {}
            for key, folders in tables.items():
                names = state[key] or []
                if len(names) < at_least:
                    continue
                changes[key] = [uuid.uuid4().hex]
                for folder, (schema, order) in folders.items():
                    rows = self._parts(folder, names, schema)
                    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{self.path}/{folder}/{changes[key][0]}")
            if changes:
                self._commit(state, **changes)
                for key in changes:
                    for folder in tables[key]:
                        for name in state[key]:
                            self._fs.delete(self._at(folder, name), True)
        return sorted(changes)

    def _grown_tree(self, now: dict[str, Any], rows: DataFrame, n: int) -> dict[str, Any]:
        """What a commit of ``n`` new rows changes of the history tree."""
        state = now["tree"] or ({"first": now["last_id"] + 1, "size": 0, "peaks": []} if self._tree_wanted else None)
        if state is None:
            return {}
        size, name = state["size"] + n, uuid.uuid4().hex
        nodes = tree.grown(tree.leaves(rows, state["first"]), size, state["peaks"], self._staged)
        nodes.sortWithinPartitions("level", "place").write.parquet(f"{self.path}/tree/{name}")
        peaks = tree.peaks_at(self._parts("tree", [name], tree.NODES), size, state["peaks"])
        return {"tree": state | {"size": size, "peaks": peaks}, "tree_nodes": now["tree_nodes"] + [name]}

    def _put_contexts(self, now: dict[str, Any], rows: DataFrame, moment: datetime | None = None) -> dict[str, Any]:
        """Writes versions of contexts for the next commit, and gives what that changes."""
        at = F.lit(utc(moment or datetime.now(timezone.utc)).isoformat(sep=" ")).cast("timestamp")
        seq, name = now["context_seq"] + 1, uuid.uuid4().hex
        rows.select("id", "metadata", at.alias("written_at"), F.lit(seq).cast("bigint").alias("seq")).write.parquet(f"{self.path}/contexts/{name}")
        return {"contexts": now["contexts"] + [name], "context_seq": seq}

    def _staged(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/_staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_contexts(self, rows: DataFrame, now: datetime | None = None) -> None:
        """Adds a version of each context (id, metadata); reading resolves them."""
        with self.lock():
            state = self.manifest()
            self._commit(state, **self._put_contexts(state, rows, now))

    def _only_admin(self) -> None:
        if not self.admin:
            raise PermissionError("the log is append-only; maintenance needs Engine(..., admin=True)")

    def _forget(self, parts: list[list[str]]) -> None:
        """Deletes folders that no manifest names any more."""
        for month, batch in parts:
            self._fs.delete(self._at("log", f"{MONTH}={month}", f"{BATCH}={batch}"), True)

    def drop_old_months(self, now: datetime, older_than: str, dry_run: bool = False) -> list[str]:
        """Whole months that are out of retention: one commit, then their folders go."""
        names = retention.droppable_months(self.months(), now, older_than)
        if not dry_run and names:
            self._only_admin()
            with self.lock():
                state = self.manifest()
                gone = [p for p in state["parts"] if p[0] in names]
                self._commit(state, parts=[p for p in state["parts"] if p[0] not in names], **self._farewell(state, self._read(gone)))
                self._forget(gone)
        return names

    def _farewell(self, state: dict[str, Any], gone: DataFrame, gaps: bool = True) -> dict[str, Any]:
        """What is noted of rows that go, so that what is left can be checked: gaps of the chain, and
        ids of the tree, whose nodes stay."""
        # Keyframes hold rows that go; what is left makes new ones.
        out: dict[str, Any] = {"keyframes": []}
        if gaps and state["chain_from"] is not None:
            name = uuid.uuid4().hex
            old = self._parts("gaps", state["gaps"], chain.GAP) if state["gaps"] else None
            chain.gaps(gone, old).write.parquet(f"{self.path}/gaps/{name}")
            last = chain.chain_tip(gone).collect()
            out |= {"gaps": [name], "anchor": last[0].asDict() if last else state["anchor"]}
        if state["tree"] is not None:
            name = uuid.uuid4().hex
            gone.where(F.col("id") >= state["tree"]["first"]).select("id").repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.path}/tree_gone/{name}")
            out["tree_gone"] = state["tree_gone"] + [name]
        return out

    def purge(self, now: datetime, older_than: str, dry_run: bool = False, keep_anchor: bool = False) -> int:
        """Deletes events before the cutoff: whole months go, only the cutoff's month is
        rewritten, and no later one is read. ``keep_anchor`` notes what stood in the chain where rows
        go, so that what is left can be checked, in whatever order events came; the tree always
        can be."""
        edge = utc(cutoff(now, older_than))
        if dry_run:
            return self._before(self.manifest(), edge).count()
        if not self._before(self.manifest(), edge).limit(1).count():
            return 0
        self._only_admin()
        with self.lock():
            state, month = self.manifest(), edge.strftime("%Y-%m")
            gone = self._before(state, edge)
            n = gone.count()
            noted = self._farewell(state, gone, keep_anchor)
            old = [p for p in state["parts"] if p[0] <= month]
            rewritten = [p for p in old if p[0] == month]
            parts = [p for p in state["parts"] if p[0] > month]
            if rewritten:
                # A batch stays one of its own commit, for those who read by commits.
                renewed = {b: f"{commit_of(b):012d}-{uuid.uuid4().hex}" for _, b in rewritten}
                kept = self._read(rewritten, batches=True)
                new = F.create_map(*[F.lit(x) for pair in renewed.items() for x in pair])[F.col(BATCH)]
                kept.where(since(kept, edge)).withColumn(BATCH, new).write.mode("append").partitionBy(MONTH, BATCH).parquet(f"{self.path}/log")
                there = [[month, b] for b in renewed.values() if self._exists("log", f"{MONTH}={month}", f"{BATCH}={b}")]
                parts += there
                if state["index"] is not None:
                    noted |= {"index": self._indexed(state["index"], there)}
            self._commit(state, parts=sorted(parts), **noted)
            self._forget(old)
        return n

    def _before(self, state: dict[str, Any], edge: datetime) -> DataFrame:
        """Events before a moment, from the folders of its month and earlier ones only."""
        rows = self._read([p for p in state["parts"] if p[0] <= edge.strftime("%Y-%m")])
        return rows.where(before(rows, edge))

    def vacuum(self) -> int:
        """Deletes folders that a crash has left and no manifest names; how many."""
        self._only_admin()
        with self.lock():
            live = {tuple(p) for p in self.manifest()["parts"]}
            found = [[m.split("=", 1)[1], b.split("=", 1)[1]] for m in self._names("log") if m.startswith(f"{MONTH}=") for b in self._names(f"log/{m}") if b.startswith(f"{BATCH}=")]
            lost = [p for p in found if tuple(p) not in live]
            self._forget(lost)
            state = self.manifest()
            used = {f: state[k] for f, k in (("gaps", "gaps"), ("contexts", "contexts"), ("tree", "tree_nodes"), ("tree_gone", "tree_gone"), ("ranges", "index"), ("values", "index"))}
            for folder, names in (used | {"keyframes": [f["name"] for f in state["keyframes"]]}).items():
                for name in set(self._names(folder)) - set(names or ()):
                    self._fs.delete(self._at(folder, name), True)
                    lost.append([folder, name])
            self._fs.delete(self._at("_staging"), True)
        return len(lost)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A source table over JDBC, in ranges of a numeric key if given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", partitions: int = 8, **options: str) -> None:
    """Rows to a table over JDBC, over a bounded number of connections; maps and structs go as JSON."""
    flat = rows.select(*[F.to_json(F.col(f.name), {"ignoreNullFields": "false"}).alias(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f.name) for f in rows.schema])
    flat.write.format("jdbc").option("url", url).option("dbtable", table).option("numPartitions", partitions).options(**options).mode(mode).save()


def write_json_lines(rows: DataFrame, path: str | None = None, limit: int | None = None) -> Iterator[str] | None:
    """Rows as JSON lines: to files, or streamed to the driver a partition at a time."""
    ordered = rows.orderBy("object_id").limit(limit) if limit is not None else rows
    text = ordered.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    if path:
        text.write.text(path)
        return None
    return (r["value"] for r in text.toLocalIterator(prefetchPartitions=True))


def discard(rows: DataFrame) -> None:
    """Runs a plan and keeps nothing."""
    rows.write.format("noop").mode("overwrite").save()


def parameterised(spark: SparkSession, sql: str, *values: Any, **views: DataFrame) -> DataFrame:
    """SQL with positional parameters over DataFrames given by name."""
    return spark.sql(sql, args=list(values) or None, **views)
