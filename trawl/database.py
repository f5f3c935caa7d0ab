"""A searchable set of files that grows and shrinks.

Everything is stored as Parquet in immutable segments: ``files`` (file_id, path, mod_time_ns, content_hash,
file_length, strategy, version), ``occurrences`` (file_id, pos, chunk_id, location, byte_start, byte_end, attrs, version),
``chunks`` (chunk_id, content, n_tokens, chunk_no; a content is stored once), ``postings`` (trigram, part, places, tfs: the
chunks that have a trigram, in blocks by part of the chunk numbers; sorted by trigram), and what has gone: ``removed`` (file_id) and ``dropped`` (file_id, pos, version: what is older at that place).
Of several rows of one file the latest version counts.  A manifest names the segments that count; a new one is the last
step of a change, so a change that fails has no effect.  Chunk ids are hashes of contents: unchanged contents keep
theirs whatever happens to files.  compact() writes what is alive as one segment.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.text import BLOCKS, PLACE_BITS, Encoding, chunk_hash, tokens, trigram_blocks
from trawl.operators import search as operators
from trawl.operators.chunkers import Chunker, Registry, chunk_column, resumed, shifted
from trawl.operators.corpus import ATTRS, COLUMNS, Corpus
from trawl.plans.options import Options
from trawl.sources.files import chunked_by_command, list_files, read_files, valid_text

VERSION = "4"
SCHEMAS = {
    "files": "file_id long, path string, mod_time_ns long, content_hash string, file_length long, strategy string, version long",
    "occurrences": f"file_id long, pos int, chunk_id string, location string, byte_start int, byte_end int, attrs {ATTRS}, version long",
    "chunks": "chunk_id string, content string, n_tokens long, chunk_no long",
    "postings": BLOCKS,
    "removed": "file_id long",
    "dropped": "file_id long, pos int, version long",
}


#: Tokens of chunks for a file of postings, which is sorted by one task.
TOKENS_A_FILE = 3_000_000


class AlreadyIndexedError(ValueError):
    pass


class NoChunksError(ValueError):
    pass


class AppendBoundaryError(ValueError):
    pass


class AbortedError(RuntimeError):
    """A callback did not agree to a change."""


@dataclass(frozen=True)
class Change:
    """What a change did: file_ids of new files; all chunks (file_id, pos, chunk_id, location, content) of theirs; chunks
    (chunk_id, content) that were not there before; those that no file has any more."""

    file_ids: DataFrame | None = None
    all_chunks: DataFrame | None = None
    contents: DataFrame | None = None  #: (path, text) that was indexed
    new_chunks: DataFrame | None = None
    orphaned_chunks: DataFrame | None = None


@dataclass
class _Temporary:
    strategy: str
    content: str
    file_id: int
    chunks: list[dict] = field(default_factory=list)


class Database:
    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), manifest
        self.registry = Registry()
        self.registry.commands.update(manifest["commands"])
        self.encoding = Encoding(manifest["case_insensitive"], manifest["aliases"])
        self.temporary: dict[str, _Temporary] = {}
        self._last_temporary = 0

    # ---- opening

    @staticmethod
    def _file(spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

    @classmethod
    def create(cls, spark: SparkSession, root: str, case_insensitive: bool = False, aliases: dict[str, str] | None = None) -> Database:
        Encoding(case_insensitive, aliases or {})
        db = cls(spark, root, {"version": VERSION, "case_insensitive": case_insensitive, "aliases": aliases or {}, "commands": {}, "number": 0, "next_file_id": 1, "next_chunk_no": 0, "renewed": False, "segments": {k: [] for k in SCHEMAS}})
        fs, p = cls._file(spark, f"{db.root}/manifests")
        if fs.exists(p):
            raise FileExistsError(root)
        db._commit({})
        return db

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Database:
        fs, p = cls._file(spark, f"{root.rstrip('/')}/manifests")
        if not fs.exists(p):
            raise FileNotFoundError(root)
        latest = max(str(f.getPath()) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))
        return cls(spark, root, json.loads(spark.read.text(latest, wholetext=True).first().value))

    def _commit(self, segments: dict[str, str], **changes) -> None:
        manifest = self.manifest | changes | {"segments": {k: [*v, *([segments[k]] if k in segments else [])] for k, v in self.manifest["segments"].items()}}
        manifest["number"] = self.manifest["number"] + 1
        fs, aside = self._file(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(json.dumps(manifest).encode())
        out.close()
        _, final = self._file(self.spark, f"{self.root}/manifests/{manifest['number']:012d}.json")
        # a rename does not replace a file: of two writers one fails
        if fs.exists(final) or not fs.rename(aside, final):
            raise RuntimeError(f"{self.root} was changed by another writer")
        self.manifest = manifest

    def fork(self, root: str) -> Database:
        """A database of its own at ``root`` that shares the segments so far; either may change without the other."""
        segments = {k: [x if "/" in x else f"{self.root}/{k}/{x}" for x in v] for k, v in self.manifest["segments"].items()}
        other = Database(self.spark, root, self.manifest | {"segments": segments})
        other.registry = replace(self.registry, own=dict(self.registry.own), commands=dict(self.registry.commands))
        other._commit({})
        return other

    def copy(self) -> Database:
        """A handle on the state as it is now; changes through one are not seen by the other."""
        other = Database(self.spark, self.root, json.loads(json.dumps(self.manifest)))
        other.registry, other.temporary = replace(self.registry, own=dict(self.registry.own), commands=dict(self.registry.commands)), dict(self.temporary)
        return other

    def close(self) -> None:
        self.temporary.clear()

    @property
    def version(self) -> str:
        return self.manifest["version"]

    @property
    def settings(self) -> dict:
        return {k: self.manifest[k] for k in ("case_insensitive", "aliases", "commands")}

    # ---- strategies

    def add_strategy(self, name: str, command: str) -> None:
        """A chunker that is an external command; it is kept with the database."""
        self.registry.add_command(name, command)
        self._commit({}, commands=self.registry.commands)

    def add_chunker(self, name: str, chunker: Chunker | Callable) -> None:
        """A chunker that is code; to be added again after open()."""
        self.registry.add(name, chunker)

    def remove_strategy(self, name: str) -> None:
        self.registry.remove(name)
        self._commit({}, commands=self.registry.commands)

    # ---- tables

    def _has(self, table: str) -> bool:
        return bool(self.manifest["segments"][table])

    def _stored(self, table: str) -> DataFrame:
        paths = [s if "/" in s else f"{self.root}/{table}/{s}" for s in self.manifest["segments"][table]]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[table])

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._stored("removed"), "file_id", "left_anti") if self._has("removed") else rows

    @property
    def files(self) -> DataFrame:
        rows = self._stored("files")
        if self.manifest["renewed"]:
            names = rows.columns
            rows = rows.groupBy("file_id").agg(F.max_by(F.struct(*names), "version").alias("r")).select("r.*")
        return self._alive(rows).drop("version")

    def _living(self, rows: DataFrame) -> DataFrame:
        """Of stored occurrences, those that count."""
        rows = self._alive(rows)
        if self._has("dropped"):
            gone = self._stored("dropped").groupBy("file_id", "pos").agg(F.max("version").alias("_until"))
            rows = rows.join(gone, ["file_id", "pos"], "left").where("_until is null or version >= _until").drop("_until")
        return rows

    @property
    def occurrences(self) -> DataFrame:
        return self._living(self._stored("occurrences")).drop("version")

    @property
    def _all_live(self) -> bool:
        return not self._has("removed") and not self._has("dropped")

    @property
    def chunks(self) -> DataFrame:
        """(chunk_id, content) that some file has."""
        return self._live_chunks().select("chunk_id", "content")

    def _live_chunks(self) -> DataFrame:
        rows = self._stored("chunks")
        return rows if self._all_live else rows.join(self.occurrences.select("chunk_id"), "chunk_id", "left_semi")

    def _postings(self) -> DataFrame:
        """(trigram, chunk_no, tf) as stored."""
        rows = self._stored("postings").select("trigram", "part", F.inline(F.arrays_zip("places", "tfs")))
        return rows.select("trigram", (F.shiftleft("part", PLACE_BITS) + F.col("places")).alias("chunk_no"), F.col("tfs").alias("tf"))

    @property
    def postings(self) -> DataFrame:
        """(trigram, chunk_id, tf) of chunks that some file has."""

        def named(_, blocks: pa.Table, chunks: pa.Table) -> pa.Table:
            # blocks travel, not postings: a part's chunks are looked up where its blocks are opened
            place = chunks.column("chunk_no").to_numpy() & ((1 << PLACE_BITS) - 1)
            row = np.full(1 << PLACE_BITS, -1)
            row[place] = np.arange(len(place))
            lists = blocks.column("places").combine_chunks()
            at = row[lists.flatten().to_numpy()]
            trigram = np.repeat(blocks.column("trigram").to_numpy(), pc.list_value_length(lists).to_numpy())
            tf = blocks.column("tfs").combine_chunks().flatten().to_numpy()
            there = at >= 0
            ids = chunks.column("chunk_id").combine_chunks().take(pa.array(at[there]))
            return pa.table({"trigram": pa.array(trigram[there], pa.int32()), "chunk_id": ids, "tf": pa.array(tf[there], pa.int32())})

        chunks = self._live_chunks().select("chunk_no", "chunk_id", F.shiftright("chunk_no", PLACE_BITS).alias("part"))
        return self._stored("postings").groupBy("part").cogroup(chunks.groupBy("part")).applyInArrow(named, "trigram int, chunk_id string, tf int")

    def file(self, path: str) -> DataFrame:
        return self.files.where(F.col("path") == path)

    def file_by_id(self, file_id: int) -> DataFrame:
        return self.files.where(F.col("file_id") == file_id)

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.corpus().chunks.where(F.col("chunk_id") == chunk_id)

    def file_paths(self) -> DataFrame:
        """(file_id, path), temporary files included."""
        tmp = self.spark.createDataFrame([(t.file_id, p) for p, t in self.temporary.items()], "file_id long, path string")
        return self.files.select("file_id", "path").unionByName(tmp)

    def chunk_lengths(self) -> DataFrame:
        """(file_id, lengths): bytes of each chunk of a file, in order."""
        rows = self.corpus().occurrences.select("file_id", F.struct("pos", F.octet_length("content").alias("n")).alias("c"))
        return rows.groupBy("file_id").agg(F.array_sort(F.collect_list("c")).alias("c")).select("file_id", F.col("c.n").alias("lengths"))

    def record_counts(self) -> DataFrame:
        """(table, n_rows, bytes) of what is stored and alive."""
        sizes = {
            "files": (self.files, F.octet_length("path")),
            "occurrences": (self.occurrences, F.octet_length("location")),
            "chunks": (self.chunks, F.octet_length("content")),
            "postings": (self._postings() if self._all_live else self._postings().join(self._live_chunks().select("chunk_no"), "chunk_no", "left_semi"), F.lit(8)),
        }
        rows = [df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")).select(F.lit(t).alias("table"), "*") for t, (df, size) in sizes.items()]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    # ---- changes

    def _write(self, df: DataFrame, table: str, segment: str) -> DataFrame:
        path = f"{self.root}/{table}/{segment}"
        types = T._parse_datatype_string(SCHEMAS[table])
        df.select(*[F.col(f.name).cast(f.dataType) for f in types]).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(types).parquet(path)

    def _chunked(self, files: DataFrame, strategy: str) -> DataFrame:
        """(path, pos, location, byte_start, byte_end, content, attrs) of files (path, text)."""
        if strategy in self.registry.commands:
            rows = chunked_by_command(files, self.registry.commands[strategy])
            return rows.select("path", "pos", "location", F.lit(None).cast("int").alias("byte_start"), F.lit(None).cast("int").alias("byte_end"), "content", F.array().cast(ATTRS).alias("attrs"))
        chunker = self.registry.get(strategy)
        attrs = F.col("attrs") if "attrs" in files.columns else F.array()
        rows = files.select("path", attrs.cast(ATTRS).alias("_attrs"), F.posexplode(chunk_column(F.col("text"), chunker)).alias("pos", "c"))
        # a chunk's own attributes come before those of its file
        return rows.select("path", "pos", "c.*", "_attrs").withColumn("attrs", F.concat("attrs", "_attrs")).drop("_attrs")

    def _text(self, files: DataFrame) -> DataFrame:
        """Files with text, file_length, content_hash and mod_time_ns."""
        if dict(files.dtypes).get("content") == "binary":
            files = files.withColumn("text", valid_text(F.col("content")))
        elif "content" in files.columns:
            files = files.withColumn("text", F.col("content"))
        data = F.encode("text", "UTF-8")
        default = {"mod_time_ns": F.lit(0).cast("long"), "file_length": F.octet_length("text").cast("long"), "content_hash": F.sha2(data, 256)}
        return files.withColumns({c: v for c, v in default.items() if c not in files.columns})

    def _add(self, files: DataFrame, strategy: str, removed: DataFrame | None = None, agree: Callable[[Change], bool] | None = None) -> Change:
        files = self._text(files)
        segment = uuid.uuid4().hex
        base = self.manifest["next_file_id"]
        one = files.select("path", "mod_time_ns", "content_hash", "file_length", F.lit(strategy).alias("strategy"), F.lit(self.manifest["number"] + 1).cast("long").alias("version"))
        numbered = one.repartitionByRange("path").sortWithinPartitions("path").withColumn("file_id", F.monotonically_increasing_id() + base)
        new_files = self._write(numbered, "files", segment)
        repeated = new_files.groupBy("path").count().where("count > 1").select("path").first()
        if repeated:
            raise AlreadyIndexedError(f"{repeated.path} is given twice")
        rows = self._chunked(files, strategy).join(new_files.select("path", "file_id"), "path").withColumn("chunk_id", chunk_hash(F.col("content")))
        aside = f"{self.root}/staging/{segment}"
        rows.write.option("compression", "zstd").parquet(aside)
        rows = self.spark.read.schema(rows.schema).parquet(aside)
        occurrences = self._write(rows.withColumn("version", F.lit(self.manifest["number"] + 1)), "occurrences", segment)
        without = new_files.join(occurrences, "file_id", "left_anti").select("path").first()
        if without:
            raise NoChunksError(f"{without.path} has no chunks")
        distinct = rows.groupBy("chunk_id").agg(F.first("content").alias("content"))
        new = self._write_chunks(distinct, segment)
        next_chunk_no = self._write_postings(new, segment)
        segments = dict.fromkeys(("files", "occurrences", "chunks", "postings"), segment)
        all_chunks = occurrences.join(self._stored("chunks").unionByName(new).select("chunk_id", "content"), "chunk_id").select("file_id", "pos", "chunk_id", "location", "content")
        change = Change(new_files.select("file_id", "path"), all_chunks, files.select("path", "text"), new.select("chunk_id", "content"))
        fs, p = self._file(self.spark, aside)
        fs.delete(p, True)
        if agree is not None and not agree(change):
            for t in segments:
                fs, p = self._file(self.spark, f"{self.root}/{t}/{segment}")
                fs.delete(p, True)
            raise AbortedError("the change was not agreed to")
        orphans = None
        if removed is not None:
            self._write(removed, "removed", segment)
            segments["removed"] = segment
            before = self.chunks
        last = new_files.agg(F.max("file_id")).first()[0]
        self._commit(segments, next_file_id=(last or base) + 1, next_chunk_no=next_chunk_no)
        if removed is not None:
            orphans = before.join(self.occurrences.select("chunk_id"), "chunk_id", "left_anti")
        return replace(change, orphaned_chunks=orphans)

    def _write_chunks(self, distinct: DataFrame, segment: str) -> DataFrame:
        """Those of (chunk_id, content) that are not stored yet, sorted by id and numbered."""
        new = distinct.join(self._stored("chunks").select("chunk_id"), "chunk_id", "left_anti") if self._has("chunks") else distinct
        return self._numbered(new.withColumn("n_tokens", F.size(tokens(F.col("content")))), segment)

    def _numbered(self, chunks: DataFrame, segment: str) -> DataFrame:
        number = F.monotonically_increasing_id() + self.manifest["next_chunk_no"]
        return self._write(chunks.sortWithinPartitions("chunk_id").withColumn("chunk_no", number), "chunks", segment)

    def _write_postings(self, chunks: DataFrame, segment: str) -> int:
        """Postings of written chunks; the chunk number that is free after them."""
        blocks = chunks.select("chunk_no", self.encoding.column(F.col("content")).alias("encoded")).mapInArrow(trigram_blocks, BLOCKS)
        last, n_tokens = chunks.agg(F.max("chunk_no"), F.sum("n_tokens")).first()
        # a trigram is in one file, sorted: a query reads the pages of its trigrams.  By hash: nothing is computed twice for samples
        self._write(blocks.repartition(1 + (n_tokens or 0) // TOKENS_A_FILE, "trigram").sortWithinPartitions("trigram", "part"), "postings", segment)
        return self.manifest["next_chunk_no"] if last is None else ((last >> PLACE_BITS) + 1) << PLACE_BITS

    def add(self, files: DataFrame, strategy: str = "line", agree: Callable[[Change], bool] | None = None) -> Change:
        """Add files (path, content as text or bytes; optionally mod_time_ns, attrs, file_length, content_hash).  ``agree``
        sees the change before it counts; if it returns False, or raises, nothing is changed."""
        known = files.select("path").join(self.files.select("path"), "path", "left_semi").first()
        if known:
            raise AlreadyIndexedError(f"{known.path} is indexed already")
        return self._add(files, strategy, agree=agree)

    def add_paths(self, *paths: str, strategy: str = "line") -> Change:
        return self.add(read_files(self.spark, *paths), strategy)

    def reindex_paths(self, *paths: str, strategy: str = "line") -> Change:
        """Index files in folders again, new ones included; those whose content has the hash that is known are neither
        cut nor written."""
        now = read_files(self.spark, *paths)
        known = self.files.select("path", "content_hash")
        changed = now.join(known, ["path", "content_hash"], "left_anti")
        return self._add(changed, strategy, self.files.join(changed.select("path"), "path", "left_semi").select("file_id"))

    def _ids_of(self, paths: Iterable[str] | DataFrame) -> DataFrame:
        asked = paths if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "path string")
        missing = asked.join(self.files.select("path"), "path", "left_anti").first()
        if missing:
            raise KeyError(f"no file {missing.path!r}")
        return self.files.join(asked, "path", "left_semi").select("file_id")

    def remove(self, *paths: str) -> Change:
        return self.remove_all(self.spark.createDataFrame([(p,) for p in paths], "path string"))

    def remove_all(self, paths: DataFrame) -> Change:
        """Remove many files (path)."""
        before = self.chunks
        segment = uuid.uuid4().hex
        self._write(self._ids_of(paths), "removed", segment)
        self._commit({"removed": segment})
        return Change(orphaned_chunks=before.join(self.occurrences.select("chunk_id"), "chunk_id", "left_anti"))

    def reindex(self, files: DataFrame, strategy: str = "line", agree: Callable[[Change], bool] | None = None) -> Change:
        """Replace files by new contents; they get new file ids."""
        return self._add(files, strategy, self._ids_of(files.select("path")), agree)

    def append(self, path: str, content: str, strategy: str | None = None, content_hash: str | None = None, mod_time_ns: int | None = None, file_length: int | None = None, base_line: int | None = None) -> Change:
        """Add text to the end of a file, which keeps its id, and its hash, time and length unless new ones are given.
        Chunkers that can resume cut it from the file's last chunk on, which may be replaced; others cut the new text
        alone, after ``base_line`` lines (default: those the file has).  Only the end of the file is read and written; no
        text is no change."""
        found = self.file(path).first()
        if found is None:
            raise KeyError(f"no file {path!r}")
        if not content:
            return Change()
        strategy = strategy or found.strategy
        if strategy in self.registry.commands:
            raise ValueError("a command can't cut text without a file")
        chunker = self.registry.get(strategy)
        own = self.occurrences.where(F.col("file_id") == found.file_id)
        # one row
        last = own.orderBy(F.desc("pos")).limit(1).join(self._stored("chunks"), "chunk_id").first()
        replaced, next_pos = False, last.pos + 1 if last else 0
        if chunker.resumes and last is not None and last.byte_start is not None:
            tail = last.content + content
            size = last.byte_end - last.byte_start
            before = int(last.location.split("-")[0]) - 1
            replaced, cut = resumed(chunker, tail.encode(), (0, size))
            new = [c | {"location": shifted(c["location"], before), "byte_start": c["byte_start"] + last.byte_start, "byte_end": c["byte_end"] + last.byte_start} for c in cut]
            next_pos = last.pos if replaced else next_pos
        else:
            new = chunker.chunks(content.encode())
            if not new:
                raise AppendBoundaryError(f"the text appended to {path} has no chunks")
            lines = base_line
            if lines is None:
                ends = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
                lines = own.join(self._stored("chunks"), "chunk_id").agg(F.coalesce(F.sum(ends), F.lit(0))).first()[0]
            start = last.byte_end or 0 if last else 0
            new = [c | {"location": shifted(c["location"], lines), "byte_start": c["byte_start"] + start, "byte_end": c["byte_end"] + start} for c in new]
        segment, version = uuid.uuid4().hex, self.manifest["number"] + 1
        rows = [(found.file_id, next_pos + i, c["location"], c["byte_start"], c["byte_end"], c["content"], [(a["key"], a["value"]) for a in c["attrs"]], version) for i, c in enumerate(new)]
        tail = self.spark.createDataFrame(rows, f"file_id long, pos int, location string, byte_start int, byte_end int, content string, attrs {ATTRS}, version long")
        tail = tail.withColumn("chunk_id", chunk_hash(F.col("content")))
        changed = {k: v for k, v in (("content_hash", content_hash), ("mod_time_ns", mod_time_ns), ("file_length", file_length)) if v is not None}
        segments = dict.fromkeys(("occurrences", "chunks", "postings"), segment)
        before_change = own.select("chunk_id").where(F.col("pos") == last.pos).join(self._stored("chunks"), "chunk_id").select("chunk_id", "content") if replaced else None
        self._write(tail, "occurrences", segment)
        added = self._write_chunks(tail.groupBy("chunk_id").agg(F.first("content").alias("content")), segment)
        next_chunk_no = self._write_postings(added, segment)
        if replaced:
            self._write(self.spark.createDataFrame([(found.file_id, last.pos, version)], SCHEMAS["dropped"]), "dropped", segment)
            segments["dropped"] = segment
        if changed:
            self._renew(found, segment, **changed)
            segments["files"] = segment
        self._commit(segments, renewed=self.manifest["renewed"] or bool(changed), next_chunk_no=next_chunk_no)
        orphans = before_change.join(self.occurrences.select("chunk_id"), "chunk_id", "left_anti") if replaced else None
        ids = self.spark.createDataFrame([(found.file_id, path)], "file_id long, path string")
        return Change(ids, tail.select("file_id", "pos", "chunk_id", "location", "content"), None, added.select("chunk_id", "content"), orphans)

    def _renew(self, found, segment: str, **changes) -> None:
        """A new version of what is known about a file."""
        row = found.asDict() | changes | {"version": self.manifest["number"] + 1}
        names = [f.name for f in T._parse_datatype_string(SCHEMAS["files"])]
        self._write(self.spark.createDataFrame([tuple(row[n] for n in names)], SCHEMAS["files"]), "files", segment)

    def set_file_length(self, path: str, length: int) -> None:
        """Changes what is known about a file, not its chunks nor its id."""
        found = self.file(path).first()
        if found is None:
            raise KeyError(f"no file {path!r}")
        segment = uuid.uuid4().hex
        self._renew(found, segment, file_length=length)
        self._commit({"files": segment}, renewed=True)

    def compact(self) -> None:
        """Writes what is alive as one segment and forgets the others; their files stay for handles that read them."""
        segment, version = uuid.uuid4().hex, F.lit(self.manifest["number"] + 1).cast("long")
        self._write(self.files.withColumn("version", version), "files", segment)
        self._write(self.occurrences.withColumn("version", version), "occurrences", segment)
        # chunks are numbered anew, so that parts are full
        chunks = self._numbered(self._live_chunks().select("chunk_id", "content", "n_tokens"), segment)
        next_chunk_no = self._write_postings(chunks, segment)
        self.manifest = self.manifest | {"segments": {k: [] for k in SCHEMAS}}
        self._commit(dict.fromkeys(("files", "occurrences", "chunks", "postings"), segment), renewed=False, next_chunk_no=next_chunk_no)

    # ---- staleness

    def staleness(self, now: DataFrame) -> DataFrame:
        """(path, status, file_id, strategy) against files as they are now (path, mod_time_ns, and content_hash if it is
        known): fresh where time or content are the same, missing, or stale."""
        known = F.col("content_hash") if "content_hash" in now.columns else F.lit(None).cast("string")
        current = now.select("path", F.col("mod_time_ns").alias("_m"), known.alias("_h"), F.lit(True).alias("_there"))
        fresh = (F.col("_m") == F.col("mod_time_ns")) | ((F.col("_h") == F.col("content_hash")) & (F.col("_h") != ""))
        status = F.when(F.col("_there").isNull(), "missing").when(fresh, "fresh").otherwise("stale")
        return self.files.join(current, "path", "left").select("path", status.alias("status"), "file_id", "strategy")

    def check_paths(self, *paths: str) -> DataFrame:
        """As staleness(), against files in folders: times first, and only those that differ are read to compare contents."""
        by_time = self.staleness(list_files(self.spark, *paths))
        changed = by_time.where("status = 'stale'").select("path")
        hashes = read_files(self.spark, *paths).join(changed, "path", "left_semi").select("path", F.col("content_hash").alias("_h"))
        same = self.files.select("path", "content_hash").join(hashes, "path").where("_h = content_hash").select("path", F.lit(True).alias("_same"))
        return by_time.join(same, "path", "left").select("path", F.when(F.col("_same"), "fresh").otherwise(F.col("status")).alias("status"), "file_id", "strategy")

    def refresh_paths(self, *paths: str, strategy: str = "") -> DataFrame:
        """As refresh(), from files in folders."""
        found = self.check_paths(*paths)
        return self._refresh(found, read_files(self.spark, *paths), strategy)

    def refresh(self, now: DataFrame, strategy: str = "") -> DataFrame:
        """Reindexes stale files from their contents now; the statuses that were found.  Missing files stay."""
        return self._refresh(self.staleness(now), now, strategy)

    def _refresh(self, found: DataFrame, now: DataFrame, strategy: str) -> DataFrame:
        found = found.cache()
        names = [strategy] if strategy else [r.strategy for r in found.where("status = 'stale'").select("strategy").distinct().collect()]
        for name in names:
            which = found.where("status = 'stale'" if strategy else (F.col("status") == "stale") & (F.col("strategy") == name))
            files = now.join(which.select("path"), "path", "left_semi")
            if not files.isEmpty():
                self.reindex(files, name)
        return found

    def list_paths(self, *paths: str) -> DataFrame:
        return list_files(self.spark, *paths)

    # ---- temporary files

    def add_tmp(self, path: str, content: str, strategy: str = "line") -> int:
        if path in self.temporary:
            raise AlreadyIndexedError(path)
        self._last_temporary -= 1
        self._set_tmp(path, content, strategy, self._last_temporary)
        return self._last_temporary

    def _set_tmp(self, path: str, content: str, strategy: str, file_id: int) -> None:
        if strategy in self.registry.commands:
            raise ValueError("a command can't cut text without a file")
        self.temporary[path] = _Temporary(strategy, content, file_id, self.registry.get(strategy).chunks(content.encode()))

    def update_tmp(self, path: str, content: str, strategy: str | None = None) -> None:
        t = self.temporary[path]
        self._set_tmp(path, content, strategy or t.strategy, t.file_id)

    def append_tmp(self, path: str, content: str, strategy: str = "line", base_line: int | None = None) -> int:
        """Creates the file if there is none; its strategy cannot change.  With ``base_line`` the new text alone is cut,
        after so many lines."""
        t = self.temporary.get(path)
        if t is None:
            return self.add_tmp(path, content, strategy)
        if strategy != t.strategy:
            raise ValueError(f"{path} has the strategy {t.strategy}")
        chunker = self.registry.get(strategy)
        if content and (base_line is not None or not chunker.resumes):
            lines = base_line if base_line is not None else t.content.count("\n")
            start = len(t.content.encode())
            t.chunks += [c | {"location": shifted(c["location"], lines), "byte_start": c["byte_start"] + start, "byte_end": c["byte_end"] + start} for c in chunker.chunks(content.encode())]
        elif content:
            # only the end is cut again
            end = (t.chunks[-1]["byte_start"], t.chunks[-1]["byte_end"]) if t.chunks else None
            replaced, new = resumed(chunker, (t.content + content).encode(), end)
            t.chunks = (t.chunks[:-1] if replaced else t.chunks) + new
        t.content += content
        return t.file_id

    def remove_tmp(self, path: str) -> None:
        del self.temporary[path]

    def tmp_content(self, path: str) -> str:
        return self.temporary[path].content

    def tmp_files(self) -> list[tuple[str, int, int]]:
        """(path, file_id, bytes)."""
        return [(p, t.file_id, len(t.content.encode())) for p, t in sorted(self.temporary.items())]

    # ---- queries

    def _joined(self, occurrences: DataFrame) -> DataFrame:
        rows = self._living(occurrences).drop("version").join(self._stored("chunks").select("chunk_id", "content"), "chunk_id")
        return rows.join(self.files.select("file_id", "path", "mod_time_ns"), "file_id").withColumn("is_tmp", F.lit(False))

    def _of_candidates(self, candidates: DataFrame) -> DataFrame:
        """Occurrences of candidate chunks: ids first, then contents, files last."""
        own = [c for c in candidates.columns if c != "chunk_id"]
        rows = self._joined(self._stored("occurrences").join(candidates, "chunk_id"))
        return rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in COLUMNS.items()], "chunk_id", *own)

    def corpus(self) -> Corpus:
        of = Corpus.of(self._joined(self._stored("occurrences")), self.encoding)
        live = None if self._all_live else self._live_chunks().select("chunk_no")
        names = self._stored("chunks").select("chunk_no", "chunk_id")
        stored = replace(of, postings=self._postings(), key="chunk_no", names=names, fetch=self._of_candidates, live=live, stored_stats=self.stats())
        if not self.temporary:
            return stored
        rows = [(t.file_id, p, i, c["location"], c["content"], [(a["key"], a["value"]) for a in c["attrs"]], 0, True) for p, t in self.temporary.items() for i, c in enumerate(t.chunks)]
        tmp = self.spark.createDataFrame(rows, ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items()))
        return stored.union(Corpus.of(tmp, self.encoding))

    def search(self, query: str, options: Options | None = None) -> DataFrame:
        return operators.search(self.corpus(), query, options)

    def search_regex(self, pattern: str, options: Options | None = None) -> DataFrame:
        return operators.search_regex(self.corpus(), pattern, options)

    def search_fuzzy(self, query: str, k: int = 20, options: Options | None = None) -> DataFrame:
        return operators.search_fuzzy(self.corpus(), query, k, options)

    def search_multi(self, query: str, scorers: dict, k: int = 0, options: Options | None = None) -> DataFrame:
        return operators.search_multi(self.corpus(), query, scorers, k, options)

    def score_file(self, query: str, path: str, options: Options | None = None) -> DataFrame:
        return operators.score_file(self.corpus(), query, path, options)

    def get_chunks(self, path: str, location: str, before: int = 0, after: int = 0) -> DataFrame:
        return operators.get_chunks(self.corpus(), path, location, before, after)

    def chunk_cache(self, paths: DataFrame) -> ChunkCache:
        """Chunks of some files (path), held by the executors for many retrievals."""
        return ChunkCache(self, paths)

    def query_frequencies(self, query: str) -> DataFrame:
        return operators.query_frequencies(self.corpus(), query)

    def stats(self) -> DataFrame:
        """(total_chunks, total_tokens) of the chunks that some file has; contents are not read."""
        return self._live_chunks().agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("total_tokens"))


class ChunkCache:
    """Chunks of some files of a database as it was, persisted until close()."""

    def __init__(self, db: Database, paths: DataFrame):
        of = db.corpus()
        self._corpus = Corpus(of.occurrences.join(paths.select("path").distinct(), "path", "left_semi").persist(), of.encoding)

    def get_chunks(self, path: str, location: str, before: int = 0, after: int = 0) -> DataFrame:
        return operators.get_chunks(self._corpus, path, location, before, after)

    def contents(self, results: DataFrame) -> DataFrame:
        """Results (path, location, ...) with the content of each."""
        first = self._corpus.occurrences.groupBy("path", "location").agg(F.min_by("content", "pos").alias("content"))
        return results.join(first, ["path", "location"])

    def close(self) -> None:
        self._corpus.occurrences.unpersist()
