import pytest
from pyspark.sql import functions as F

from trawl.cli import main
from trawl.database import AbortedError, AlreadyIndexedError, AppendBoundaryError, Database, NoChunksError
from trawl.operators.chunkers import Chunker, lines
from trawl.plans.options import Options
from trawl.sources.files import read_files
from trawl.streaming.ingest import ingest, new_chunks

FILES = "path string, content string, mod_time_ns long"


@pytest.fixture
def db(spark, tmp_path):
    d = Database.create(spark, f"file://{tmp_path}/db")
    d.add(spark.createDataFrame([("a", "apple pie\nbanana split\n", 5), ("b", "banana split\ncherry tart\n", 6)], FILES))
    return d


def places(df):
    return [(r.path, r.location) for r in df.collect()]


def test_add_search_remove(db, spark):
    assert places(db.search("banana")) == [("a", "2-2"), ("b", "1-1")]
    assert tuple(db.stats().first()) == (3, 6)
    with pytest.raises(AlreadyIndexedError):
        db.add(spark.createDataFrame([("a", "x", 1)], FILES))
    with pytest.raises(NoChunksError):
        db.add(spark.createDataFrame([("empty", "", 1)], FILES))
    assert places(Database.open(spark, db.root).search_regex("cherry")) == [("b", "2-2")]
    gone = db.remove("a").orphaned_chunks.collect()
    assert [r.content for r in gone] == ["apple pie\n"]
    assert places(db.search("banana")) == [("b", "1-1")] and tuple(db.stats().first()) == (2, 4)
    db.remove("b")
    assert tuple(db.stats().first()) == (0, 0) and {r.n_rows for r in db.record_counts().collect()} == {0}
    with pytest.raises(KeyError):
        db.remove("b")


def test_reindex_keeps_chunk_ids(db, spark):
    before = {(r.chunk_id) for r in db.occurrences.collect()}
    old = db.file("a").first().file_id
    change = db.reindex(spark.createDataFrame([("a", "apple pie\nnew line\n", 9)], FILES))
    assert [r.content for r in change.new_chunks.collect()] == ["new line\n"] and change.orphaned_chunks.count() == 0
    assert db.file("a").first().file_id != old and len(before & {r.chunk_id for r in db.occurrences.collect()}) == 3


def test_append(db, spark):
    db.append("a", "more\npart")
    assert [(r.location, r.content) for r in db.get_chunks("a", "1-1", 0, 9).collect()] == [("1-1", "apple pie\n"), ("2-2", "banana split\n"), ("3-3", "more\n"), ("4-4", "part")]
    db.append("a", "ial\n", mod_time_ns=77)
    assert db.get_chunks("a", "4-4").first().content == "partial\n" and db.file("a").first().mod_time_ns == 77
    db.add_chunker("plain", lines)
    db.add(spark.createDataFrame([("p", "x1\nx2\n", 1)], FILES), "plain")
    db.append("p", "x3\n")
    assert db.get_chunks("p", "3-3").first().content == "x3\n"
    db.add_chunker("never", Chunker(lambda data: iter(()), resumes=False))
    with pytest.raises(AppendBoundaryError):
        db.append("p", "text", "never")
    db.set_file_length("p", 123)
    assert db.file("p").first().file_length == 123 and places(db.search("x3\n")) == []


def test_staleness(db, spark):
    now = spark.createDataFrame([("a", "changed\n", 99)], FILES).withColumn("content_hash", F.sha2("content", 256))
    found = {r.path: r.status for r in db.refresh(now).collect()}
    assert found == {"a": "stale", "b": "missing"} and places(db.search("changed")) == [("a", "1-1")]
    assert {r.path: r.status for r in db.staleness(now).collect()} == {"a": "fresh", "b": "missing"}


def test_temporary_files(db):
    first = db.add_tmp("tmp://x", "banana bread\n")
    assert first < 0 and places(db.search("banana")) == [("a", "2-2"), ("b", "1-1"), ("tmp://x", "1-1")]
    assert len(places(db.search("banana", Options(no_tmp=True)))) == 2
    assert db.append_tmp("tmp://x", "and butter\n") == first and db.tmp_content("tmp://x") == "banana bread\nand butter\n"
    with pytest.raises(ValueError):
        db.append_tmp("tmp://x", "y", "markdown")
    with pytest.raises(AlreadyIndexedError):
        db.add_tmp("tmp://x", "")
    assert places(db.get_chunks("tmp://x", "1-1", 0, 1)) == [("tmp://x", "1-1"), ("tmp://x", "2-2")]
    assert db.tmp_files() == [("tmp://x", first, 24)] and db.file_paths().count() == 3
    db.remove_tmp("tmp://x")
    assert len(places(db.search("banana"))) == 2


def test_files_commands_and_command_line(spark, tmp_path, capsys):
    f = tmp_path / "one.txt"
    f.write_text("hello world\nbye\n")
    row = read_files(spark, str(tmp_path)).first()
    assert row.file_length == 16 and bytes(row.content) == b"hello world\nbye\n"
    root = f"file://{tmp_path}/db"
    main(["create", root], spark)
    main(["add", root, str(f)], spark)
    [line] = main(["search", root, "--contains", "hello"], spark)
    assert line.endswith("one.txt:1-1")
    path = line.rsplit(":", 1)[0]
    assert main(["score", root, "hello", path], spark) == [f"{path}:1-1\t1.0000", f"{path}:2-2\t0.0000"]
    assert '"range":"2-2"' in main(["chunks", root, path, "1-1", "--after", "1"], spark)[1]
    assert main(["chunk", "line", str(f)]) == ["1-1\thello world\n", "2-2\tbye\n"]
    main(["strategy", root, "add", "numbered", "--run", "awk '{print NR\"\\t\"$0}'"], spark)
    db = Database.open(spark, root)
    db.remove(path)
    db.add_paths(str(f), strategy="numbered")
    assert [r.location for r in db.search("bye").collect()] == ["2"]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", "one\ntwo\n"), ("b", "two\nthree\n")], "path string, text string").write.parquet(str(source))
    stream = spark.readStream.schema("path string, text string").parquet(str(source))
    query = new_chunks(stream).writeStream.format("memory").queryName("distinct_chunks").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.content for r in spark.table("distinct_chunks").collect()) == ["one\n", "three\n", "two\n"]
    db = Database.create(spark, f"file://{tmp_path}/db")
    query = ingest(stream.withColumnRenamed("text", "content"), db, str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert places(db.search("two")) == [("a", "2-2"), ("b", "1-1")]


def test_append_keeps_the_file(db, spark):
    before = db.file("a").first()
    assert db.append("a", "").all_chunks is None and db.manifest["number"] == 2
    change = db.append("a", "more\nLicense")
    assert db.file("a").first() == before and [r.content for r in change.new_chunks.orderBy("content").collect()] == ["License", "more\n"]
    # the last line is completed: its old chunk goes
    change = db.append("a", " end\n", content_hash="h", file_length=99)
    assert [r.content for r in change.orphaned_chunks.collect()] == ["License"]
    now = db.file("a").first()
    assert (now.file_id, now.content_hash, now.file_length, now.mod_time_ns) == (before.file_id, "h", 99, before.mod_time_ns)
    assert places(db.search("License", Options(only=(frozenset([before.file_id]),)))) == [("a", "4-4")]
    db.set_file_length("a", 7)
    assert db.file("a").first().file_id == before.file_id and db.file("a").first().file_length == 7
    counts = {r.table: r.n_rows for r in db.record_counts().collect()}
    db.compact()
    assert {r.table: r.n_rows for r in db.record_counts().collect()} == counts and counts["occurrences"] == 6
    assert places(Database.open(spark, db.root).search("License")) == [("a", "4-4")]


def test_a_change_that_is_not_agreed_to(db, spark):
    seen = []

    def agree(change):
        seen.append(sorted(r.content for r in change.all_chunks.collect()))
        return False

    with pytest.raises(AbortedError):
        db.add(spark.createDataFrame([("c", "x1\nbanana split\n", 1)], FILES), agree=agree)
    assert seen == [["banana split\n", "x1\n"]] and db.files.count() == 2
    with pytest.raises(AbortedError):
        db.reindex(spark.createDataFrame([("a", "x1\n", 1)], FILES), agree=agree)
    assert places(db.search("apple")) == [("a", "1-1")]


def test_attributes_of_chunks(db, spark):
    def stamped(data):
        at = 0
        for i, line in enumerate(data.split(b"\n")):
            yield f"{i + 1}-{i + 1}", at, at + len(line), [("timestamp", str(1000 * (i + 1)))]
            at += len(line) + 1

    db.add_chunker("stamped", stamped)
    db.add(spark.createDataFrame([("t", "plum one\nplum two\nplum three", 5)], FILES), "stamped")
    assert places(db.search("plum", Options(after=2000))) == [("t", "2-2"), ("t", "3-3")]
    assert places(db.search("plum", Options(before=2000))) == [("t", "1-1")]
    assert places(db.search("banana", Options(after=6))) == [("b", "1-1")] or places(db.search("banana", Options(after=6))) == []


def test_forks_and_windows(db, spark):
    other = db.fork(db.root + "-fork")
    other.remove("a")
    assert places(db.search("apple")) == [("a", "1-1")] and places(other.search("apple")) == []
    db.add(spark.createDataFrame([("w", "l1 fig\nl2\nl3\n", 5)], FILES), "lines-2-1")
    assert [(r.location, r.content) for r in db.get_chunks("w", "1-2", 0, 9).collect()] == [("1-2", "l1 fig\nl2\n"), ("2-3", "l2\nl3\n"), ("3-3", "l3\n")]


def test_staleness_of_paths(spark, tmp_path):
    for name in "xyz":
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / name).write_text(f"{name} text\n")
    folder = str(tmp_path / "files")
    d = Database.create(spark, f"file://{tmp_path}/db")
    d.add_paths(folder)
    status = lambda: {r.path[-1]: r.status for r in d.check_paths(folder).collect()}
    assert status() == dict.fromkeys("xyz", "fresh")
    (tmp_path / "files" / "x").unlink()
    (tmp_path / "files" / "y").write_text("changed\n")
    (tmp_path / "files" / "z").write_text("z text\n")  # another time, the same text
    assert status() == {"x": "missing", "y": "stale", "z": "fresh"}
    assert {r.path[-1]: r.status for r in d.staleness(d.list_paths(folder)).collect()}["x"] == "missing"
    d.refresh_paths(folder)
    assert status()["y"] == "fresh" and len(places(d.search("changed"))) == 1


def test_temporary_files_after_a_line(db):
    db.add_tmp("tmp://x", "one\ntwo")
    db.append_tmp("tmp://x", "s\nthree\n")
    assert [r.content for r in db.get_chunks("tmp://x", "1-1", 0, 9).collect()] == ["one\n", "twos\n", "three\n"]
    db.append_tmp("tmp://x", "far\n", base_line=10)
    assert db.get_chunks("tmp://x", "11-11").first().content == "far\n"


def test_paths_are_skipped_by_hash(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for name in "xy":
        (folder / name).write_text(f"{name} text\n")
    d = Database.create(spark, f"file://{tmp_path}/db")
    change = d.add_paths(str(folder))
    assert sorted(r.text for r in change.contents.collect()) == ["x text\n", "y text\n"]
    before = {r.path[-1]: r.file_id for r in d.files.collect()}
    (folder / "y").write_text("other\n")
    (folder / "z").write_text("z text\n")
    d.reindex_paths(str(folder))
    after = {r.path[-1]: r.file_id for r in d.files.collect()}
    assert after["x"] == before["x"] and after["y"] != before["y"] and sorted(after) == ["x", "y", "z"]
    cache = d.chunk_cache(d.files.select("path"))
    path = d.files.where("path like '%z'").first().path
    assert cache.get_chunks(path, "1-1").first().content == "z text\n"
    assert [r.content for r in cache.contents(d.search("other")).collect()] == ["other\n"]
    cache.close()


def test_command_line_of_windows_and_staleness(spark, tmp_path):
    f = tmp_path / "one.txt"
    f.write_text("l1\nl2\nl3\n")
    assert main(["chunk-lines-overlap", str(f), "--size", "2", "--overlap", "1"])[0] == "1-2\tl1\nl2\n"
    assert main(["chunk-words-overlap", str(f), "--size", "2", "--overlap", "0"]) == ["w1\tl1\nl2", "w2\tl3"]
    root = f"file://{tmp_path}/db"
    main(["create", root, "--alias", "- "], spark)
    main(["add", root, str(f)], spark)
    assert main(["stale", root, str(f)], spark) == []
    f.write_text("changed-text\n")
    [line] = main(["stale", root, str(f), "--refresh"], spark)
    assert line.startswith("stale\t") and main(["stale", root, str(f)], spark) == []
    assert len(main(["search", root, "--contains", '"changed text"'], spark)) == 1
