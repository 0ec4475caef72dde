"""What a store holds after arrivals and merges, and what two writers see."""

import pytest
from pyspark.sql import functions as F

from tessera.llm.queries import op1_sharding
from tessera.llm.sharding import PART, CommitConflict, Part, Shard, Store, paths, shard

SIZES = {"target_bytes": 64_000, "smallest_bytes": 2_000, "fan_in": 3}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rows_stay_whole(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(12)
    store = shard(docs, f"file://{tmp_path}/a", **SIZES)
    assert rows_of(store.read()) == rows_of(docs)
    shards, _ = store.manifest()
    tiers = [s.tier for s in shards if s.bytes <= store.target_bytes // 2]
    assert all(tiers.count(t) < store.fan_in for t in tiers)
    on_disk = lambda: {p.name for p in (tmp_path / "a/data").rglob("part-*") if p.is_file()}
    found = store.versions()
    assert len(found) > 4 and store.read(found[-1]).count() == 1000
    assert on_disk() == {s.file.split("/")[-1] for v in found for s in store.manifest(v)[0]}
    per_version = {v: store.read(v).count() for v in found}
    assert sorted(per_version.values()) == [*per_version.values()]
    # each version that is kept can be read; what only others list goes
    assert store.vacuum(3) == found[:-3] and store.versions() == found[-3:]
    assert {v: store.read(v).count() for v in store.versions()} == {v: per_version[v] for v in found[-3:]}
    assert on_disk() == {s.file.split("/")[-1] for v in found[-3:] for s in store.manifest(v)[0]}
    assert store.vacuum(1) == found[-3:-1] and on_disk() == {s.file.split("/")[-1] for s in shards}
    placed = store.placed().groupBy("shard").count().collect()
    assert {r["shard"] for r in placed} == {s.file for s in shards} and sum(r["count"] for r in placed) == 1000


def test_versions_are_atomic(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/b", **SIZES)
    df = spark.createDataFrame([(1, None), (1, None), (None, "x" * 100_000), (2, "")], "doc_id long, text string").coalesce(1)
    assert store.append(df) == 1 and store.append(df.limit(0)) == 2 and store.append(df) == 3
    assert store.read(1).count() == 4 and store.read(2).count() == 4 and store.read().count() == 8
    shards, schema = store.manifest()
    with pytest.raises(CommitConflict):
        store.commit(2, shards, schema)
    (tmp_path / "b/data/lost").mkdir()
    (tmp_path / "b/data/lost/part-0.parquet").write_text("a lost task's file")
    assert store.read().count() == 8
    with pytest.raises(ValueError):
        store.append(df.withColumn("extra", F.lit(1)))
    store.compact()
    assert store.read().count() == 8


def test_writers_that_die_or_meet(spark, tmp_path, monkeypatch):
    store, other = (Store(spark, f"file://{tmp_path}/w", **SIZES) for _ in range(2))
    df = spark.createDataFrame([(k, "text") for k in range(40)], "doc_id long, text string")
    store.append(df)
    # what a writer leaves that dies before its commit: a draft, and a lock of the kind that other stores use
    (tmp_path / "w/manifest/.draft").write_text("{")
    (tmp_path / f"w/manifest/{2:012d}.lock").write_text("")
    assert store.append(df) == 2
    # another writer commits between this one's reading and its commit
    commit, met = Store.commit, []

    def late(self, base, shards, schema):
        if not met:
            met.append(commit(other, base, shards, schema))
        return commit(self, base, shards, schema)

    monkeypatch.setattr(Store, "commit", late)
    assert store.append(df.limit(1)) == 4 and met == [3] and store.read().count() == 82
    monkeypatch.setattr(Store, "commit", commit)
    # of two writers that merge the same shards one fails, and leaves nothing behind
    shards, schema = store.manifest()
    before = {p for p in (tmp_path / "w/data").rglob("part-*")}
    monkeypatch.setattr(store, "manifest", lambda version=None: (shards, schema) if version is None else Store.manifest(store, version))
    assert other.compact() > 4
    after = {p for p in (tmp_path / "w/data").rglob("part-*")}
    gone = frozenset(s.file for s in other.plan(shards))
    assert gone and before < after
    with pytest.raises(CommitConflict):
        store.change([], schema, gone)
    assert other.read().count() == 82


def test_commit_by_rename(spark, tmp_path):
    """The step that stores other than local disks take: a rename that doesn't replace."""
    store = Store(spark, f"file://{tmp_path}/r", **SIZES)
    (tmp_path / "r/manifest").mkdir(parents=True)
    for name in ("a", "b"):
        (tmp_path / f"r/manifest/{name}").write_text(name)
    place, none = store._at("manifest").toUri(), spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    rename = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place, spark._jsc.hadoopConfiguration()).rename
    rename(store._at("manifest/a"), store._at("manifest/c"), none)
    with pytest.raises(Exception, match="FileAlreadyExistsException"):
        rename(store._at("manifest/b"), store._at("manifest/c"), none)


def test_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "mine", 7)], "doc_id long, text string, shard string, arrival long")
    row = shard(df, f"file://{tmp_path}/n").placed().first()
    assert row["shard"] == "mine" and row["arrival"] == 7 and row["shard_"].startswith("data/")


def test_plan_takes_the_lowest_full_tier(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/c", target_bytes=1000, smallest_bytes=10, fan_in=2)
    small, large = [Shard(f"s{k}", 8, 0) for k in range(2)], [Shard(f"l{k}", 300, 5) for k in range(3)]
    assert store.plan(large + small) == small and store.plan(large + small[:1]) == large
    assert store.plan([Shard("x", 900, 7), Shard("y", 900, 7)]) == []


def test_commits_among_many_shards(spark, tmp_path, monkeypatch):
    """What a commit and a merge read and write doesn't grow with the shards that have reached their size."""
    df = spark.createDataFrame([(k, "text") for k in range(40)], "doc_id long, text string").coalesce(1)
    load, save, costs = Store._load, Store._save, {}
    for listed in (2_000, 100_000):
        store = Store(spark, f"file://{tmp_path}/m{listed}", **SIZES)
        store.commit(0, [Shard(f"data/{k // 500:032x}/part-{k}", 64_000, 4, 500) for k in range(listed)], df.schema)
        read, wrote = [], []
        monkeypatch.setattr(Store, "_load", lambda self, name: read.append(name) or load(self, name))
        monkeypatch.setattr(Store, "_save", lambda self, name, said: wrote.append((name, len(said))) or save(self, name, said))
        for _ in range(3):
            store.append(df)
        assert store.compact() == 5
        monkeypatch.undo()
        costs[listed] = sum(n.startswith("lists/") for n in read), [n for name, n in wrote if name.startswith("lists/")]
        shards, _ = store.manifest()
        parts, _ = store.parts()
        assert len(shards) == listed + 1 and len(parts) == listed // PART + 1
        assert len(paths(shards)) == listed // 500 + 1
    assert costs[2_000] == costs[100_000] and sum(costs[100_000][1]) < 20


def test_lists_that_merges_break(spark, tmp_path, monkeypatch):
    """Lists that lose shards are written anew with what is left; short ones are brought together; nothing is lost or listed twice."""
    monkeypatch.setattr("tessera.llm.sharding.PART", 10)
    store = Store(spark, f"file://{tmp_path}/l", **SIZES)
    schema = spark.createDataFrame([], "doc_id long").schema
    want: set[str] = set()
    for k in range(40):
        added = [Shard(f"data/{k}/part-{j}", 64_000 if j % 3 == 0 else 500, 0, 7) for j in range(7)]
        gone = frozenset(sorted(s.file for s in store.manifest()[0] if s.bytes == 500)[k % 5 : 20 : 2]) if k % 2 else frozenset()
        store.change(added, schema, gone)
        want = (want - gone) | {s.file for s in added}
        found, parts = [s.file for s in store.manifest()[0]], store.parts()[0]
        assert sorted(found) == sorted(want)
        assert all(store._is_open(s) == p.open for p in parts for s in store.listed([p])) and sum(p.shards for p in parts) == len(want)
        assert sum(p.shards < 5 for p in parts) <= 3 and all(p.shards <= 10 for p in parts)
    with pytest.raises(CommitConflict):  # settled shards are nobody's to merge
        store.change([], schema, frozenset([next(s.file for s in store.manifest()[0] if s.bytes > 500)]))
    lists = lambda: {f"lists/{p.name}" for p in (tmp_path / "l/lists").glob("*.json")}
    store.vacuum(1)
    assert lists() == {p.file for p in store.parts()[0]} and sorted(s.file for s in store.manifest()[0]) == sorted(want)
    with pytest.raises(CommitConflict):
        store.commit(1 + len(range(38)), [Part("lists/none.json", 1, True), Shard("data/x/part-0", 1, 0)], schema)
    assert lists() == {p.file for p in store.parts()[0]}


def test_empty_table_and_query(spark, tmp_path):
    empty = shard(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/d")
    assert empty.read().count() == 0
    got = op1_sharding(spark, "/root/testdata/sf0.01")
    want = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256), F.col("n_chars"))
    assert rows_of(got.select("doc_id", "text_sha256", "n_chars")) == rows_of(want)


def test_query_on_an_empty_table(spark, tmp_path):
    """No rows in, no rows out, under the columns that any other table gives."""
    from tessera.llm.queries import QUERIES

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    empty = QUERIES["op1_sharding"](spark, f"file://{tmp_path}")
    assert empty.collect() == [] and empty.dtypes == QUERIES["op1_sharding"](spark, "/root/testdata/sf0.001").dtypes
