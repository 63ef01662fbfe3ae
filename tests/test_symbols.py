"""Column functions, operators, stores, sources and streams; every registered query against its SQL."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from mangrove.functions import symbols as S
from mangrove.kernel.parser import word
from mangrove.operators import nodes as N
from mangrove.plans import registry
from mangrove.sources import symbols as sources
from mangrove.streaming import symbols as streams

SYMBOLS = ["$s4main3FooV", "$s4main3FooVSgD", "$s4main1gyyxlF", "$sSaySiGD", "_$s4main3FooV", "nonsense", None, "", "$e4main3FooVN"]


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")


@pytest.fixture(scope="module")
def tables(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, sf, tables, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    text = lambda v: None if v is None else str(v)
    got = sorted((tuple(text(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = tables.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(text(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)


def test_errors_are_values(symbols):
    rows = {r["symbol"]: r for r in N.parse(symbols).collect()}
    assert rows["$s4main3FooV"]["ok"] and not rows["nonsense"]["ok"] and rows["nonsense"]["error"]["code"]
    assert rows[None]["ok"] is None and not rows[""]["ok"] and rows["$e4main3FooVN"]["flavor"] == "embedded"


def test_tree_columns_round_trip(symbols):
    parsed = N.parse(symbols).where("ok")
    got = parsed.select("symbol", S.print_tree(F.col("tree")).alias("a"), S.print_symbol(F.col("symbol")).alias("b"), S.mangle(F.col("tree"))["mangled"].alias("m"), S.can_mangle(F.col("tree")).alias("c")).collect()
    assert all(r["a"] == r["b"] and r["c"] for r in got)
    assert {r["m"] for r in got if r["symbol"] == "$s4main3FooV"} == {"_$s4main3FooV"}


def test_rewrite_edit_and_depths(symbols):
    parsed = N.parse(symbols).where("symbol = '$s4main3FooV'")
    renamed = parsed.select(S.print_tree(S.rewrite(F.col("tree"), lambda n: word("x", "module") if n.kind == "module" else n)).alias("t")).collect()
    assert renamed[0]["t"] == "x.Foo"
    assert "shared" not in parsed.select(S.shared_dump(F.col("symbol")).alias("t")).collect()[0]["t"]
    depths = symbols.where("symbol = '$s4main1gyyxlF'").select(S.generic_depths(F.col("symbol")).alias("d")).collect()
    assert depths[0]["d"] == {0: 0}


def test_small_functions(spark):
    row = spark.range(1).select(S.hexadecimal(F.lit(255)).alias("h"), S.capitalize_first(F.lit("abc")).alias("c"), S.param_name(F.lit(2), F.lit(27)).alias("p")).collect()[0]
    assert (row["h"], row["c"], row["p"]) == ("FF", "Abc", "BB2")


def test_identifier_and_first_of(symbols):
    parsed = N.parse(symbols).where("symbol = '$s4main3FooV'")
    assert parsed.select(S.identifier_of(F.col("tree")).alias("i"), S.first_of(F.col("tree"), "class").alias("c")).collect()[0].asDict() == {"i": "Foo", "c": None}


def test_store_round_trip_and_merge(spark, symbols, tmp_path):
    parsed = N.parse(symbols)
    sources.write_store(parsed, str(tmp_path / "a"))
    nodes, roots = sources.read_store(spark, str(tmp_path / "a"))
    ids = sorted(r["node_id"] for r in nodes.collect())
    assert ids == list(range(len(ids)))
    assert nodes.join(nodes.select(F.col("node_hash").alias("k"), F.col("node_id").alias("kid")), F.array_contains("kids", F.col("k"))).where("kid >= node_id").count() == 0
    assert N.materialize(nodes, roots).count() == N.nodes(parsed).count()
    assert sources.merge_stores(nodes, nodes).count() == nodes.count()
    assert N.corpus_diff(parsed, parsed.where("symbol <> '$s4main1gyyxlF'")).collect()[0]["symbol"] == "$s4main1gyyxlF"


def test_materialize_reaches_every_level(spark, symbols):
    parsed = N.parse(symbols)
    store, roots = N.intern(parsed), N.roots(parsed)
    assert store.agg(F.max("height")).collect()[0][0] > 4
    rows = lambda df: sorted(map(str, df.select("symbol", "kind", "text", "idx").collect()))
    assert rows(N.materialize(store, roots)) == rows(N.nodes(parsed))
    assert N.materialize(store, roots.limit(0)).count() == 0


def test_listings(spark, tmp_path):
    path = tmp_path / "listing.txt"
    path.write_text("0000000000001000 T _$s4main3FooVN\n_$s4main3BarV\nnot one\n                 U _printf\n")
    rows = sources.read_listing(spark, str(path), "image").collect()
    assert [(r["symbol"], r["offset"]) for r in rows] == [("_$s4main3FooVN", 4096), ("_$s4main3BarV", None)]
    spark.dataSource.register(sources.SymbolListing)
    odd = tmp_path / "odd.txt"
    odd.write_bytes(b"ffffffff80000000 T _$s4main3FooVN\n0000000000000001 T _$s4main\xff3FooV\n")
    read = spark.read.format("symbol_listing").option("paths", odd.as_uri()).load().orderBy("offset").collect()
    assert [int(r["offset"]) for r in read] == [1, 0xFFFFFFFF80000000] and read[1]["symbol"] == "_$s4main3FooVN"
    assert spark.read.format("symbol_listing").option("paths", str(path)).load().count() == 2


def test_interning_straight_from_symbols(symbols):
    parsed = N.parse(symbols)
    plain = lambda df: sorted(map(str, df.select("node_hash", "kind", "text", "idx", "kids", "height", "payload_kind").collect()))
    assert plain(N.intern(parsed)) == plain(N.intern_symbols(symbols)) == plain(N.intern_symbols(symbols, held=1))


def test_bulk_fields_and_set_operations(symbols):
    got = {r["symbol"]: r["t"] for r in symbols.select("symbol", S.texts_of(F.col("symbol"), "module", "identifier", "index").alias("t")).collect()}
    assert got["$s4main3FooV"] == ["main", "Foo", None] and got["nonsense"] is None and got[None] is None
    a, b = N.parse(symbols.where("symbol like '%Foo%'")), N.parse(symbols.where("symbol = '$s4main3FooV'"))
    assert N.corpus_common(a, b).count() == 1 and N.corpus_surplus(a, b).count() == N.roots(a).count() - 1


def test_streams(spark, symbols, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    timed = symbols.where("symbol is not null").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:01")))
    timed.write.parquet(folder)
    stream = lambda: spark.readStream.schema(timed.schema).parquet(folder)
    run = streams.printed_stream(stream().select("symbol")).writeStream.format("memory").queryName("printed").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("printed").count() == 6
    counts = streams.module_counts(stream()).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert {r["module"]: r["n"] for r in spark.table("counts").collect()}["main"] == 4
    streams.intern_stream(stream().select("symbol"), store, str(tmp_path / "c1")).awaitTermination()
    symbols.where("symbol is not null").withColumn("ts", F.current_timestamp()).write.mode("append").parquet(folder)
    first = spark.read.parquet(store).count()
    streams.intern_stream(stream().select("symbol"), store, str(tmp_path / "c1")).awaitTermination()
    known = spark.read.parquet(store)
    assert known.count() == first == known.select("node_hash").distinct().count()


def test_plans_push_down_and_stay_native(spark, sf):
    import io
    from contextlib import redirect_stdout

    with redirect_stdout(io.StringIO()) as out:
        registry.methods(spark, sf).where(S.is_symbol(F.col("symbol"))).select("symbol").explain("formatted")
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_returnflag:string>" in out.getvalue() and "Python" not in out.getvalue()
