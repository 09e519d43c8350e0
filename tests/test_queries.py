"""Every query against its SQL, on the smallest tables; and the report must notice a wrong answer."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from granary.functions.edits import near_duplicate
from granary.plans import catalog as C
from granary.plans import queries as Q
from granary.plans import report as R
from granary.sources.catalog import publish, scan

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in Q.SQL:
        assert got[1]
        return
    r = duck.execute(Q.SQL[name])
    assert got == table([d[0] for d in r.description], r.fetchall())


def test_report_notices_tampering(spark):
    cases = spark.range(20).select("id", F.col("id").cast("string").alias("want"), F.when(F.col("id").isin(3, 4, 7, 9, 11, 12), "x").otherwise(F.col("id").cast("string")).alias("got"))
    assert tuple(R.differential(cases, "id", F.col("want"), F.col("got")).first()) == (20, 14, "3,4,7,9,11")


def test_medians(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    assert {r["k"]: (r["upper_median"], r["median"]) for r in R.medians(df, ["k"], "v").collect()} == {"a": (3.0, 2.0), "b": (5.0, 5.0)}


def test_medians_of_odd_values(spark):
    rng = __import__("random").Random(2)
    rows = [(k, v) for k, n in (("a", 1001), ("b", 500), (None, 7)) for v in [rng.choice([rng.gauss(0, 1), 3.0, 1e9, -1e9]) for _ in range(n)]]
    rows += [("nulls", None)] * 3 + [("nulls", 1.0)] * 4 + [("odd", float("inf")), ("odd", float("-inf")), ("odd", float("nan"))] + [("same", 2.5)] * 100 + [("void", None)]
    got = {r["k"]: (r["upper_median"], r["median"]) for r in R.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in {r[0] for r in rows}:
        own = sorted((v for q, v in rows if q == k), key=lambda v: (v is not None, v != v if v is not None else False, v or 0.0))
        up, down = own[len(own) // 2], own[(len(own) + 1) // 2 - 1]
        assert got[k] == (up, None if up is None or down is None else (up + down) / 2)


def test_adjacent_pairs_in_ranges(spark, monkeypatch):
    from granary.operators import dedup

    rows = [("ab"[i % 2], i * i, f"r{i}") for i in range(200)] + [("c", 5, "x"), (None, 1, "n1"), (None, 39000, "n2")]
    df = spark.createDataFrame(rows, "p string, o bigint, v string")
    want = sorted((a[2], b[2]) for p in ("a", "b", "c", None) for x in [sorted((r for r in rows if r[0] == p), key=lambda r: r[1])] for a, b in zip(x, x[1:]))
    for size in (1 << 20, 10, 1):
        monkeypatch.setattr(dedup, "SORTED_ROWS", size)
        assert sorted((r["v"], r["next_v"]) for r in dedup.adjacent_pairs(df, "p", "o", ["v"]).collect()) == want
    assert dedup.adjacent_pairs(df.limit(0), "p", "o", ["v"]).count() == 0


def test_files_are_hashed_whole(spark):
    import hashlib

    got = {r["file"]: (r["length"], r["sha256"]) for r in Q.hash_table_files(spark, DATA).collect()}
    files = {f"{t}.parquet": open(f"{DATA}/{t}.parquet", "rb").read() for t in TABLES}
    assert got == {f: (len(b), hashlib.sha256(b).hexdigest()) for f, b in files.items()}


def test_ordered_digests_hold_every_chunk(spark, tmp_path):
    import hashlib

    from granary.streaming import incremental as T

    rows = [(1, 2, b"c"), (1, 1, b"b"), (1, 1, b"a"), (1, None, b"0"), (2, 1, None), (2, 1, b"x")]
    spark.createDataFrame(rows, "k bigint, o bigint, d binary").write.parquet(str(tmp_path / "t.parquet"))
    got = {r["k"]: (r["n_chunks"], r["hexdigest"]) for r in T.drain(T.ordered_digests(T.read_stream(spark, str(tmp_path), "t"), "k", "o", "d"), "update").collect()}
    assert got == {1: (4, hashlib.sha256(b"0abc").hexdigest()), 2: (2, hashlib.sha256(b"x").hexdigest())}


def test_catalog_files(spark, tmp_path):
    import json

    for e in Q.CATALOG[:3]:
        (tmp_path / f"{e['name']}.json").write_text(json.dumps(e, indent=2))
    parts = scan(spark, str(tmp_path))
    assert [r["name"] for r in parts.collect()] == sorted(e["name"] for e in Q.CATALOG[:3])
    assert C.file_name_issues(parts).count() == 0 and C.validate(parts).count() == 0
    publish(parts, C.index(parts), str(tmp_path / "out"))
    whole = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out" / "index")).collect())
    assert [p["name"] for p in json.loads(whole)["parts"]] == sorted(e["name"] for e in Q.CATALOG[:3])
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        scan(spark, str(tmp_path)).collect()


def test_catalog_errors(spark):
    with pytest.raises(ValueError):
        C.search(Q.catalog(spark), "music")
    with pytest.raises(ValueError):
        C.localized(Q.catalog(spark), "xx")
    with pytest.raises(Exception, match="collide"):
        spark.range(1).select(C.install_layout(F.array(F.lit("a/X.rs"), F.lit("a/x.rs")))).collect()
    assert C.search(Q.catalog(spark), None, "  ").count() == len(Q.CATALOG)


def test_sizes_at_the_borders_of_their_units(spark, duck, tmp_path):
    """The query's unit is that of the number before rounding, as in its SQL; the function by itself carries over to the next unit, as compact notation does."""
    keys = [*range(268, 274), 750, 1250, 27025, 27026, 27027, 27028, 250000, 27027025, 27027026, 27027027, 27027028, 123456789]
    spark.createDataFrame([(k, 7) for k in keys], "p_partkey bigint, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    df = Q.format_numbers(spark, str(tmp_path))
    r = duck.execute(Q.SQL["format_numbers"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'"))
    assert table(df.columns, [tuple(x) for x in df.collect()]) == table([d[0] for d in r.description], r.fetchall())
    n = spark.createDataFrame([(999_949,), (999_999,), (999_999_999,)], "n bigint")
    assert [tuple(x) for x in n.select(C.format_size(F.col("n")), C.format_size(F.col("n"), carry=False)).collect()] == [("999.9K", "999.9K"), ("1M", "1000K"), ("1B", "1000M")]


def test_upper_case_of_edits_is_one_for_one(spark, duck, tmp_path):
    """Every character as the SQL has it, and the query on texts full of letters whose full upper case is longer."""
    from granary.functions.edits import simple_upper

    differ = [r["c"] for r in Q.code_points(spark).select("c", simple_upper("c").alias("u")).filter("c <> u").collect()]
    got = dict(tuple(r) for r in spark.createDataFrame([(c,) for c in differ], "c string").select("c", simple_upper("c")).collect())
    assert got == dict(duck.execute("SELECT chr(i::INT), upper(chr(i::INT)) FROM range(1, 1114112) r(i) WHERE i NOT BETWEEN 55296 AND 57343 AND upper(chr(i::INT)) <> chr(i::INT)").fetchall())
    spark.createDataFrame([(i, "de", "größe Straße ŉu ﬃx ᾳ ǰa ıß 𐐨 x") for i in range(200)], "doc_id bigint, lang string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = Q.near_duplicate_texts(spark, str(tmp_path))
    r = duck.execute(Q.SQL["near_duplicate_texts"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))
    assert table(df.columns, [tuple(x) for x in df.collect()]) == table([d[0] for d in r.description], r.fetchall())


def test_copies_edited_in_case_only_have_equal_signatures(spark, duck, tmp_path):
    """Texts of two words: upper case keeps the whole signature, so similarity shows which mapping was used."""
    spark.createDataFrame([(i, "de", "große Straße") for i in range(300)], "doc_id bigint, lang string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = Q.minhash_edited_copies(spark, str(tmp_path))
    got = [tuple(r) for r in df.select("doc_id", "jaccard").collect()]
    near = {r["doc_id"] for r in spark.createDataFrame([(i,) for i in range(300)], "doc_id bigint").select("doc_id", near_duplicate(F.lit("große Straße"), "doc_id", edits=2).alias("t")).collect() if r["t"] != "große Straße" and r["t"].lower() == "große straße"}
    assert near and all(j == 1.0 for i, j in got if i in near)
    r = duck.execute(Q.SQL["minhash_edited_copies"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'", 1).replace("(SELECT 2 * doc_id AS doc_id, lang, text FROM documents UNION ALL SELECT 2 * doc_id + 1, lang, edited.text FROM edited JOIN documents USING", f"(SELECT 2 * doc_id AS doc_id, lang, text FROM '{tmp_path}/documents.parquet/*.parquet' UNION ALL SELECT 2 * doc_id + 1, lang, edited.text FROM edited JOIN '{tmp_path}/documents.parquet/*.parquet' USING"))
    assert sorted(map(repr, got)) == sorted(repr(tuple(x)) for x in r.fetchall())


def test_copies_of_texts_whose_lower_case_depends_on_the_place(spark, tmp_path):
    """Σ at the end of a word and İ, in texts and through edits of case; every character by itself, too."""
    from granary.functions.edits import lowers_alone

    con, lower = duckdb.connect(), {r["c"]: r["l"].lower() for r in Q.code_points(spark).select("c", lowers_alone("c").alias("l")).collect()}
    assert {c: l for c, l in lower.items() if c != l} == dict(con.execute("SELECT chr(i::INT), lower(chr(i::INT)) FROM range(1, 1114112) r(i) WHERE i NOT BETWEEN 55296 AND 57343 AND lower(chr(i::INT)) <> chr(i::INT)").fetchall())
    texts = ["ο δρόμος της πόλης", "ΟΔΟΣ ΚΑΙ ΝΟΜΟΣ ΤΗΣ ΠΟΛΗΣ", "İstanbul ve İzmir Iğdır", "iki ışık", "ΑΣ.ΑΣΑ Σ ς"]
    spark.createDataFrame([(i, "el", texts[i % len(texts)]) for i in range(500)], "doc_id bigint, lang string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in Q.minhash_edited_copies(spark, str(tmp_path)).select("doc_id", "jaccard").collect()]
    assert sorted(got) == sorted(con.execute(f"SELECT doc_id, jaccard FROM ({Q.SQL['minhash_edited_copies']})").fetchall())
